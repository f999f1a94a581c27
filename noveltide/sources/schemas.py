"""Row schemas of the JSON records. Absent keys read as null."""

VERDICT = "struct<approved:boolean,task_valid:boolean,addresses_critique:boolean,unresolved_issues:array<string>,reason:string>"
SCHEMAS = {
    "prompt": "prompt string, domain string",
    "inference": "prompt string, responses array<map<string,string>>, domain string",
    "team": "prompt string, agent_models array<string>, agent_texts array<string>, joint_model string, joint_text string, responses array<map<string,string>>, domain string",
    "triad": "prompt string, domain string, agent_models array<string>, agent_texts array<string>, roles array<string>, joint_text string, "
    f"transcript array<struct<role:string,step:string,round:int,model:string,content:string,parsed:{VERDICT}>>, responses array<map<string,string>>, verified boolean, revision_rounds int",
    "score": "prompt string, domain string, response_key string, response string, score double, cue double, r_d double, r_b double, g_k double, cue_gate double, d_gate double, "
    "alpha double, lambda_g double, delta_d double, stub_cue boolean, cue_diag struct<prior:array<double>,posterior:array<double>,outcome_index:int,outcome_label:string,outcomes:array<string>>, mas struct<n_agents:int,agent_models:array<string>>",
    "trajectory": "prompt string, domain string, n_steps int, t_values array<int>, step_cue array<double>, step_rb array<double>, "
    "step_cue_fit struct<c_inf:double,mu:double,gamma:double,n_points:int,reliable:boolean,residual_rmse:double>, diverge_converge struct<dc:double,peak_index:int,n_points:int>",
    "judge": "prompt string, response_key string, judge_scores map<string,map<string,double>>, mean_scores map<string,double>",
    "chat": "messages array<struct<role:string,content:string>>, categories array<struct<category:string>>, prompt string",
    "idea": "research_idea struct<objective:string,problem_statement:string,solution_approach:string>, novelty_score int, prompt string, input string, text string",
    "math": "refined_statement string, formal_statement string, informal_statement string, problem string, prompt string, domain string",
    "delta": "version string, delta_d double, paraphrase_r_d map<string,double>, restructure_r_d map<string,double>, paraphrase_mean double, restructure_mean double, probe_limit int, separable boolean",
    "price": "model_id string, prompt_per_token double, completion_per_token double",
}
