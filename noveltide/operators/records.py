"""Record shaping: responses, prompts, transcripts, teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltide.functions import metrics as M
from noveltide.functions.text import parse_verdict, strip, verifier_feedback


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def response_text(df: DataFrame, key: str, responses: str = "responses") -> Column:
    """The response under ``key``: of the first map that has it (even if null), else the first map's first value, the
    joint text, the column named like the key, the column ``response``."""
    cols = set(df.columns)
    rest = [_nonempty(F.col(c)) for c in ("joint_text", key, "response") if c in cols]
    rest = F.coalesce(*rest) if rest else F.lit(None).cast("string")
    if responses not in cols:
        return rest
    having = F.filter(responses, lambda m: F.map_contains_key(m, F.lit(key)))
    first = F.get(F.map_values(F.get(F.col(responses), F.lit(0))), F.lit(0))
    return F.when(F.size(having) > 0, F.try_element_at(F.get(having, F.lit(0)), F.lit(key))).when(F.size(responses) > 0, F.coalesce(first, rest)).otherwise(rest)


def first_user_message(messages: str | Column) -> Column:
    """Content of the first user message that has any."""
    return F.get(F.filter(messages, lambda m: (m["role"] == "user") & (m["content"] != "")), F.lit(0))["content"]


def cost_prompt(df: DataFrame) -> Column:
    """Prompt of the cost path: prompt, first user message, refined statement or the labelled parts of an idea; raises if empty."""
    cols, options = set(df.columns), []
    if "prompt" in cols:
        options.append(_nonempty(F.col("prompt")))
    if "messages" in cols:
        options.append(first_user_message("messages"))
    if "refined_statement" in cols:
        options.append(_nonempty(F.col("refined_statement")))
    if "research_idea" in cols:
        i = F.col("research_idea")
        part = lambda label, c: F.when(i[c] != "", F.concat(F.lit(f"{label}: "), i[c]))
        options.append(_nonempty(F.concat_ws("\n\n", part("Objective", "objective"), part("Problem statement", "problem_statement"), part("Solution approach", "solution_approach"))))
    return F.coalesce(*options, F.raise_error(F.lit("a row has no prompt")).cast("string"))


def eval_prompt(df: DataFrame) -> Column:
    """Prompt of the evaluation path: the idea's parts unlabelled, or the statement columns in their order with a task line in front."""
    cols, options = set(df.columns), []
    if "research_idea" in cols:
        i = F.col("research_idea")
        options.append(_nonempty(F.concat_ws("\n\n", *[_nonempty(i[c]) for c in ("objective", "problem_statement", "solution_approach")])))
    statements = [_nonempty(F.col(c)) for c in ("refined_statement", "formal_statement", "informal_statement", "problem") if c in cols]
    if statements:
        options.append(F.concat(F.lit("Prove or rigorously justify the following.\n\n"), F.coalesce(*statements)))
    options += [_nonempty(F.col(c)) for c in ("prompt", "input", "text") if c in cols]
    if "messages" in cols:
        options.append(F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"])
    return F.coalesce(*options)


def train_prompt(df: DataFrame) -> Column:
    """Prompt of the training-corpus path: an idea's parts, a statement with its task line, then prompt, input or text
    (stripped, none empty), then the first user message with a content, stripped."""
    cols, options = set(df.columns), []
    if "research_idea" in cols or {"refined_statement", "formal_statement", "informal_statement", "problem"} & cols:
        options.append(eval_prompt(df.drop("prompt", "input", "text", "messages")))
    options += [_nonempty(strip(F.col(c))) for c in ("prompt", "input", "text") if c in cols]
    if "messages" in cols:
        options.append(strip(F.get(F.filter("messages", lambda m: (m["role"] == "user") & m["content"].isNotNull()), F.lit(0))["content"]))
    return F.coalesce(*options)


def with_lookup(df: DataFrame, key: str, table: DataFrame, value: str, default: str) -> DataFrame:
    """``df`` plus ``value`` from the table (key, value), ``default`` where the key is not in it or null."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def in_math_subset(domain: str | Column) -> Column:
    d = F.col(domain) if isinstance(domain, str) else domain
    return F.coalesce(d.contains("Algebra") | d.contains("Number Theory"), F.lit(False))


def without_empty(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which every one of the columns (texts or arrays) is there and not empty."""
    kinds = dict(df.dtypes)
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ((F.size(c) > 0) if kinds[c].startswith("array") else (F.col(c) != "")))
    return df


def limit_written(df: DataFrame, order: list[str], n: int | None, zero_is_none: bool = True) -> DataFrame:
    """The first n rows in order; 0 keeps nothing, or everything where ``zero_is_none`` is false."""
    if n is None or (n == 0 and not zero_is_none):
        return df
    return df.orderBy(*order).limit(n)


def explode_transcript(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("transcript").alias("pos", "s")).select(key, "pos", "s.*")


def trajectory_steps(steps: DataFrame, key: str) -> DataFrame:
    """(key, t, content): the first draft, then revisions by round (a missing round is 0), t from 1."""
    s = steps.where(F.col("step").isin("draft", "revision")).withColumn("__k", F.when(F.col("step") == "draft", 0).otherwise(1))
    s = s.withColumn("__r", F.when(F.col("__k") == 0, 0).otherwise(F.coalesce("round", F.lit(0))))
    s = s.withColumn("__d", F.row_number().over(Window.partitionBy(key, "__k").orderBy("pos"))).where("__k = 1 or __d = 1")
    return s.select(key, F.row_number().over(Window.partitionBy(key).orderBy("__k", "__r", "pos")).alias("t"), "content")


def with_verdict(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("verdict", parse_verdict(F.col(column))).withColumn("feedback", verifier_feedback(F.col("verdict")))


def length_gain(rows: DataFrame, key: str, agent: Column, joint: Column, text: str = "text") -> DataFrame:
    """(key, n_agents, h_joint, h_best, g_k): the joint text's length entropy over the best agent's, clipped at 0."""
    h = M.length_entropy(F.col(text))
    g = rows.groupBy(key).agg(F.count(F.when(agent, 1)).alias("n_agents"), F.max(F.when(agent, h)).alias("h_best"), F.max(F.when(joint, h)).alias("h_joint"))
    return g.withColumn("g_k", F.when(F.col("h_best").isNull() | F.col("h_joint").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("h_joint") - F.col("h_best"))))
