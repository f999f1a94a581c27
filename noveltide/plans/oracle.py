"""SQL building blocks that DuckDB runs on the same tables."""

WS = "chr(32) || chr(9) || chr(10) || chr(13)"


def spans(source: str, key: str, text: str = "text") -> str:
    return rf"""SELECT {key}, list_filter(list_transform(flatten(list_transform(
      string_split(regexp_replace(trim({text}, {WS}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda p: string_split(regexp_replace(p, '\s*[;—]\s*', chr(2), 'g'), chr(2)))),
      lambda x: trim(x, {WS})), lambda x: length(x) > 0) AS spans FROM {source}"""


def symbols(source: str, key: str, buckets: int = 32) -> str:
    return f"""SELECT {key}, (generate_subscripts(spans, 1) - 1)::INTEGER AS pos, unnest(spans) AS span,
      'i' || (('0x' || substr(sha256(lower(unnest(spans))), 1, 8))::BIGINT % {buckets}) AS sym FROM ({spans(source, key)})"""


def padded(name: str, key: str, begin: str = "") -> str:
    """Rows (key, pos, w, c1, c2) from the CTE ``name`` (key, pos, sym); ``begin`` stands before the first BOS."""
    return f"""SELECT {key}, pos, sym AS w, coalesce(lag(sym, 1) OVER w, '<s>') AS c1, coalesce(lag(sym, 2) OVER w, CASE WHEN pos = 0 THEN '{begin}' ELSE '<s>' END) AS c2
      FROM (SELECT {key}, pos, sym FROM {name} UNION ALL SELECT {key}, max(pos) + 1, '</s>' FROM {name} GROUP BY {key})
      WINDOW w AS (PARTITION BY {key} ORDER BY pos)"""


def model(pad: str) -> str:
    """CTEs cn, ct, pr, bo from the CTE ``pad``."""
    return f"""
    cn AS (SELECT 1 AS n, '' AS ctx, w, count(*) AS c FROM {pad} GROUP BY w
      UNION ALL SELECT 2, c1, w, count(*) FROM {pad} GROUP BY c1, w
      UNION ALL SELECT 3, c2 || ' ' || c1, w, count(*) FROM {pad} GROUP BY c2, c1, w
      UNION ALL SELECT 1, '', '<s>', 2 * count(*) FROM {pad} WHERE w = '</s>' HAVING count(*) > 0
      UNION ALL SELECT 2, '<s>', '<s>', count(*) FROM {pad} WHERE w = '</s>' HAVING count(*) > 0),
    ct AS (SELECT n, ctx, sum(c) AS total, count(*) AS kinds FROM cn GROUP BY n, ctx),
    pr AS (SELECT n, ctx, w, CASE WHEN w = '<s>' THEN 1e-99 ELSE c::DOUBLE / (SELECT sum(c) FROM cn WHERE n = 1 AND w <> '<s>') END AS p FROM cn WHERE n = 1
      UNION ALL SELECT cn.n, cn.ctx, w, c::DOUBLE / (total + kinds) FROM cn JOIN ct USING (n, ctx) WHERE cn.n > 1),
    ms AS (SELECT cn.n, cn.ctx, sum(coalesce(pr.p, 0.0)) AS mass FROM cn LEFT JOIN pr ON pr.n = cn.n - 1 AND pr.w = cn.w
      AND pr.ctx = CASE WHEN cn.n = 2 THEN '' ELSE string_split(cn.ctx, ' ')[2] END WHERE cn.n > 1 GROUP BY cn.n, cn.ctx),
    bo AS (SELECT ms.n - 1 AS n, ctx, CASE WHEN mass <= 0 THEN 1.0::DOUBLE ELSE (kinds::DOUBLE / (total + kinds)) / mass END AS bow FROM ms JOIN ct USING (n, ctx))"""


def bits(tokens: str, columns: str) -> str:
    """``columns`` of ``tokens`` (w, c1, c2) plus bits, from the CTEs of model()."""
    return f"""SELECT {columns}, -log2(coalesce(p3.p, coalesce(b2.bow, 1.0) * coalesce(p2.p, coalesce(b1.bow, 1.0) * coalesce(p1.p, 1e-99)))) AS bits
      FROM {tokens} t
      LEFT JOIN pr p3 ON p3.n = 3 AND p3.ctx = t.c2 || ' ' || t.c1 AND p3.w = t.w
      LEFT JOIN pr p2 ON p2.n = 2 AND p2.ctx = t.c1 AND p2.w = t.w
      LEFT JOIN pr p1 ON p1.n = 1 AND p1.w = t.w
      LEFT JOIN bo b2 ON b2.n = 2 AND b2.ctx = t.c2 || ' ' || t.c1
      LEFT JOIN bo b1 ON b1.n = 1 AND b1.ctx = t.c1"""


PROBE_MODEL = f"""ps AS ({symbols('benchmark', 'item_id')}),
    pt AS ({padded('ps', 'item_id', '<s>')}),{model('pt')},
    pp AS ({padded('ps', 'item_id')})"""

TAILS = """tl AS (SELECT doc_id, max_by(sym, pos) AS t1, coalesce(max_by(prev, pos), '<s>') AS t2
      FROM (SELECT doc_id, pos, sym, lag(sym) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM sy) GROUP BY doc_id)"""

# Literal reading: every output against every probe, all tokens.
NOVELTY = f"""hd AS (SELECT item_id, w, c1, c2, pos FROM pp),
    al AS (SELECT sum(bits) AS alone FROM ({bits('hd', 't.pos')})),
    td AS (SELECT DISTINCT t1, t2 FROM tl),
    cd AS (SELECT t1, t2, w, CASE WHEN pos = 0 THEN t1 ELSE c1 END AS c1, CASE WHEN pos = 0 THEN t2 WHEN pos = 1 THEN t1 ELSE c2 END AS c2 FROM td CROSS JOIN hd),
    rt AS (SELECT t1, t2, (SELECT alone FROM al) - sum(bits) AS r_d FROM ({bits('cd', 't.t1, t.t2')}) GROUP BY t1, t2),
    rd AS (SELECT doc_id, r_d FROM tl JOIN rt USING (t1, t2))"""

BELIEFS = """lb AS (SELECT d.doc_id, lang, source, text, CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 0 AND toxic = 0 THEN 1 WHEN quality = 1 AND toxic = 1 THEN 2 ELSE 3 END AS z
      FROM documents d JOIN labels USING (doc_id)),
    pz AS (SELECT avg((z = 0)::INT) AS q0, avg((z = 1)::INT) AS q1, avg((z = 2)::INT) AS q2, avg((z = 3)::INT) AS q3 FROM lb),
    gz AS (SELECT lang, source, avg((z = 0)::INT) AS s0, avg((z = 1)::INT) AS s1, avg((z = 2)::INT) AS s2, avg((z = 3)::INT) AS s3 FROM lb GROUP BY lang, source),
    bf AS (SELECT doc_id, lang, source, z, greatest(octet_length(encode(text)) * 8, 8) AS bits,
        pow(q0 - (z = 0)::INT, 2) + pow(q1 - (z = 1)::INT, 2) + pow(q2 - (z = 2)::INT, 2) + pow(q3 - (z = 3)::INT, 2) AS b0,
        pow(s0 - (z = 0)::INT, 2) + pow(s1 - (z = 1)::INT, 2) + pow(s2 - (z = 2)::INT, 2) + pow(s3 - (z = 3)::INT, 2) AS b1
      FROM lb JOIN gz USING (lang, source) CROSS JOIN pz),
    cu AS (SELECT doc_id, lang AS domain, greatest(0.0, b0 - b1) / bits AS cue, greatest(0.0, b0 - b1) AS brier_delta FROM bf)"""

SCORED = f"""sy AS ({symbols('documents', 'doc_id')}),
    {PROBE_MODEL},
    {TAILS},
    {NOVELTY},
    {BELIEFS},
    sn AS (SELECT doc_id, sym, count(*) AS n FROM sy GROUP BY doc_id, sym),
    rb AS (SELECT doc_id, least(1.0, sum(-(n / t) * ln(n / t)) / ln(32.0)) AS r_b FROM (SELECT doc_id, n::DOUBLE AS n, sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS t FROM sn) GROUP BY doc_id),
    sc AS (SELECT doc_id, domain, cue, round(coalesce(r_d, 0.0), 9) AS r_d, coalesce(r_b, 0.0) AS r_b, 0.0::DOUBLE AS g_k,
        (cue > 0)::INT::DOUBLE AS cue_gate, (round(coalesce(r_d, 0.0), 9) > 0)::INT::DOUBLE AS d_gate,
        (cue > 0)::INT * (round(coalesce(r_d, 0.0), 9) > 0)::INT * (cue * (1 + coalesce(r_b, 0.0))) AS score
      FROM cu LEFT JOIN rd USING (doc_id) LEFT JOIN rb USING (doc_id))"""
