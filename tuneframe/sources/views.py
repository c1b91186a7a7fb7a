"""Bindings of the operator inputs to the driver's test tables.

Each view reshapes a raw table into the schema an operator family expects
(message lists, preference pairs, rollouts, logged log-probabilities, step
labels, judge verdicts). The views only rename/derive columns; the operators
do the work. Every view has a DuckDB twin in ``VIEW_SQL`` so the oracle can
rebuild the same input.

Keys: every view carries ``example_id``; generation groups carry
``group_id``/``sample_no`` (design rule: positions become keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import group_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- msgs
def msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: ``example_id, messages array<struct<role,content>>``.

    A conversation is one example (the reference's row), so its turns are
    gathered into one array; turns are ordered by ``turn``.
    """
    conv = table(spark, sf_dir, "conversations")
    return conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns")
    ).select(
        F.col("conv_id").alias("example_id"),
        F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias(
            "messages"
        ),
    )


MSGS_SQL = """
SELECT conv_id AS example_id,
       list(struct_pack(role := role, content := text) ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id
"""


# ---------------------------------------------------------------- pairs
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implicit-prompt preference pairs (``chosen, rejected`` texts).

    Labelled documents of one ``source``: every good document (quality 1) is
    paired with a poor one, the k-th by ``doc_id`` with the k-th, starting again
    when the poor ones are used up. Ranks inside a source use
    the skew-safe ``group_rank`` (one source may hold a large share of rows).
    """
    docs = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    # rank only the narrow keys; the texts are joined back once per side
    keys = docs.select("doc_id", "source").join(lab, "doc_id")
    ranked = group_rank(keys, ["source", "quality"], ["doc_id"], "k")
    good = ranked.filter("quality = 1").select("source", "k", F.col("doc_id").alias("example_id"))
    poor = ranked.filter("quality = 0").select("source", "k", F.col("doc_id").alias("rejected_doc"))
    n_poor = poor.groupBy("source").agg(F.count(F.lit(1)).alias("n_poor"))
    good = good.join(n_poor, "source").withColumn("k", (F.col("k") - 1) % F.col("n_poor") + 1).drop("n_poor")
    text = docs.select("doc_id", "text")
    pairs_ = good.join(poor, ["source", "k"])
    pairs_ = pairs_.join(text.withColumnRenamed("doc_id", "example_id").withColumnRenamed("text", "chosen"), "example_id")
    pairs_ = pairs_.join(text.withColumnRenamed("doc_id", "rejected_doc").withColumnRenamed("text", "rejected"), "rejected_doc")
    return pairs_.select("example_id", "rejected_doc", "source", "chosen", "rejected")


PAIRS_SQL = """
WITH lab AS (
  SELECT d.doc_id, d.text, d.source, l.quality,
         row_number() OVER (PARTITION BY d.source, l.quality ORDER BY d.doc_id) AS k,
         count(*) FILTER (WHERE l.quality = 0) OVER (PARTITION BY d.source) AS n_poor
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT g.doc_id AS example_id, p.doc_id AS rejected_doc, g.source, g.text AS chosen, p.text AS rejected
FROM lab g JOIN lab p ON g.source = p.source AND g.quality = 1 AND p.quality = 0 AND g.n_poor > 0
  AND p.k = CASE WHEN g.n_poor > 0 THEN (g.k - 1) % g.n_poor + 1 END
"""


# ---------------------------------------------------------------- rollouts / logps
_LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


#: Rows that one task puts in order, at most: a larger table is dealt to more tasks than the
#: session's shuffle partitions, so that a task's memory doesn't grow with it.
TASK_ROWS = 500_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` by hash of ``key``, in parts of some ``TASK_ROWS`` rows, if the session's
    partitions would be larger."""
    n = -(-df.count() // TASK_ROWS)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored completions: one generation group per order, one sample per line.

    ``reward_a`` = quantity, ``reward_b`` = discount or NULL for returned lines
    (a reward function that does not apply), ``step`` = ship year,
    ``completion_len`` / ``truncated`` as logged by a sampler.
    An example's key is its group and sample number, as text, whatever the
    group's size. Group sizes are bounded by the number of generations per
    prompt, so the per-group ``row_number`` is a bounded window.
    """
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    return li.select(
        F.col("l_orderkey").alias("group_id"),
        (F.row_number().over(w) - 1).cast("long").alias("sample_no"),
        F.year("l_shipdate").alias("step"),
        F.col("l_quantity").alias("reward_a"),
        F.when(F.col("l_returnflag") == "R", F.lit(None).cast("double")).otherwise(F.col("l_discount")).alias("reward_b"),
        (F.floor(F.col("l_extendedprice") / 1000).cast("int") + 1).alias("completion_len"),
        (F.col("l_linestatus") == "O").alias("truncated"),
        F.col("l_partkey"),
        F.col("l_tax"),
        F.col("l_discount"),
        F.col("l_quantity"),
        F.col("l_extendedprice"),
    ).withColumn("example_id", F.concat_ws("-", F.col("group_id").cast("string"), F.col("sample_no").cast("string")))


ROLLOUTS_SQL = """
SELECT *, group_id || '-' || sample_no AS example_id FROM (
SELECT l_orderkey AS group_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS sample_no,
       CAST(year(l_shipdate) AS INTEGER) AS step,
       l_quantity AS reward_a,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount END AS reward_b,
       CAST(floor(l_extendedprice / 1000) AS INTEGER) + 1 AS completion_len,
       l_linestatus = 'O' AS truncated,
       l_partkey, l_tax, l_discount, l_quantity, l_extendedprice
FROM lineitem)
"""


def logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged sequence log-probabilities of preference pairs (all <= 0).

    ``c``/``r`` = policy log-prob of chosen/rejected, ``c0``/``r0`` = reference.
    """
    ro = rollouts(spark, sf_dir)
    return ro.select(
        "example_id",
        "group_id",
        "sample_no",
        "step",
        (-F.col("l_quantity") / 10.0).alias("c"),
        (-F.col("l_extendedprice") / 20000.0).alias("r"),
        (-(F.col("l_discount") * 40.0 + 0.5)).alias("c0"),
        (-(F.col("l_tax") * 40.0 + 0.5)).alias("r0"),
        "completion_len",
        (F.col("sample_no") + 1).alias("rejected_len"),
    )


LOGPS_SQL = f"""
SELECT example_id, group_id, sample_no, step,
       -l_quantity / 10.0 AS c, -l_extendedprice / 20000.0 AS r,
       -(l_discount * 40.0 + 0.5) AS c0, -(l_tax * 40.0 + 0.5) AS r0,
       completion_len, sample_no + 1 AS rejected_len
FROM ({ROLLOUTS_SQL}) ro
"""


# ---------------------------------------------------------------- token-level rollouts
def rtokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-token logged values of each rollout: sampler (``old_logps``),
    reference (``ref_logps``) and current policy (``logps``) log-probs,
    entropies, value estimates and the completion mask (the last token of a
    truncated completion is masked). Lengths are ``sample_no + 3``."""
    return token_lists(rollouts(spark, sf_dir))


def token_lists(ro: DataFrame, *carry: str) -> DataFrame:
    """``rtokens`` of given rollouts, with their columns ``carry``."""
    n = F.col("sample_no") + 3
    idx = F.sequence(F.lit(0), n - 1)
    tax, disc, qty = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    return ro.select(
        "example_id", "group_id", "sample_no", "step", "reward_a", "reward_b", "truncated", *carry,
        F.transform(idx, lambda i: -(tax + F.lit(0.01) * i)).alias("old_logps"),
        F.transform(idx, lambda i: -(disc + F.lit(0.015) * i)).alias("ref_logps"),
        F.transform(idx, lambda i: -(tax * F.lit(1.2) + F.lit(0.011) * i)).alias("logps"),
        F.transform(idx, lambda i: disc * F.lit(10.0) + F.lit(0.05) * i).alias("entropies"),
        F.transform(idx, lambda i: qty / F.lit(50.0) - F.lit(0.02) * i).alias("values"),
        F.transform(idx, lambda i: F.when(F.col("truncated") & (i == n - 1), F.lit(0)).otherwise(F.lit(1))).alias("mask"),
    )


RTOKENS_SQL = f"""
SELECT example_id, group_id, sample_no, step, reward_a, reward_b, truncated,
       list_transform(range(sample_no + 3), lambda i: -(l_tax + 0.01::DOUBLE * i)) AS old_logps,
       list_transform(range(sample_no + 3), lambda i: -(l_discount + 0.015::DOUBLE * i)) AS ref_logps,
       list_transform(range(sample_no + 3), lambda i: -(l_tax * 1.2::DOUBLE + 0.011::DOUBLE * i)) AS logps,
       list_transform(range(sample_no + 3), lambda i: l_discount * 10.0::DOUBLE + 0.05::DOUBLE * i) AS entropies,
       list_transform(range(sample_no + 3), lambda i: l_quantity / 50.0::DOUBLE - 0.02::DOUBLE * i) AS "values",
       list_transform(range(sample_no + 3), lambda i: CASE WHEN truncated AND i = sample_no + 2 THEN 0 ELSE 1 END) AS mask
FROM ({ROLLOUTS_SQL}) ro
"""


# ---------------------------------------------------------------- steps
def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stepwise supervision: per order, its lines in total order are the steps.

    ``prompt`` = order priority, step text = ``partkey:quantity``, label =
    line not returned.
    """
    ro = rollouts(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"), "o_orderpriority")
    lines = ro.select(
        "group_id",
        "sample_no",
        F.concat(F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_quantity").cast("long").cast("string")).alias(
            "step_text"
        ),
        F.col("reward_b").isNotNull().alias("label"),
    )
    agg = lines.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("sample_no", "step_text", "label"))).alias("_s"))
    return agg.join(orders, "group_id").select(
        F.col("group_id").alias("example_id"),
        F.col("o_orderpriority").alias("prompt"),
        F.transform("_s", lambda s: s["step_text"]).alias("completions"),
        F.transform("_s", lambda s: s["label"]).alias("labels"),
    )


STEPS_SQL = f"""
SELECT ro.group_id AS example_id, o.o_orderpriority AS prompt,
       list(CAST(ro.l_partkey AS VARCHAR) || ':' || CAST(CAST(ro.l_quantity AS BIGINT) AS VARCHAR) ORDER BY ro.sample_no) AS completions,
       list(ro.reward_b IS NOT NULL ORDER BY ro.sample_no) AS labels
FROM ({ROLLOUTS_SQL}) ro JOIN orders o ON o.o_orderkey = ro.group_id
GROUP BY ro.group_id, o.o_orderpriority
"""


# ---------------------------------------------------------------- verdicts
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies per comparison (one event = one comparison).

    Three judges: ``judge_a`` from the value band, ``judge_b`` from the event
    type, ``judge_c`` from the value parity; raw reply strings for parsing;
    two scores for the soft judge.
    """
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    return ev.select(
        F.col("event_id").alias("example_id"),
        F.col("user_id").alias("prompt_id"),
        F.dayofmonth("ts").alias("step"),
        F.when(v < 2, -1).when(v >= 35, 1).otherwise(0).alias("judge_a"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type") == "error", -1).otherwise(0).alias("judge_b"),
        F.when(F.floor(v) % 2 == 0, 1).otherwise(0).alias("judge_c"),
        F.when(v < 2, F.lit("n/a")).when(v >= 35, F.lit("1")).otherwise(F.lit("0")).alias("reply"),
        (v / 100.0).alias("score_0"),
        (F.col("user_id") / 100.0).alias("score_1"),
    )


VERDICTS_SQL = """
SELECT event_id AS example_id, user_id AS prompt_id, CAST(dayofmonth(ts) AS INTEGER) AS step,
       CASE WHEN value < 2 THEN -1 WHEN value >= 35 THEN 1 ELSE 0 END AS judge_a,
       CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS judge_b,
       CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS judge_c,
       CASE WHEN value < 2 THEN 'n/a' WHEN value >= 35 THEN '1' ELSE '0' END AS reply,
       value / 100.0 AS score_0, user_id / 100.0 AS score_1
FROM events
"""


# ---------------------------------------------------------------- completions
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt/completion texts from conversations: each assistant turn is a
    completion of the turn before it. Some completions carry a reasoning
    block (closed, or left open) so format rewards see every case."""
    conv = table(spark, sf_dir, "conversations")
    prev = conv.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"), F.col("role").alias("prev_role")
    )
    a = conv.filter(F.col("role") == "assistant").join(prev, ["conv_id", "turn"])
    kind = (F.col("conv_id") + F.col("turn")) % 3
    text = F.when(kind == 0, F.concat(F.lit("<think>"), F.col("prompt"), F.lit("</think>"), F.col("text"))).when(
        kind == 1, F.concat(F.lit("<think>"), F.col("text"))
    ).otherwise(F.col("text"))
    return a.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("example_id"),
        F.col("conv_id").alias("group_id"),
        "prompt",
        text.alias("completion"),
        F.col("text").alias("solution"),
    )


COMPLETIONS_SQL = """
SELECT a.conv_id || '-' || a.turn AS example_id, a.conv_id AS group_id, p.text AS prompt,
       CASE WHEN (a.conv_id + a.turn) % 3 = 0 THEN '<think>' || p.text || '</think>' || a.text
            WHEN (a.conv_id + a.turn) % 3 = 1 THEN '<think>' || a.text
            ELSE a.text END AS completion,
       a.text AS solution
FROM conversations a JOIN conversations p ON p.conv_id = a.conv_id AND p.turn + 1 = a.turn
WHERE a.role = 'assistant'
"""


VIEW_SQL = {
    "msgs": MSGS_SQL,
    "pairs": PAIRS_SQL,
    "rollouts": ROLLOUTS_SQL,
    "logps": LOGPS_SQL,
    "steps": STEPS_SQL,
    "verdicts": VERDICTS_SQL,
    "completions": COMPLETIONS_SQL,
    "rtokens": RTOKENS_SQL,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the DuckDB CTEs of the named views."""
    return build_sql(names, [], sql)


def build_sql(names, ctes, select: str) -> str:
    """``WITH <views>, <ctes> <select>``; ``ctes`` is a list of (name, sql)."""
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + select
