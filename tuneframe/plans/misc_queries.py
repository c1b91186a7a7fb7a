"""Sampling, replay-buffer and source/sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay as rp
from ..operators import rollouts as ro
from ..operators import sampling as sm
from ..sources import readers as rd
from ..sources import literals as lt
from ..sources import views as vw
from ..sources.views import build_sql, with_views
from .catalog import register
from .rollout_queries import _SCORED_CTE, _scored


# ---------------------------------------------------------------- sampling
@register("split_fraction", with_views(
    f"SELECT CASE WHEN {sm.uniform_sql('example_id', 42)} < 0.1 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM rollouts GROUP BY 1", "rollouts"))
def split_fraction(spark, d):
    """L1: seeded ~10 % test split by hash threshold; tests check stability and
    the share."""
    c = vw.rollouts(spark, d).select("example_id")
    return sm.split_fraction(c, "example_id", 0.1, seed=42).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("split_train_size", with_views(
    "SELECT 'train' AS split, CAST(least(count(*), 4992) AS BIGINT) AS n FROM rollouts "
    "UNION ALL SELECT 'test', CAST(count(*) - least(count(*), 4992) AS BIGINT) FROM rollouts HAVING count(*) > 4992", "rollouts"))
def split_train_size(spark, d):
    """L1: exactly 4992 training rows (or all rows when fewer), the rest test."""
    c = vw.rollouts(spark, d).select("example_id")
    return sm.split_count(c, "example_id", 4992, seed=42).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("repeat_sampler", with_views(
    """SELECT example_id, CAST(i // 4 AS BIGINT) AS chunk, CAST((i // 4) * 24 + rr * 8 + (i % 4) * 2 + mm AS BIGINT) AS position
       FROM (SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS i, count(*) OVER () AS n FROM completions) r,
            range(3) t(rr), range(2) u(mm)
       WHERE i < (n // 4) * 4""", "completions"))
def repeat_sampler(spark, d):
    """L2: chunks of 4 prompts in key order, each chunk 3 times, each prompt
    twice in a row (no shuffle, so the order is checkable)."""
    c = vw.completions(spark, d).select("example_id")
    s = sm.repeat_sampler(c, "example_id", mini_repeat_count=2, batch_size=4, repeat_count=3, shuffle=False)
    return s.select("example_id", F.col("chunk").cast("long").alias("chunk"), "position")


@register("repeat_sampler_shuffled", with_views(
    """SELECT CAST(c AS BIGINT) AS chunk, CAST(64 AS BIGINT) AS n_items, CAST(8 AS BIGINT) AS n_prompts,
              CAST(c * 64 AS BIGINT) AS first_position, CAST(c * 64 + 63 AS BIGINT) AS last_position
       FROM range((SELECT count(*) // 8 FROM completions)) t(c)""", "completions"))
def repeat_sampler_shuffled(spark, d):
    """L2 with the seeded shuffle (B=8, m=4, R=2): which prompts land in a
    chunk is hash-seeded, the structure is not - every full chunk holds 8
    distinct prompts and 64 consecutive positions."""
    c = vw.completions(spark, d).select("example_id")
    s = sm.repeat_sampler(c, "example_id", mini_repeat_count=4, batch_size=8, repeat_count=2, shuffle=True, seed=3)
    return s.groupBy(F.col("chunk").cast("long").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("example_id").alias("n_prompts"),
        F.min("position").alias("first_position"), F.max("position").alias("last_position"),
    )


@register("split_chunks", with_views(
    """SELECT example_id, CAST((rk - 1) // (n // 7) AS INTEGER) AS chunk FROM
       (SELECT example_id, row_number() OVER (ORDER BY example_id) AS rk, count(*) OVER () AS n FROM completions)
       WHERE n // 7 > 0 AND rk <= (n // 7) * 7""", "completions"))
def split_chunks(spark, d):
    """L4: seven equal chunks in key order (leftover rows in no chunk)."""
    c = vw.completions(spark, d).select("example_id")
    return sm.split_chunks(c, "example_id", 7)


def _replay_scores(spark, d):
    adv = ro.group_advantages(_scored(spark, d), scale="group")
    return rp.group_replay_scores(adv)


_BUFFER_CTES = [
    _SCORED_CTE,
    ("g", "SELECT group_id, avg(reward) AS gm, stddev_samp(reward) AS gs FROM scored GROUP BY group_id"),
    ("a", "SELECT group_id, step, (reward - gm) / (gs + 1e-4) AS adv, gs FROM scored JOIN g USING (group_id)"),
    ("sc", "SELECT group_id, sum(abs(adv)) * first(gs) AS score, min(step) AS arrival FROM a WHERE gs > 0 GROUP BY group_id"),
    ("buf", "SELECT group_id, score, arrival FROM sc ORDER BY score DESC, arrival, group_id LIMIT 64"),
]


@register("replay_buffer", build_sql(["rollouts"], _BUFFER_CTES, "SELECT * FROM buf"))
def replay_buffer(spark, d):
    """A 64-group replay buffer fed with every group that has reward variance."""
    buf = rp.buffer_add(_replay_scores(spark, d), 64)
    return buf.select("group_id", "score", "arrival")


@register("replay_sample", build_sql(["rollouts"], _BUFFER_CTES,
    f"SELECT group_id, score FROM buf ORDER BY -ln({sm.uniform_sql('group_id', 5)}) / score, group_id LIMIT 16"))
def replay_sample(spark, d):
    """16 groups drawn from the buffer with probability ∝ score (no replacement)."""
    buf = rp.buffer_add(_replay_scores(spark, d), 64)
    return rp.sample_buffer(buf, 16, seed=5).select("group_id", "score")


@register("replay_fill", build_sql(["rollouts"], _BUFFER_CTES + [
    ("cum", "SELECT group_id, sum(score) OVER (ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM buf"),
    ("todo", "SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS draw FROM g WHERE coalesce(gs, 0) <= 0")],
    f"""SELECT todo.group_id, min(cum.group_id) AS replacement_group_id
        FROM todo JOIN cum ON cum.c > {sm.uniform_sql('draw', 9)} * (SELECT max(c) FROM cum) GROUP BY todo.group_id"""))
def replay_fill(spark, d):
    """Every zero-variance group gets a replacement drawn from the buffer
    with replacement."""
    sc = _replay_scores(spark, d)
    buf = rp.buffer_add(sc, 64)
    return rp.replace_zero_variance(sc, buf, seed=9)


@register("replay_rollouts", build_sql(["rollouts"], _BUFFER_CTES + [
    ("cum", "SELECT group_id, sum(score) OVER (ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM buf"),
    ("todo", "SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS draw FROM g WHERE coalesce(gs, 0) <= 0"),
    ("pick", f"""SELECT todo.group_id, min(cum.group_id) AS source_group_id
        FROM todo JOIN cum ON cum.c > {sm.uniform_sql('draw', 9)} * (SELECT max(c) FROM cum) GROUP BY todo.group_id""")],
    """SELECT group_id, source_group_id, sample_no, reward FROM pick JOIN (SELECT group_id AS source_group_id, sample_no, reward FROM scored) USING (source_group_id)
       UNION ALL SELECT group_id, group_id, sample_no, reward FROM scored WHERE group_id NOT IN (SELECT group_id FROM pick)"""))
def replay_rollouts(spark, d):
    """The rollouts of a step with its zero-variance groups replaced by those that the
    buffer's draws give."""
    rows = _scored(spark, d).select("group_id", "sample_no", "reward")
    sc = _replay_scores(spark, d)
    buf = rp.buffer_add(sc, 64).select("group_id", "score").checkpoint()
    stored = rows.join(buf.select("group_id"), "group_id", "left_semi")
    return rp.replace_rollouts(rows, stored, sc, buf, seed=9)


@register("embedding_sample", f"SELECT vec_id, label FROM embeddings ORDER BY -ln({sm.uniform_sql('vec_id', 1)}), vec_id LIMIT 512")
def embedding_sample(spark, d):
    """512 embedding rows drawn uniformly without replacement (hash-seeded)."""
    e = vw.table(spark, d, "embeddings").select("vec_id", "label").withColumn("w", F.lit(1.0))
    return sm.weighted_sample(e, 512, "w", "vec_id", seed=1).select("vec_id", "label")


@register("embedding_draws", f"""
SELECT draw, vec_id, label FROM (
  SELECT i AS draw, CAST(floor({sm.uniform_sql('i', 1)} * n) AS BIGINT) AS pos
  FROM range(512) t(i), (SELECT count(*) AS n FROM embeddings) WHERE i < n)
JOIN (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, label) - 1 AS pos FROM embeddings) USING (pos)""")
def embedding_draws(spark, d):
    """Up to 512 embedding rows drawn uniformly with replacement (hash-seeded)."""
    e = vw.table(spark, d, "embeddings").select("vec_id", "label")
    return sm.uniform_draws(e, 512, ["vec_id", "label"], seed=1).select("draw", "vec_id", "label")


# ---------------------------------------------------------------- sources / sinks
@register("mixture_prompts", build_sql(["completions", "steps"], [],
    "SELECT 'completions' AS source, prompt FROM completions UNION ALL SELECT 'steps', prompt FROM steps"))
def mixture_prompts(spark, d):
    """Two datasets concatenated, only ``prompt`` kept (plus its source)."""
    a = vw.completions(spark, d).select(F.lit("completions").alias("source"), "prompt")
    b = vw.steps(spark, d).select(F.lit("steps").alias("source"), "prompt")
    return rd.mixture([a, b], ["source", "prompt"])


@register("slice_percent", with_views(
    "SELECT example_id, prompt FROM (SELECT example_id, prompt, row_number() OVER (ORDER BY example_id) AS rk, count(*) OVER () AS n "
    "FROM completions) WHERE rk <= floor(n * 0.5)", "completions"))
def slice_percent(spark, d):
    """``train[:50%]`` - the first half of the rows by key."""
    c = vw.completions(spark, d).select("example_id", "prompt")
    return rd.slice_fraction(c, ["example_id"], 0.5)


@register("parse_literal_messages", """
SELECT conv_id AS example_id, CAST(count(*) AS INTEGER) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM conversations GROUP BY conv_id""")
def parse_literal_messages(spark, d):
    """S6 + P3: conversations stored as a Python-literal string (single-quoted
    keys) are parsed back into message lists."""
    conv = vw.table(spark, d, "conversations")
    item = F.concat(F.lit("{'from': '"), F.col("role"), F.lit("', 'value': "), F.to_json(F.struct(F.col("text").alias("v")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.lit(1 << 30)))
    # to_json gives {"v":"..."}; the substring keeps the quoted value and the closing brace
    lit = conv.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("s")))), lambda x: x["s"]), ", ").alias("_s"))
    lit = lit.select("conv_id", F.concat(F.lit("["), F.col("_s"), F.lit("]")).alias("literal"))
    parsed = lit.select("conv_id", rd.parse_message_literal("literal").alias("conversations"))
    return parsed.select(
        F.col("conv_id").alias("example_id"),
        F.size("conversations").alias("n_messages"),
        F.when(F.exists("conversations", lambda m: m["value"].isNotNull()), F.aggregate(
            F.transform("conversations", lambda m: F.coalesce(F.length(m["value"]), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_chars"),
    )


@register("split_write_read", with_views(
    "SELECT CASE WHEN group_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n, "
    "CAST(sum(length(prompt)) AS BIGINT) AS chars FROM completions GROUP BY 1", "completions"))
def split_write_read(spark, d):
    """S7 + S1: write a split-partitioned table to shared storage and read
    each split back with a pruned column list."""
    c = vw.completions(spark, d).select("example_id", "group_id", "prompt", "completion")
    c = c.withColumn("split", F.when(F.col("group_id") % 5 == 0, F.lit("test")).otherwise(F.lit("train"))).drop("group_id")
    path = rd.write_splits(c, rd.scratch_path(spark, "splits"))
    parts = [rd.read(spark, path, columns=["example_id", "prompt"], split=s).withColumn("split", F.lit(s)) for s in ("train", "test")]
    m = rd.mixture(parts)
    return m.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("prompt")).alias("chars"))


@register("jsonl_splits", with_views(
    "SELECT CASE WHEN group_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, example_id, CAST(length(completion) AS INTEGER) AS n_chars FROM completions",
    "completions"))
def jsonl_splits(spark, d):
    """JSON-lines files per split read with a declared schema."""
    c = vw.completions(spark, d).select("example_id", "group_id", "completion")
    base = rd.scratch_path(spark, "jsonl")
    c.filter(F.col("group_id") % 2 == 0).drop("group_id").write.json(f"{base}/train")
    c.filter(F.col("group_id") % 2 == 1).drop("group_id").write.json(f"{base}/test")
    j = rd.read_jsonl(spark, {"train": f"{base}/train", "test": f"{base}/test"}, "example_id string, completion string")
    return j.select("split", "example_id", F.length("completion").alias("n_chars"))


@register("completion_log_unique", with_views(
    """SELECT prompt, arg_min(example_id, (step, example_id)) AS example_id, arg_min(reward_a, (step, example_id)) AS reward_a,
              CAST(min(step) AS INTEGER) AS step
       FROM (SELECT CAST(l_partkey AS VARCHAR) AS prompt, example_id, reward_a, step FROM rollouts) GROUP BY prompt""", "rollouts"))
def completion_log_unique(spark, d):
    """S8 + S9: append completion records to a step-partitioned log, read it
    back and keep each prompt's first record."""
    r = vw.rollouts(spark, d).select(F.col("l_partkey").cast("string").alias("prompt"), "example_id", "reward_a", "step")
    path = rd.log_completions(r, rd.scratch_path(spark, "completions_log"))
    logged = rd.read(spark, path)
    u = rd.unique_prompts(logged, "prompt", ("step", "example_id"))
    return u.select("prompt", "example_id", "reward_a", F.col("step").cast("int").alias("step"))


@register("read_message_literals", """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, role, md5(text) AS digest, false AS rejected
FROM conversations WHERE conv_id % 10 <> 7
UNION ALL SELECT conv_id, NULL, NULL, NULL, true FROM conversations WHERE conv_id % 10 = 7 GROUP BY conv_id""")
def read_message_literals(spark, d):
    """Conversations written as tuples of mappings, texts as two neighbouring strings,
    one raw or with escapes, and read back; every tenth lacks its last bracket."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    m = vw.msgs(spark, d)
    half = lambda t, k: F.substr(t, F.lit(1), F.lit(20)) if k == 0 else F.substr(t, F.lit(21), F.length(t))
    one = lambda x: F.concat(
        F.lit("{'from': u'"), esc(x["role"]), F.lit("', 'value': '"), esc(half(x["content"], 0)), F.lit("'  # first part\n '"), esc(half(x["content"], 1)), F.lit("', 'n': (1, None)},"))
    text = F.concat(F.lit("("), F.array_join(F.transform("messages", one), " "), F.when(F.col("example_id") % 10 == 7, F.lit("")).otherwise(F.lit(")")))
    read = lt.read_message_literals(m.select(F.col("example_id").alias("conv_id"), text.alias("text")), "text")
    return read.select("conv_id", F.col("reject_reason").isNotNull().alias("rejected"), F.posexplode_outer("messages").alias("position", "m")).select(
        "conv_id", "position", F.col("m.from").alias("role"), F.md5("m.value").alias("digest"), "rejected")
