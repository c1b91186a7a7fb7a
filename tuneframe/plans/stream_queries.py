"""Streaming queries (ST1-ST6): each stages a test table as files, replays it
as a file stream in several micro-batches and returns the streamed result
(equal to the batch result, which the oracle computes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversions as cv
from ..sources import views as vw
from ..sources.readers import scratch_path
from ..sources.views import build_sql, with_views
from ..streaming import jobs as st
from ..streaming import stateful as sf
from .catalog import register
from .misc_queries import _replay_scores
from .prep_queries import _pe_sql
from .rollout_queries import _SCORED_CTE


def _events_stream(spark, d):
    ev = vw.table(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    path = st.stage_files(ev, "events-stream", "day")
    return st.stream_source(spark, path, ev.schema, max_files=7)


@register("stream_running_moments", """
SELECT event_type, CAST(count(value) AS BIGINT) AS count, avg(value) AS mean, var_pop(value) AS var, stddev_samp(value) AS std
FROM events GROUP BY event_type""")
def stream_running_moments(spark, d):
    """ST1 (S3 file stream): running moments of the event value per type, as a stream."""
    s = _events_stream(spark, d)
    return st.run_complete(st.running_moments_stream(s, "value", "event_type"), "moments")


@register("stream_token_counter", with_views(
    "SELECT CAST(sum(completion_len) AS BIGINT) AS num_tokens, CAST(count(*) AS BIGINT) AS rows FROM rollouts", "rollouts"))
def stream_token_counter(spark, d):
    """ST2: cumulative completion-token counter over a rollout stream."""
    r = vw.rollouts(spark, d).select("example_id", "step", "completion_len")
    path = st.stage_files(r, "rollout-tokens", "step")
    s = st.stream_source(spark, path, r.schema, max_files=2)
    return st.run_complete(st.token_counter_stream(s, "completion_len"), "tokens")


@register("stream_interval_means", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, avg(value) AS mean, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1, 2, 3""")
def stream_interval_means(spark, d):
    """ST3: daily mean per event type with an event-time watermark."""
    s = _events_stream(spark, d)
    agg = st.interval_means_stream(s, "ts", "event_type", "value", "1 day", "400 days")
    res = st.run_complete(agg, "intervals")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return res.select(
        F.date_format("window_start", fmt).alias("window_start"), F.date_format("window_end", fmt).alias("window_end"),
        "event_type", "mean", "n",
    )


@register("stream_group_advantages", with_views(
    """SELECT group_id, sample_no, reward_a AS reward, (reward_a - m) / (s + 1e-4) AS advantage, true AS complete
       FROM rollouts JOIN (SELECT group_id, avg(reward_a) AS m, stddev_samp(reward_a) AS s FROM rollouts GROUP BY group_id) USING (group_id)""",
    "rollouts"))
def stream_group_advantages(spark, d):
    """ST4: group advantages emitted once every sample of a group arrived."""
    r = vw.rollouts(spark, d)
    size = r.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    r = r.join(size, "group_id").select(
        "group_id", "sample_no", F.col("reward_a").alias("reward"), "group_size", "step",
        F.to_timestamp(F.concat(F.col("step").cast("string"), F.lit("-01-01"))).alias("ts"),
    )
    path = st.stage_files(r, "rollout-groups", "step")
    s = st.stream_source(spark, path, r.schema, max_files=4)
    out = st.run_append(st.group_advantages_stream(s, "group_size", watermark="3650 days"), "groups")
    return out


@register("stream_unpair", _pe_sql(
    "SELECT example_id, prompt, chosen AS completion, true AS label, 0 AS pair_side FROM pe "
    "UNION ALL SELECT example_id, prompt, rejected, false, 1 FROM pe"))
def stream_unpair(spark, d):
    """ST5: prompt extraction and unpairing applied unchanged to a stream of pairs."""
    p = vw.pairs(spark, d).select("example_id", "chosen", "rejected", "source")
    path = st.stage_files(p, "pairs-stream", "source")
    s = st.stream_source(spark, path, p.schema, max_files=5).drop("source")
    return st.run_append(cv.unpair(cv.extract_prompt(s)), "unpair")


@register("stream_replay_buffer", build_sql(["rollouts"], [
    _SCORED_CTE,
    ("g", "SELECT group_id, avg(reward) AS gm, stddev_samp(reward) AS gs FROM scored GROUP BY group_id"),
    ("a", "SELECT group_id, step, (reward - gm) / (gs + 1e-4) AS adv, gs FROM scored JOIN g USING (group_id)"),
    ("sc", "SELECT group_id, sum(abs(adv)) * first(gs) AS score, min(step) AS arrival FROM a WHERE gs > 0 GROUP BY group_id")],
    "SELECT group_id, score, CAST(arrival AS BIGINT) AS arrival FROM sc ORDER BY score DESC, arrival, group_id LIMIT 64"))
def stream_replay_buffer(spark, d):
    """ST6: bounded replay buffer (64 groups) kept as streaming state over
    hash buckets of scored groups arriving step by step."""
    sc = _replay_scores(spark, d).filter("has_variance").select("group_id", "score", F.col("arrival").cast("long").alias("arrival"))
    path = st.stage_files(sc, "replay-stream", "arrival")
    s = st.stream_source(spark, path, sc.schema, max_files=4)
    versions = st.run_append(st.replay_buffer_stream(s, 64), "replay")
    return st.current_buffer(versions, 64)


@register("stream_completion_log", with_views(
    "SELECT CAST(step AS INTEGER) AS step, CAST(count(*) AS BIGINT) AS n, avg(reward_a) AS mean_reward FROM rollouts GROUP BY step", "rollouts"))
def stream_completion_log(spark, d):
    """S8 (stream form): a stream of scored completions appended to a
    step-partitioned log by an exactly-once file sink, read back per step."""
    from ..sources import readers as rd

    r = vw.rollouts(spark, d).select("example_id", "step", "reward_a")
    path = st.stage_files(r, "completion-stream", "step")
    s = st.stream_source(spark, path, r.schema, max_files=4)
    out, ckpt = rd.scratch_path(spark, "completion-log"), rd.scratch_path(spark, "completion-log-ckpt")
    q = rd.log_completions_stream(s, out, ckpt)
    q.processAllAvailable()
    q.stop()
    logged = rd.read(spark, out)
    return logged.groupBy(F.col("step").cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.avg("reward_a").alias("mean_reward"))


# ---------------------------------------------------------------- late rows, time-outs, restarts
_DAY = 86_400_000
#: In these replays a quarter of the time span arrives at once; some rows arrive a quarter late.
_ARRIVALS = 4


def _staged(df, name):
    """``df`` from a file: the arrivals are read from there, the joins and windows before them run once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _arrivals(df, at, delayed):
    """One frame for each quarter of the span of ``at`` (ms), with ``beat`` false; rows
    with ``delayed`` come one quarter later (those of the last one don't)."""
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    quarter = F.expr(f"({at} - {lo or 0}L) * {_ARRIVALS} div {(hi or 0) - (lo or 0) + 1}L")
    df = df.withColumn("_k", F.least(quarter + F.when(delayed, 1).otherwise(0), F.lit(_ARRIVALS - 1))).withColumn("beat", F.lit(False))
    return [df.where(F.col("_k") == k).drop("_k", at) for k in range(_ARRIVALS)], hi or 0


def _heartbeat(like, ts, ms):
    """A row of the same schema that only moves the watermark to ``ms``."""
    row = [(F.timestamp_millis(F.lit(ms)) if c == ts else F.lit(True) if c == "beat" else F.lit(None)).cast(t).alias(c) for c, t in like.dtypes]
    return like.sparkSession.range(1).select(*row)


def _arrival_sql(table, ms, delayed, extra=""):
    """CTEs ``a`` (rows with their arrival k, ms) and ``w`` (watermark wm at arrival k)."""
    return [
        ("b", f"SELECT min({ms}) AS lo, max({ms}) AS hi FROM {table}"),
        ("a", f"SELECT t.*, {ms} AS ms, least(({ms} - lo) * {_ARRIVALS} // (hi - lo + 1) + CASE WHEN {delayed} THEN 1 ELSE 0 END, {_ARRIVALS - 1}) AS k FROM {table} t, b"),
        ("w", f"SELECT k + 1 AS k, max(max(ms)) OVER (ORDER BY k) {extra} AS wm FROM a GROUP BY k"),
    ]


@register("stream_interval_late", build_sql([], [
    *_arrival_sql("events", "epoch_ms(ts)", "event_id % 40 = 0", f"- {2 * _DAY}"),
    ("l", f"SELECT a.*, date_trunc('day', ts) AS d, coalesce(epoch_ms(date_trunc('day', ts)) + {_DAY} <= wm, false) AS late FROM a LEFT JOIN w USING (k)")],
    """SELECT CASE WHEN late THEN 'late' ELSE 'mean' END AS kind, strftime(d, '%Y-%m-%d') AS window_start, event_type,
              CAST(count(*) AS BIGINT) AS n, avg(value) AS mean FROM l GROUP BY ALL"""))
def stream_interval_late(spark, d):
    """ST3: daily means per event type with a watermark of two days. The events come in
    four arrivals, every 40th one arrival late; each arrival restarts the stream. A row
    whose day was closed is not in the means but among the late rows."""
    ev = vw.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    frames, last = _arrivals(ev.withColumn("_ms", F.unix_millis("ts")), "_ms", F.col("event_id") % 40 == 0)
    frames.append(_heartbeat(frames[0], "ts", last + 4 * _DAY))
    out, ckpt = scratch_path(spark, "intervals-late"), scratch_path(spark, "intervals-late-ckpt")
    sf.replay(frames, lambda s: st.advance(sf.interval_means(s, "ts", "event_type", "value", _DAY, "2 days", heartbeat="beat"), out, ckpt), "intervals")
    table = spark.read.parquet(out)
    late = sf.late_rows(table).groupBy("window_start", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    both = sf.closed_intervals(table).withColumn("kind", F.lit("mean")).unionByName(late.withColumn("kind", F.lit("late")))
    return both.select("kind", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), F.col("metric").alias("event_type"), "n", "mean")


_GROUP_WAIT, _GROUP_DELAY = 20 * _DAY, 30 * _DAY


def _group_rows(spark, d):
    li = vw.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    size = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("group_size"))
    od = vw.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    ts = F.timestamp_millis(F.unix_millis("o_orderdate") + F.col("l_linenumber") * _DAY)
    return li.join(size, "l_orderkey").join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").cast("long").alias("sample_no"), F.col("l_quantity").alias("reward"), "group_size", ts.alias("ts"))


def _group_sql() -> str:
    ctes = [("g", f"""SELECT l_orderkey AS group_id, CAST(l_linenumber AS BIGINT) AS sample_no, l_quantity AS reward, group_size,
                epoch_ms(CAST(o_orderdate AS TIMESTAMP)) + l_linenumber * {_DAY} AS arrived
                FROM lineitem JOIN (SELECT l_orderkey, count(*) AS group_size FROM lineitem GROUP BY 1) USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey"""),
            *_arrival_sql("g", "arrived", "group_id % 20 = 0 AND sample_no = 1", f"- {_GROUP_DELAY}"),
            ("r", "SELECT a.*, coalesce(ms < wm, false) AS late FROM a LEFT JOIN w USING (k)")]
    parts = ["SELECT group_id, sample_no, reward, 'late' AS kind, 0 AS batch FROM r WHERE late"]
    rows = "group_id, sample_no, reward, group_size, ms"
    for k in range(_ARRIVALS):
        held = f"UNION ALL SELECT {rows} FROM o{k - 1}" if k else ""
        closing = f"(SELECT max(wm) FROM w WHERE k = {k + 1})" if k < _ARRIVALS - 1 else "9223372036854775807"
        ctes += [
            (f"h{k}", f"SELECT {rows} FROM r WHERE k = {k} AND NOT late {held}"),
            (f"s{k}", f"""SELECT *, CASE WHEN count(*) OVER p >= max(group_size) OVER p THEN 'complete'
                WHEN max(ms) OVER p + {_GROUP_WAIT} <= {closing} THEN 'timed_out' ELSE 'open' END AS kind FROM h{k} WINDOW p AS (PARTITION BY group_id)"""),
            (f"o{k}", f"SELECT {rows} FROM s{k} WHERE kind = 'open'"),
        ]
        parts.append(f"SELECT group_id, sample_no, reward, kind, {k} FROM s{k} WHERE kind <> 'open'")
    ctes.append(("f", " UNION ALL ".join(parts)))
    return build_sql([], ctes, """SELECT group_id, sample_no, reward, kind,
        CASE WHEN kind <> 'late' THEN (reward - avg(reward) OVER q) / (stddev_samp(reward) OVER q + 1e-4) END AS advantage
        FROM f WINDOW q AS (PARTITION BY group_id, kind, batch)""")


@register("stream_group_timeouts", _group_sql())
def stream_group_timeouts(spark, d):
    """ST4: an order's lines as a group, one line a day, with a watermark of 30 days and a
    time-out of 20. The first line of every 20th order comes one of the four arrivals late:
    its group times out without it, and the line is late."""
    rows = _staged(_group_rows(spark, d).withColumn("_ms", F.unix_millis("ts")), "group-rows")
    frames, last = _arrivals(rows, "_ms", (F.col("group_id") % 20 == 0) & (F.col("sample_no") == 1))
    frames.append(_heartbeat(frames[0], "ts", last + _GROUP_WAIT + _GROUP_DELAY + _DAY).fillna({"group_id": -1}))
    out, ckpt = scratch_path(spark, "group-timeouts"), scratch_path(spark, "group-timeouts-ckpt")
    sf.replay(frames, lambda s: st.advance(sf.group_advantages(s, "group_size", "ts", "30 days", _GROUP_WAIT, heartbeat="beat"), out, ckpt), "groups")
    return spark.read.parquet(out)


@register("stream_unique_prompts", with_views(
    """SELECT prompt, arg_min(example_id, (step, example_id)) AS example_id, arg_min(reward_a, (step, example_id)) AS reward_a,
              CAST(min(step) AS INTEGER) AS step
       FROM (SELECT CAST(l_partkey AS VARCHAR) AS prompt, example_id, reward_a, step FROM rollouts) GROUP BY prompt""", "rollouts"))
def stream_unique_prompts(spark, d):
    """S9 on a stream: the first record of each prompt of a log that grows year by year,
    over restarts, equal to the batch operator."""
    r = vw.rollouts(spark, d).select(F.col("l_partkey").cast("string").alias("prompt"), "example_id", "reward_a", F.col("step").cast("int").alias("step"))
    r = r.withColumn("ts", F.to_timestamp(F.format_string("%d-01-01", "step"))).withColumn("_ms", F.unix_millis("ts"))
    frames, _ = _arrivals(_staged(r, "prompt-rows"), "_ms", F.lit(False))
    out, ckpt = scratch_path(spark, "unique-prompts"), scratch_path(spark, "unique-prompts-ckpt")
    sf.replay([f.drop("beat") for f in frames], lambda s: st.advance(sf.unique_prompts(s, "prompt", ("step", "example_id"), "ts", "366 days", 20 * 366 * _DAY), out, ckpt), "prompts")
    return spark.read.parquet(out).drop("ts")


@register("stream_batch_moments", build_sql([], [
    *_arrival_sql("events", "epoch_ms(ts)", "false"),
    ("n", """SELECT k, event_type, count(value) AS batch_n, avg(value) AS batch_mean, stddev_samp(value) AS batch_std FROM a GROUP BY ALL"""),
    ("r", """SELECT n.k, event_type, count(value) AS count, avg(value) AS mean, var_pop(value) AS var, stddev_samp(value) AS std
             FROM (SELECT DISTINCT k FROM a) n JOIN a ON a.k <= n.k GROUP BY ALL""")],
    """SELECT CAST(k AS BIGINT) AS batch, event_type, CAST(coalesce(batch_n, 0) AS BIGINT) AS batch_n, batch_mean, batch_std, count, mean, var, std
       FROM r LEFT JOIN n USING (k, event_type)"""))
def stream_batch_moments(spark, d):
    """ST1: moments of each arrival beside those of all so far, kept as (n, mean, M2) and
    merged at every restart."""
    ev = vw.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    frames, _ = _arrivals(ev.withColumn("_ms", F.unix_millis("ts")), "_ms", F.lit(False))
    path, ckpt = scratch_path(spark, "moments-log"), scratch_path(spark, "moments-log-ckpt")

    def run(s):
        st.advance_batches(s, sf.moments_sink(path, "event_type", "value"), ckpt)

    sf.replay(frames, run, "moments")
    return sf.moments_log(spark, path, "event_type")
