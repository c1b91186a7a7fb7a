"""Streaming jobs: incomplete groups flush on the event-time timeout, the
bucketed replay buffer equals the batch top-N."""

import datetime as dt

from pyspark.sql import functions as F

from tuneframe.sources.readers import scratch_path
from tuneframe.streaming import jobs as st
from tuneframe.streaming import stateful as sf

SCHEMA = "group_id long, sample_no long, reward double, group_size long, ts timestamp"


def test_group_advantages_with_timeout(spark):
    t0 = dt.datetime(2024, 1, 1)
    first = [(1, 0, 1.0, 3, t0), (1, 1, 3.0, 3, t0), (2, 0, 5.0, 2, t0), (2, 1, 7.0, 2, t0)]
    later = [(3, 0, 1.0, 1, t0 + dt.timedelta(days=2))]
    path = scratch_path(spark, "st4-test")
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(f"{path}/a")
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.parquet(f"{path}/b")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{path}/*")
    out = st.run_append(st.group_advantages_stream(src, "group_size", watermark="1 hour", timeout_ms=60_000), "st4-test")
    rows = {(r.group_id, r.sample_no): r for r in out.collect()}
    assert rows[(2, 0)].complete and abs(rows[(2, 0)].advantage - (-1.0 / (2 ** 0.5 + 1e-4))) < 1e-9
    assert rows[(3, 0)].complete and rows[(3, 0)].advantage is None  # a group of one has no std
    # group 1 never got its third sample: emitted as incomplete once the watermark passed its timeout
    assert rows[(1, 0)].complete is False and rows[(1, 1)].complete is False


def test_replay_buffer_stream_matches_batch(spark):
    data = [(g, float((g * 37) % 101), g % 5) for g in range(400)]
    df = spark.createDataFrame(data, "group_id long, score double, arrival long")
    path = st.stage_files(df, "st6-test", "arrival")
    src = st.stream_source(spark, path, df.schema, max_files=1)
    versions = st.run_append(st.replay_buffer_stream(src, 20, buckets=8), "st6-test")
    got = [r.group_id for r in st.current_buffer(versions, 20).collect()]
    exp = [r.group_id for r in df.orderBy(F.col("score").desc(), "arrival", "group_id").limit(20).collect()]
    assert got == exp


# ---------------------------------------------------------------- keyed state with event-time timers
T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def replayed(spark, arrivals, schema, build, name):
    """Rows of the output table after each arrival (a restart each), and rows of state left."""
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    frames = [spark.createDataFrame(rows, schema) for rows in arrivals]
    queries = sf.replay(frames, lambda s: st.advance(build(s), out, ckpt, state_partitions=2), name)
    return spark.read.parquet(out).collect(), queries[-1].lastProgress["stateOperators"][0]["numRowsTotal"]


def test_groups_complete_time_out_and_come_late(spark):
    schema = "group_id long, sample_no long, reward double, size long, ts timestamp, beat boolean"
    arrivals = [
        [(1, 0, 1.0, 2, at(0), False), (1, 1, 3.0, 2, at(1), False), (2, 0, 5.0, 3, at(1), False), (3, 0, 1.0, 2, at(9), False), (4, 0, 7.0, 1, at(8), None)],
        # the watermark is at 8 hours by now: group 2 has timed out, its second sample is late; group 3 goes on after a restart
        [(2, 1, 6.0, 3, at(2), False), (3, 1, 2.0, 2, at(9), False), (5, 0, 4.0, 2, at(10), False), (6, 0, 1.0, 2, None, False)],
        [(-1, 0, 0.0, 1, at(99), True)],
    ]
    rows, left = replayed(spark, arrivals, schema, lambda s: sf.group_advantages(s, "size", "ts", "1 hour", 2 * 3_600_000, heartbeat="beat"), "groups-test")
    got = sorted((r.group_id, r.sample_no, r.kind, r.advantage and round(r.advantage, 4)) for r in rows)
    half = round(1 / (2**0.5 + 1e-4), 4), round(0.5 / (0.5**0.5 + 1e-4), 4)
    assert got == [
        (1, 0, "complete", -half[0]), (1, 1, "complete", half[0]), (2, 0, "timed_out", None), (2, 1, "late", None), (3, 0, "complete", -half[1]),
        (3, 1, "complete", half[1]), (4, 0, "complete", None), (5, 0, "timed_out", None), (6, 0, "late", None)]
    assert left == 0  # nothing is held at the end


def test_rows_behind_the_watermark_are_not_in_the_means(spark):
    schema = "ts timestamp, metric string, value double, beat boolean"
    arrivals = [
        [(at(h), "a", float(h), False) for h in range(30)] + [(at(3), "b", None, False), (at(3), None, 2.0, False)],
        # day 1 is closed (watermark at 26 hours), day 2 is open
        [(at(5), "a", 1e6, False), (at(30), "a", 40.0, False), (None, "a", 5.0, False)],
        [(at(200), None, None, True)],
    ]
    hours = 3_600_000
    rows, left = replayed(spark, arrivals, schema, lambda s: sf.interval_means(s, "ts", "metric", "value", 24 * hours, "3 hours", heartbeat="beat"), "intervals-test")
    table = spark.createDataFrame(rows, sf.INTERVALS)
    got = sorted((r.window_start.day, str(r.metric), r.n, r["mean"]) for r in sf.closed_intervals(table).collect())
    assert got == [(1, "None", 1, 2.0), (1, "a", 24, sum(range(24)) / 24), (1, "b", 1, None), (2, "a", 7, (sum(range(24, 30)) + 40) / 7)]
    late = sorted((r.value, r.ts, r.window_start) for r in sf.late_rows(table).collect())
    assert late == [(5.0, None, None), (1e6, at(5), at(0))] and left == 0


def test_a_prompt_is_given_once_over_restarts(spark):
    schema = "prompt string, step long, example_id long, ts timestamp"
    arrivals = [
        [("x", 2, 1, at(1)), ("x", 1, 2, at(1)), ("y", 1, 3, at(1)), (None, 1, 4, at(1))],
        [("x", 3, 5, at(2)), ("z", 3, 6, at(50)), ("z", 3, 7, at(50))],
        [("y", 4, 8, at(51)), ("x", 4, 9, at(3)), (None, 4, 10, at(51)), ("z", 4, 11, at(51))],
    ]
    rows, left = replayed(spark, arrivals, schema, lambda s: sf.unique_prompts(s, "prompt", ("step", "example_id"), "ts", "1 hour", 10 * 3_600_000), "prompts-test")
    # x and y were forgotten 10 hours after they were last seen; x's third row is behind the watermark
    assert sorted((str(r.prompt), r.example_id) for r in rows) == [("None", 4), ("None", 10), ("x", 2), ("y", 3), ("y", 8), ("z", 6)]
    assert left > 0


def test_running_moments_keep_their_digits(spark):
    rng = [((i * 7919) % 1000) / 1000 for i in range(600)]
    schema, path, ckpt = "k string, v double", scratch_path(spark, "moments-test"), scratch_path(spark, "moments-test-ckpt")
    frames = [spark.createDataFrame([("a", 1e8 + x) for x in rng[i : i + 200]] + [("b", None)] * (i == 0), schema) for i in (0, 200, 400)]
    sf.replay(frames, lambda s: st.advance_batches(s, sf.moments_sink(path, "k", "v"), ckpt, state_partitions=2), "moments-test")
    # the last batch is written again, as after a failure before its commit
    state = lambda: sorted([x if isinstance(x, str) or x is None else round(x, 6) for x in r] for r in spark.read.parquet(path).collect())
    before = state()
    sf.moments_sink(path, "k", "v")(frames[2], 2)
    assert state() == before
    log = {(r.k, r.batch): r for r in sf.moments_log(spark, path, "k").collect()}
    for b in range(3):
        seen, own = rng[: 200 * (b + 1)], rng[200 * b : 200 * (b + 1)]
        var = lambda x: sum((y - sum(x) / len(x)) ** 2 for y in x) / len(x)
        assert log["a", b]["count"] == len(seen) and abs(log["a", b]["var"] - var(seen)) < 1e-7
        assert abs(log["a", b].batch_std ** 2 - var(own) * 200 / 199) < 1e-7
    assert log["b", 2]["mean"] is None and log["b", 2]["count"] == 0
