"""Groups and prompts in buckets of state: the state is a few rows a bucket, however many are
open, and a bucket's entries complete, time out and expire one by one."""

import datetime as dt

from tuneframe.sources.readers import scratch_path
from tuneframe.streaming import jobs as st
from tuneframe.streaming import stateful as sf

T0 = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def _run(spark, arrivals, schema, build, name):
    """Rows of the output, and rows of state after each arrival."""
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    frames = [spark.createDataFrame(rows, schema) for rows in arrivals]
    queries = sf.replay(frames, lambda s: st.advance(build(s), out, ckpt, state_partitions=2), name)
    return spark.read.parquet(out).collect(), [q.lastProgress["stateOperators"][0]["numRowsTotal"] for q in queries]


def test_open_groups_are_few_rows_of_state(spark):
    schema = "group_id long, sample_no long, reward double, size long, ts timestamp"
    n = 2000
    arrivals = [
        # group g's timer is at 3 + g % 3 hours
        [(g, 0, float(g), 2, at(1 + g % 3)) for g in range(n)],
        # those with g % 3 = 0 are timed out by the time their second sample comes; g % 3 = 1 complete; g % 3 = 2 stay open
        [(-1, 0, 0.0, 1, at(3.5))],
        [(g, 1, g + 2.0, 2, at(3.5)) for g in range(n) if g % 3 < 2],
        [(-2, 0, 0.0, 1, at(99))],
    ]
    rows, state = _run(spark, arrivals, schema, lambda s: sf.group_advantages(s, "size", "ts", "0 hours", 2 * HOUR), "bucket-groups-test")
    assert state[0] <= 3 * sf.BUCKETS and state[1] <= 3 * sf.BUCKETS and state[3] == 0
    got = {(r.group_id, r.sample_no): (r.kind, r.advantage and round(r.advantage, 4)) for r in rows if r.group_id >= 0}
    one = round(1 / (2**0.5 + 1e-4), 4)
    for g in range(n):
        if g % 3 == 0:
            assert got[g, 0] == got[g, 1] == ("timed_out", None)
        elif g % 3 == 1:
            assert got[g, 0] == ("complete", -one) and got[g, 1] == ("complete", one)
        else:
            assert got[g, 0] == ("timed_out", None) and (g, 1) not in got
    assert len(rows) == n + 2 + sum(g % 3 < 2 for g in range(n))


def test_seen_prompts_are_few_rows_of_state(spark):
    schema = "prompt string, example_id long, ts timestamp"
    n = 2000
    arrivals = [
        [(f"p{i % n}", i, at(1 + i % 2)) for i in range(2 * n)],
        [("later", 10 * n, at(11.5))],
        # the watermark is at 11.5 hours: even prompts were forgotten at 11, odd ones are known until 12
        [(f"p{i}", 20 * n + i, at(11.5)) for i in range(n)],
    ]
    rows, state = _run(spark, arrivals, schema, lambda s: sf.unique_prompts(s, "prompt", ("example_id",), "ts", "0 hours", 10 * HOUR), "bucket-prompts-test")
    assert max(state) <= 3 * sf.BUCKETS
    exp = [(f"p{i}", i) for i in range(n)] + [("later", 10 * n)] + [(f"p{i}", 20 * n + i) for i in range(0, n, 2)]
    assert sorted((r.prompt, r.example_id) for r in rows) == sorted(exp)
