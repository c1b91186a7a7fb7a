"""Running states over range partitions, exact quantiles by sketch and refinement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneframe.operators import policy as po
from tuneframe.operators import preference as pf
from tuneframe.operators.scans import Affine, Moments, affine, running


def plain_gae(r, v, gamma, lam):
    adv, last, after = np.zeros(len(r)), 0.0, 0.0
    for t in reversed(range(len(r))):
        last = r[t] + gamma * after - v[t] + gamma * lam * last
        adv[t], after = last, v[t]
    return adv


def test_affine_blocks_equal_a_loop():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000):
        a, b, x, want = rng.uniform(-1, 1, n), rng.standard_normal(n), 0.7, []
        for i in range(n):
            x = a[i] * x + b[i]
            want.append(x)
        assert np.allclose(affine(a, b, 0.7), want, atol=1e-12)


def test_a_trajectory_of_a_million_steps_spreads_over_tasks(spark):
    n, gamma, lam = 1_000_000, 0.999, 0.95
    df = spark.range(n, numPartitions=8).select(
        F.lit("hot").alias("who"), F.col("id").alias("t"), F.sin(F.col("id") * 0.7).alias("r"), F.cos(F.col("id") * 0.3).alias("v"))
    small = spark.range(50).select(F.lit("other").alias("who"), F.col("id").alias("t"), F.lit(1.0).alias("r"), F.lit(0.5).alias("v"))
    out = po.gae_long(df.unionByName(small), ["who"], "t", "r", "v", gamma, lam, num_partitions=12)
    spread = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(spread) >= 10 and max(r["count"] for r in spread) < n / 5
    t = np.arange(n)
    want = plain_gae(np.sin(t * 0.7), np.cos(t * 0.3), gamma, lam)
    got = out.where("who = 'hot'").orderBy("t").select("advantage", "ret").toPandas()
    assert np.allclose(got["advantage"], want, atol=1e-8) and np.allclose(got["ret"], want + np.cos(t * 0.3), atol=1e-8)
    got = out.where("who = 'other'").orderBy("t").select("advantage").toPandas()["advantage"]
    assert np.allclose(got, plain_gae(np.ones(50), np.full(50, 0.5), gamma, lam))


def test_long_and_array_forms_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i == 0 else i, rng.standard_normal(n).tolist(), rng.standard_normal(n).tolist()) for i, n in enumerate([4, 0, 1, 30, 7, 200, 1])]
    df = spark.createDataFrame(rows, "k int, r array<double>, v array<double>")
    adv, ret = po.gae("r", "v", 0.99, 0.9)
    arrays = {r.k: r.a for r in df.select("k", adv.alias("a"), ret.alias("b")).collect()}
    long = df.select("k", F.posexplode(F.arrays_zip("r", "v")).alias("t", "z")).select("k", "t", "z.r", "z.v")
    out = {}
    for row in po.gae_long(long, ["k"], "t", "r", "v", 0.99, 0.9, num_partitions=5).orderBy("t").collect():
        out.setdefault(row.k, []).append(row.advantage)
    for k, r, v in rows:
        want = plain_gae(r, v, 0.99, 0.9)
        assert np.allclose(arrays[k], want) and np.allclose(out.get(k, []), want)


def test_running_moments_merge_over_partitions(spark):
    rng = np.random.default_rng(3)
    x = 1e8 + rng.random(3000)
    df = spark.createDataFrame([(int(i) // 3, float(v)) for i, v in enumerate(x)] + [(-1, None)], "step int, v double")
    got = pf.running_moments(df, "v").orderBy("step").collect()
    assert got[0]["count"] == 0 and got[0]["mean"] is None and got[0]["var"] is None
    for s in (0, 1, 500, 999):
        seen = x[: 3 * (s + 1)]
        r = got[s + 1]
        assert r["count"] == len(seen) and abs(r["var"] - (seen - 1e8).var()) < 1e-6 and abs(r["std"] - (seen - 1e8).std(ddof=1)) < 1e-6
    each = running(df.where("v IS NOT NULL").select("step", F.monotonically_increasing_id().alias("i"), "v"), Moments, ["step"], ["i"], [F.lit(1.0), F.col("v"), F.lit(0.0)], ["n", "m", "s"])
    assert {(r.n, r.c) for r in each.groupBy("n").agg(F.count("*").alias("c")).collect()} == {(1.0, 1000), (2.0, 1000), (3.0, 1000)}


def test_running_sums_before_a_row(spark):
    df = spark.range(100, numPartitions=7).select((F.col("id") % 3).alias("g"), "id", F.lit(1.0).alias("one"))
    out = running(df, Affine, ["g"], ["id"], [F.lit(1.0), F.col("one")], ["before"], inclusive=False, num_partitions=6)
    assert all(r.before == r.id // 3 for r in out.collect())
    assert running(df.limit(0), Affine, ["g"], ["id"], [F.lit(1.0), F.col("one")], ["x"]).count() == 0


def test_masked_moments_far_from_zero(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 2, (1e8 + rng.random(50)).tolist(), [int(b) for b in rng.integers(0, 2, 50)]) for i in range(40)] + [(2, [1.0, 2.0], [0, 0]), (3, [5.0], [1])]
    got = {r.step: r for r in po.masked_moments(spark.createDataFrame(rows, "step int, x array<double>, m array<int>"), "x", "m").collect()}
    for s in (0, 1):
        x = np.concatenate([np.array(v)[np.array(m) == 1] for k, v, m in rows if k == s])
        assert abs(got[s]["var"] - (x - 1e8).var(ddof=1)) < 1e-6 and got[s].mask_sum == len(x)
    assert (got[2]["mean"], got[2]["var"], got[2].mask_sum) == (None, None, 0.0) and (got[3]["mean"], got[3]["var"]) == (5.0, None)


@pytest.mark.parametrize("q", [0.0, 0.37, 0.8, 1.0])
def test_quantiles_are_exact(spark, q):
    rng = np.random.default_rng(5)
    groups = {"even": rng.random(30_000), "ties": np.round(rng.random(20_000), 1), "one": np.array([3.0]), "same": np.full(5000, 2.5), None: rng.random(17)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("one", None), ("empty", None)]
    got = {r.g: r.threshold for r in po.exact_quantile(spark.createDataFrame(rows, "g string, x double"), "x", q, ["g"]).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert abs(got[k] - np.quantile(v, q)) < 1e-12, k


def test_a_bracket_that_misses_is_ranked_whole(spark, monkeypatch):
    monkeypatch.setattr(po, "SKETCH", 3)  # a sketch too coarse for its group
    x = np.random.default_rng(6).random(5000)
    df = spark.createDataFrame([(1, float(v)) for v in x], "g int, x double")
    assert abs(po.exact_quantile(df, "x", 0.8, ["g"]).first().threshold - np.quantile(x, 0.8)) < 1e-12
