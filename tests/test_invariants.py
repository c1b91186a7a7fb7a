"""Invariants at scale-free level: packing conserves tokens and respects the
bin size, unpairing doubles rows, group advantages centre on zero, the
sampler count formula, hash-seeded splits are stable."""

import os

from pyspark.sql import functions as F

from tuneframe.operators import conversions as cv
from tuneframe.operators import density as dn
from tuneframe.operators import judging as jd
from tuneframe.operators import ordering as od
from tuneframe.operators import packing as pk
from tuneframe.operators import rollouts as ro
from tuneframe.operators import sampling as sm
from tuneframe.plans import recipe_queries, sft
from tuneframe.sources import views as vw

SF = os.environ.get("TUNEFRAME_TEST_SF", "/root/testdata/sf0.001")


def test_bfd_conserves_tokens_and_fits(spark):
    tok = sft.tokenized(spark, SF).select("example_id", "input_ids", "completion_mask").cache()
    L = 256
    packed = pk.pack_bfd(tok, L, shard_rows=20)
    total_in = tok.select(F.sum(F.least(F.size("input_ids"), F.lit(L)))).first()[0]
    agg = packed.agg(F.sum(F.size("input_ids")).alias("t"), F.max(F.size("input_ids")).alias("m"),
                     F.sum(F.size("seq_lengths")).alias("n")).first()
    assert agg.t == total_in
    assert agg.m <= L
    assert agg.n == tok.filter(F.size("input_ids") > 0).count()
    # masks travel with their ids
    assert packed.filter(F.size("input_ids") != F.size("completion_mask")).count() == 0


def test_wrapped_is_concatenation(spark):
    tok = sft.tokenized(spark, SF).select("example_id", "input_ids")
    packed = pk.pack_wrapped(tok, 100).orderBy("chunk").collect()
    flat = [x for r in packed for x in r.input_ids]
    expect = [x for r in tok.orderBy("example_id").collect() for x in r.input_ids]
    assert flat == expect
    assert all(len(r.input_ids) == 100 for r in packed[:-1])


def test_unpair_doubles_rows(spark):
    p = vw.pairs(spark, SF).select("example_id", "chosen", "rejected")
    assert cv.unpair(cv.extract_prompt(p)).count() == 2 * p.count()


def test_group_advantages_centre(spark):
    r = vw.rollouts(spark, SF).withColumn("reward", F.col("reward_a"))
    g = ro.group_advantages(r, scale="none")
    worst = g.groupBy("group_id").agg(F.abs(F.sum("advantage")).alias("s")).agg(F.max("s")).first()[0]
    assert worst < 1e-9


def test_global_rank_dense_and_ordered(spark):
    df = spark.range(0, 5000).withColumn("v", (F.col("id") * 7919) % 5003)
    ranked = od.global_rank(df, ["v", "id"], "rk", num_partitions=7)
    rows = ranked.orderBy("rk").collect()
    assert [r.rk for r in rows] == list(range(1, 5001))
    assert [r.v for r in rows] == sorted(r.v for r in rows)


def test_group_rank_matches_row_number(spark):
    from pyspark.sql import Window

    df = spark.range(0, 3000).withColumn("g", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 5))
    a = od.group_rank(df, ["g"], ["id"], "rk", num_partitions=6)
    b = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    j = a.join(b, ["id", "g"])
    assert j.filter(F.col("rk") != F.col("rk2")).count() == 0


def test_prefix_sum(spark):
    df = spark.range(1, 1001).withColumn("v", F.col("id") % 3)
    p = od.prefix_sum(df, ["id"], "v", "ps", num_partitions=5).orderBy("id").collect()
    run = 0
    for r in p:
        run += r.v
        assert r.ps == run


def test_split_is_stable(spark):
    df = spark.range(10000).withColumnRenamed("id", "k")
    a = sm.split_fraction(df, "k", 0.2, seed=3)
    b = sm.split_fraction(df.repartition(13), "k", 0.2, seed=3)
    assert a.join(b.withColumnRenamed("split", "s2"), "k").filter(F.col("split") != F.col("s2")).count() == 0
    share = a.filter(F.col("split") == "test").count() / 10000
    assert 0.17 < share < 0.23
    c = sm.split_count(df, "k", 4992, seed=3)
    assert c.filter(F.col("split") == "train").count() == 4992


def test_flip_twice_is_identity(spark):
    df = spark.range(1000).withColumn("a", F.col("id") * 2).withColumn("b", F.col("id") * 2 + 1)
    f = jd.flip_pair(df, "a", "b", jd.flip_flag("id", 7))
    back = jd.flip_pair(f.drop("flipped"), "a", "b", jd.flip_flag("id", 7))
    assert back.filter((F.col("a") != F.col("id") * 2)).count() == 0
    n = f.filter("flipped").count()
    assert 400 < n < 600


def test_top_k_hot_group(spark):
    df = spark.range(20000).withColumn("group_id", F.when(F.col("id") < 15000, 0).otherwise(F.col("id") % 7 + 1))
    df = df.withColumn("score", ((F.col("id") * 37) % 101).cast("double")).withColumnRenamed("id", "sample_no")
    got = ro.top_k_per_group(df, 3, "score").filter("group_id = 0").orderBy("group_rank").collect()
    from pyspark.sql import Window

    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy(F.col("score").desc(), "sample_no")))
    exp = ref.filter("group_id = 0 AND r <= 3").orderBy("r").collect()
    assert [r.sample_no for r in got] == [r.sample_no for r in exp]


def test_bfd_assembly_paths_agree(spark):
    tok = sft.tokenized(spark, SF).select("example_id", "input_ids", "completion_mask")
    a = pk.pack_bfd(tok, 200, shard_rows=30, assemble="pandas")
    b = pk.pack_bfd(tok, 200, shard_rows=30, assemble="join")
    ra = sorted((r.bin, tuple(r.input_ids), tuple(r.seq_lengths)) for r in a.collect())
    rb = sorted((r.bin, tuple(r.input_ids), tuple(r.seq_lengths)) for r in b.collect())
    assert ra == rb


def test_eos_flags_of_texts_over_64_tokens(spark):
    rows = [("ended", [5] * 100 + [2]), ("cut", [5] * 100), ("inner", [5] * 80 + [2] + [5] * 9), ("short", [5, 2])]
    got = {r.example_id: tuple(r)[1:] for r in ro.eos_report(spark.createDataFrame(rows, "example_id string, input_ids array<int>"), 2, 0, 1.0).collect()}
    assert got == {"ended": (False, True, 10.1, 101), "cut": (True, False, 9.0, 0), "inner": (True, True, 9.0, 0), "short": (False, True, 0.2, 2)}


def test_every_sample_of_a_large_group_is_used(spark):
    rows = [(g, i, float((i * 7 + g) % 5), f"t{g}-{i}", i % 4) for g, n in ((1, 1), (2, 2), (3, 5), (4, 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "group_id long, sample_no long, reward double, t string, pick int")
    every = {(g, i) for g, i, *_ in rows}
    pairs = ro.select_all_online_pairs(df).collect()
    assert {(p.group_id, s) for p in pairs for s in (p.chosen_sample, p.rejected_sample)} == every - {(1, 0)}
    assert len(pairs) == 1 + 3 + 6 and all(p.scores_margin >= 0 for p in pairs)
    fours = recipe_queries.four_samples(df).collect()
    assert {s for r in fours for s in (r.sample0, r.sample1, r.sample2, r.sample3)} == {r[3] for r in rows}
    assert sorted((r.group_id, r.row_no) for r in fours) == [(1, 0), (2, 0), (3, 0), (3, 1), (4, 0), (4, 1), (4, 2)]
    assert [tuple(r)[3:] for r in fours if (r.group_id, r.row_no) == (3, 1)] == [("t3-4", "t3-0", "t3-1", "t3-2", 0)]


def test_density_weights_do_not_follow_the_class_odds(spark):
    # one-hot features: class 1 has nine times the rows of class 0, spread alike over both features
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], i % 20 >= 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, desirable boolean")
    for per_class in (None, 512):
        model = dn.fit_density_classifier(df, per_class=per_class, reg=0.01)
        ps = [r.prob_desirable for r in dn.density_ratio_weights(model, df).select("prob_desirable").distinct().collect()]
        assert all(abs(p - 0.5) < (0.01 if per_class is None else 0.15) for p in ps), (per_class, ps)


def test_uniform_draws_are_with_replacement(spark):
    df = spark.range(700).withColumn("g", F.col("id") % 7 == 0)
    one = sm.uniform_draws(df, 512, ["id"], seed=1).collect()
    assert sorted(r.draw for r in one) == list(range(512)) and 250 < len({r.id for r in one}) < 450
    two = sm.uniform_draws(df, 512, ["id"], "g", seed=1).collect()
    assert [sum(r.g == x for r in two) for x in (True, False)] == [100, 512] and all((r.id % 7 == 0) == r.g for r in two)
