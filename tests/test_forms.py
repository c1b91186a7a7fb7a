"""Forms of objectives, pair statistics, truncation and replay draws on literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneframe.operators import policy as po
from tuneframe.operators import preference as pf
from tuneframe.operators import replay as rp
from tuneframe.operators import rollouts as ro
from tuneframe.operators import sampling as sm
from tuneframe.operators import tokens as tk


def test_a_mixture_of_losses_weighs_rewards_too(spark):
    df = spark.createDataFrame([(1, -1.0, -2.0, -1.5, -1.0, 3.0, 0.5), (1, -3.0, -1.0, -2.0, -2.0, 1.0, 2.0)], "step int, c double, r double, c0 double, r0 double, nll double, pw double")
    got = pf.mixed_pair_report(df, {"sigmoid": 0.5, "hinge": None}, 0.1, nll="nll", rpo_alpha=2.0, policy_weight="pw").first()
    z = [1.5, -2.0]
    losses = [0.5 * math.log1p(math.exp(-0.1 * x)) + max(0.0, 1 - 0.1 * x) for x in z]
    assert got.loss == pytest.approx(((losses[0] + 6) * 0.5 + (losses[1] + 2) * 2) / 2)
    assert got.rewards_chosen == pytest.approx(1.5 * 0.1 * (0.5 - 1.0) / 2) and got.rewards_rejected == pytest.approx(1.5 * 0.1 * (-1.0 + 1.0) / 2)
    assert got.rewards_accuracies == 0.5
    with pytest.raises(ValueError):
        pf.mixed_pair_report(df, {})


def test_pair_statistics_of_groups_of_any_size(spark):
    schema = "group_id int, sample_no int, step int, reward double, logp double, ref_logp double, entropy double, has_eos boolean"
    rows = [(1, 0, 7, 1.0, -1.0, -2.0, 1.0, True), (1, 1, 7, 3.0, -2.0, -2.5, 2.0, False), (1, 2, 7, 2.0, -4.0, -1.0, 4.0, True), (2, 0, 8, 5.0, -1.0, -1.0, 1.0, True)]
    got = ro.online_pair_report(spark.createDataFrame(rows, schema), beta=0.5, loss_type="ipo").collect()
    # pairs of group 1: (0, 1), where 1 wins, and (2, 0), where 2 wins; group 2 has none
    assert len(got) == 1 and (got[0].step, got[0].pairs) == (7, 2)
    r = got[0]
    assert r.objective_scores_margin == pytest.approx(1.5) and r.objective_scores == pytest.approx((2 + 1.5) / 2) and r.contain_eos == pytest.approx(0.75)
    z = [(-2.0 + 1.0) - (-2.5 + 2.0), (-4.0 + 1.0) - (-1.0 + 2.0)]
    assert r.loss == pytest.approx(sum((x - 1) ** 2 for x in z) / 2) and r.logps_chosen == pytest.approx(-3.0)
    kl = {0: 1.0, 1: 0.5, 2: -3.0}
    assert r.objective_kl == pytest.approx(((kl[0] + kl[1]) / 2 + (kl[2] + kl[0]) / 2) / 2) and r.rewards_accuracies == 0.0
    judged = ro.online_pair_report(spark.createDataFrame(rows, schema), beta=0.5, reward=None, first_wins=lambda a, b: a["sample_no"] == 0).first()
    assert judged.objective_scores is None and judged.logps_chosen == pytest.approx((-1.0 - 1.0) / 2)


def test_both_sides_are_cut_against_the_longer_response(spark):
    p, c, r = [1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11]
    df = spark.createDataFrame([(p, c, r)], "p array<int>, c array<int>, r array<int>")
    row = lambda *a: [list(x) for x in df.select(*tk.pair_truncate("p", "c", "r", *a)).first()]
    assert row(9, 2)[0] == p and row(9, 2)[3] == p + r
    assert row(8, 3) == [[2, 3, 4], [2, 3, 4, *c], [-100] * 3 + c, [2, 3, 4, *r], [-100] * 3 + r]
    assert row(8, 3, "keep_start")[0] == [1, 2, 3]
    assert row(5, 2) == [[3, 4], [3, 4, 5, 6, 7], [-100, -100, 5, 6, 7], [3, 4, 10, 11], [-100, -100, 10, 11]]
    assert row(4, 3)[3] == [2, 3, 4, 10]  # the shorter one is cut as well
    with pytest.raises(ValueError):
        tk.pair_truncate("p", "c", "r", 4, 3, "middle")


def test_clip_shares_of_batches(spark):
    schema = "step int, batch int, logps array<double>, old_logps array<double>, mask array<int>, advantage double"
    rows = [(1, 0, [0.0, 1.0], [1.0, 0.0], [1, 1], -1.0), (1, 0, [0.0, 0.0], [0.0, 0.0], [1, 0], -1.0), (1, 1, [1.0], [0.0], [1], 2.0), (1, 2, [1.0], [0.0], [0], 2.0)]
    got = po.clip_ratio_report(spark.createDataFrame(rows, schema)).first()
    assert got.low_mean == pytest.approx((1 / 3 + 0) / 2) and got.low_min == 0 and got.high_max == 1 and got.region_mean == pytest.approx((1 / 3 + 1) / 2)


@pytest.mark.parametrize("weights", [[1.0] * 50, [1000.0] + [0.01] * 400, [0.0, 2.0, 0.0, 1.0], [5.0]])
def test_weighted_draws_equal_a_search_in_running_weights(spark, weights):
    buffer = spark.createDataFrame([(i, float(w), f"row {i}") for i, w in enumerate(weights)], "k long, w double, more string")
    draws = spark.range(700).withColumnRenamed("id", "draw")
    got = {r.draw: (r.k, r.more) for r in sm.weighted_draws(draws, buffer, "w", "k", seed=3).collect()}
    cum = np.cumsum(weights)
    u = {r.draw: r.u for r in draws.withColumn("u", sm.uniform("draw", 3)).collect()}
    for i, x in u.items():
        k = int(np.searchsorted(cum, x * cum[-1], side="right"))
        assert got[i] == (k, f"row {k}")
    assert sm.weighted_draws(draws, buffer.limit(0), "w", "k").count() == 0


def test_replaced_rollouts_come_under_their_new_key(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 0, 5.0), (2, 1, 7.0), (3, 0, 2.0)], "group_id long, sample_no long, reward double")
    scored = spark.createDataFrame([(1, False), (2, True), (3, False)], "group_id long, has_variance boolean")
    buffer = spark.createDataFrame([(2, 4.0)], "group_id long, score double")
    got = sorted(tuple(r) for r in rp.replace_rollouts(rows, rows.where("group_id = 2"), scored, buffer).select("group_id", "source_group_id", "sample_no", "reward").collect())
    assert got == [(g, 2, i, x) for g in (1, 2, 3) for i, x in ((0, 5.0), (1, 7.0))]
    kept = rp.replace_rollouts(rows, rows.limit(0), scored, buffer.limit(0))
    assert kept.count() == 5 and kept.where(F.col("group_id") != F.col("source_group_id")).count() == 0


def test_answers_rotate_inside_batches_of_any_size(spark):
    import random

    from tuneframe.operators import joins as jn

    rng = random.Random(2)
    sizes = {"hot": 900, "a": 1, "b": 2, "c": 40, None: 7}
    rows = [(b, i, f"{b}-{i}" if i % 5 else None, float(i)) for b, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "batch string, pos int, answer string, score double")
    out = jn.rotate_partners(df, "batch", "pos", ["answer", "score"], num_partitions=7)
    got = {(r.batch, r.pos): (r.answer, r.KL_answer, r.KL_score) for r in out.collect()}
    text = lambda b, i: f"{b}-{i}" if i % 5 else None
    assert len(got) == len(rows) and out.columns == [*df.columns, "KL_answer", "KL_score"]
    for b, n in sizes.items():
        for i in range(n):
            assert got[b, i] == (text(b, i), text(b, (i - 1) % n), float((i - 1) % n))
    assert jn.rotate_partners(df.limit(0), "batch", "pos", ["answer"]).count() == 0
