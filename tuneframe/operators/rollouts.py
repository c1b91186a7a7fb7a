"""Rollout analytics: combined rewards, group-relative advantages, reports
and group filters (A1-A6, A28, L8).

Generation groups are explicit keys (``group_id``); the reference's
positional ``view(-1, G)`` becomes a ``groupBy``. Group statistics are
computed with partial aggregation and joined back on the key (with AQE's
skew-join splitting a hot group's rows over several tasks) rather than with a
group window, which would put one hot group into one task. Batch-wide values
are aggregates per ``step`` joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rewards as rw
from ..functions.text import col

EPS_STD = 1e-4
ZERO_STD = 1e-8


def weighted_reward(rewards: Sequence[str], weights: Sequence[float] | None = None) -> tuple[Column, Column]:
    """A1: ``Σ w_i·r_i`` skipping missing values; all missing -> 0 (with a flag).

    NaN inputs count as missing too (``nanvl`` -> NULL)."""
    weights = list(weights) if weights is not None else [1.0] * len(rewards)
    terms = [F.nanvl(F.col(r).cast("double"), F.lit(None).cast("double")) * F.lit(float(w)) for r, w in zip(rewards, weights, strict=True)]
    total = F.lit(0.0)
    for t in terms:
        total = total + F.coalesce(t, F.lit(0.0))
    all_missing = F.lit(True)
    for t in terms:
        all_missing = all_missing & t.isNull()
    return total, all_missing


def group_stats(df: DataFrame, group: str, reward: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.avg(reward).alias("group_mean"),
        F.stddev_samp(reward).alias("group_std"),
        F.count(F.lit(1)).alias("group_size"),
    )


def group_advantages(
    df: DataFrame,
    group: str = "group_id",
    reward: str = "reward",
    scale: str = "group",
    step: str = "step",
) -> DataFrame:
    """A2 + A3: ``advantage = r - mean_g``, divided by ``std + 1e-4`` where
    ``std`` is the group's (``scale='group'``) or the step's (``'batch'``)
    sample std; ``'none'`` leaves it unscaled. ``zero_std`` marks std ≈ 0.
    A group of one has no sample std: its advantage is NULL when scaled."""
    if scale not in ("group", "batch", "none"):
        raise ValueError(f"no such scale {scale!r}: group, batch or none")
    out = df.join(group_stats(df, group, reward), group)
    std = F.col("group_std")
    if scale == "batch":
        bstd = df.groupBy(step).agg(F.stddev_samp(reward).alias("batch_std"))
        out = out.join(bstd, step)
        std = F.col("batch_std")
    adv = F.col(reward) - F.col("group_mean")
    if scale != "none":
        adv = adv / (std + F.lit(EPS_STD))
    return out.withColumn("advantage", adv).withColumn("zero_std", std <= F.lit(ZERO_STD))


def leave_one_out_advantages(
    df: DataFrame,
    group: str = "group_id",
    reward: str = "reward",
    step: str = "step",
    clip: tuple[float, float] | None = None,
    beta: float = 0.0,
    old_logps: str | None = None,
    ref_logps: str | None = None,
    mask: str | None = None,
    normalize: bool = False,
) -> DataFrame:
    """A4: RLOO. Reward -> optional clip -> minus ``β·Σ_t (old - ref)`` over
    the completion mask -> baseline = mean of the *other* samples of the
    group -> optional normalisation over the step ``(a - mean)/(std + 1e-4)``.
    A group of one has no baseline (NULL)."""
    r = F.col(reward)
    if clip is not None:
        r = F.least(F.greatest(r, F.lit(float(clip[0]))), F.lit(float(clip[1])))
    if beta != 0.0:
        kl_tok = F.zip_with(old_logps, ref_logps, lambda a, b: a - b)
        if mask is not None:
            kl_tok = F.zip_with(kl_tok, mask, lambda k, m: k * m)
        kl = F.aggregate(kl_tok, F.lit(0.0), lambda acc, x: acc + x)
        r = r - F.lit(beta) * kl
    base = df.withColumn("_tf_r", r)
    sums = base.groupBy(group).agg(F.sum("_tf_r").alias("_tf_gsum"), F.count(F.lit(1)).alias("_tf_gn"))
    out = base.join(sums, group)
    baseline = (F.col("_tf_gsum") - F.col("_tf_r")) / F.when(F.col("_tf_gn") > 1, F.col("_tf_gn") - 1)
    out = out.withColumn("advantage", F.col("_tf_r") - baseline).withColumn("shaped_reward", F.col("_tf_r"))
    if normalize:
        b = out.groupBy(step).agg(F.avg("advantage").alias("_tf_am"), F.stddev_samp("advantage").alias("_tf_as"))
        # one row a step, broadcast: the rows stay spread over their groups' tasks
        out = out.join(F.broadcast(b), step).withColumn(
            "advantage", (F.col("advantage") - F.col("_tf_am")) / (F.col("_tf_as") + F.lit(EPS_STD))
        ).drop("_tf_am", "_tf_as")
    return out.drop("_tf_r", "_tf_gsum", "_tf_gn")


def reward_report(df: DataFrame, reward_cols: Sequence[str], step: str = "step", group: str = "group_id", reward: str = "reward") -> DataFrame:
    """A5 + A3: per step, each reward function's mean and sample std over the
    rows where it applies (NULL/NaN skipped), the mean of the combined reward
    group means over rows, the mean group std and the zero-std fraction."""
    g = group_advantages(df, group, reward, "group", step)
    aggs = []
    for c in reward_cols:
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_std")]
    aggs += [
        F.avg("group_mean").alias("reward"),
        F.avg("group_std").alias("reward_std"),
        F.avg(F.col("zero_std").cast("double")).alias("frac_reward_zero_std"),
    ]
    return g.groupBy(step).agg(*aggs)


def length_report(df: DataFrame, length: str = "completion_len", truncated: str = "truncated", step: str = "step") -> DataFrame:
    """Completion length mean/min/max, clipped ratio, and the same
    statistics over terminated completions (0 when none terminated)."""
    n = F.col(length).cast("double")
    term = F.when(~F.col(truncated), n)
    return df.groupBy(step).agg(
        F.avg(n).alias("mean_length"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.avg(F.col(truncated).cast("double")).alias("clipped_ratio"),
        F.coalesce(F.avg(term), F.lit(0.0)).alias("mean_terminated_length"),
        F.coalesce(F.min(term), F.lit(0.0)).alias("min_terminated_length"),
        F.coalesce(F.max(term), F.lit(0.0)).alias("max_terminated_length"),
        F.sum(F.col(length).cast("long")).alias("num_tokens"),
    )


def top_k_per_group(
    df: DataFrame, k: int, score: str, group: str = "group_id", tie: str = "sample_no", salt_buckets: int = 16
) -> DataFrame:
    """Keep the ``k`` best-scoring rows of each group (ties by ``tie``).

    Two rounds keep a hot group parallel: first the best ``k`` inside each
    ``(group, salt)`` slice, then the best ``k`` among those ``salt_buckets·k``
    survivors. The result is exactly the per-group top-k."""
    from pyspark.sql import Window

    order = [F.col(score).desc_nulls_last(), F.col(tie).asc()]
    salted = df.withColumn("_tf_salt", F.pmod(F.xxhash64(tie, score), F.lit(salt_buckets)))
    w1 = Window.partitionBy(group, "_tf_salt").orderBy(*order)
    first = salted.withColumn("_tf_r1", F.row_number().over(w1)).filter(F.col("_tf_r1") <= k)
    w2 = Window.partitionBy(group).orderBy(*order)
    return first.withColumn("group_rank", F.row_number().over(w2)).filter(F.col("group_rank") <= k).drop("_tf_salt", "_tf_r1")


def select_online_pairs(df: DataFrame, group: str = "group_id", reward: str = "reward", order: str = "sample_no") -> DataFrame:
    """Of the first two completions of a prompt (by ``order``), the one
    with the higher reward is chosen; a tie keeps the first. Returns one row
    per prompt with chosen/rejected sample numbers, rewards and the margin."""
    two = df.select(group, order, reward).withColumn("_tf_o", F.col(order))
    firsts = two.groupBy(group).agg(
        F.min_by(F.struct(order, reward), F.col(order)).alias("a"),
        F.count(F.lit(1)).alias("_n"),
    )
    seconds = (
        two.join(firsts.select(group, F.col("a")[order].alias("_first")), group)
        .filter(F.col(order) > F.col("_first"))
        .groupBy(group)
        .agg(F.min_by(F.struct(order, reward), F.col(order)).alias("b"))
    )
    pairs = firsts.join(seconds, group)
    a_wins = F.col("a")[reward] >= F.col("b")[reward]
    return pairs.select(
        group,
        F.when(a_wins, F.col("a")[order]).otherwise(F.col("b")[order]).alias("chosen_sample"),
        F.when(a_wins, F.col("b")[order]).otherwise(F.col("a")[order]).alias("rejected_sample"),
        F.when(a_wins, F.col("a")[reward]).otherwise(F.col("b")[reward]).alias("chosen_reward"),
        F.when(a_wins, F.col("b")[reward]).otherwise(F.col("a")[reward]).alias("rejected_reward"),
    ).withColumn("scores_margin", F.col("chosen_reward") - F.col("rejected_reward"))


def select_all_online_pairs(df: DataFrame, group: str = "group_id", reward: str = "reward", order: str = "sample_no") -> DataFrame:
    """A28 for groups of any size (``order`` counts a group's completions from
    0): completions 2p and 2p + 1 are pair p, and the last of an odd number meets
    the group's first. In each pair the higher reward is chosen; a tie keeps the
    even one. Groups of one completion have no pair."""
    one = df.select(group, order, reward)
    sizes = one.groupBy(group).agg((F.max(order) + 1).alias("_n"))
    a = one.filter(F.col(order) % 2 == 0).join(sizes.filter(F.col("_n") > 1), group)
    a = a.select(group, F.col(order).alias("_a"), F.col(reward).alias("_ra"), F.pmod(F.col(order) + 1, F.col("_n")).alias("_b"))
    b = one.select(group, F.col(order).alias("_b"), F.col(reward).alias("_rb"))
    a_wins = F.col("_ra") >= F.col("_rb")
    return a.join(b, [group, "_b"]).select(
        group,
        F.floor(F.col("_a") / 2).alias("pair_no"),
        F.when(a_wins, F.col("_a")).otherwise(F.col("_b")).alias("chosen_sample"),
        F.when(a_wins, F.col("_b")).otherwise(F.col("_a")).alias("rejected_sample"),
        F.when(a_wins, F.col("_ra")).otherwise(F.col("_rb")).alias("chosen_reward"),
        F.when(a_wins, F.col("_rb")).otherwise(F.col("_ra")).alias("rejected_reward"),
    ).withColumn("scores_margin", F.col("chosen_reward") - F.col("rejected_reward"))


def online_pair_report(df: DataFrame, beta: float = 0.1, loss_type: str = "sigmoid", group: str = "group_id", order: str = "sample_no", step: str = "step", *,
                       reward: str | None = "reward", logp: str = "logp", ref_logp: str = "ref_logp", entropy: str = "entropy", has_eos: str = "has_eos",
                       first_wins: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """A28 as training logs it, per step, over groups of any size: completions are paired
    as in :func:`select_all_online_pairs`; of the first ``a`` and the second ``b`` of a
    pair the higher reward is chosen, or what the judge says: ``first_wins(a, b)`` of the
    structs of their columns (a judge's rank 0 for the first). A row holds a completion's
    summed ``logp`` and ``ref_logp``, its ``entropy`` sum and whether it ends by itself.

    ``objective_scores`` and ``objective_rlhf_reward`` are null without rewards. A
    completion that is in two pairs (the first, where the group is odd) counts in both.
    The pairs are made by one aggregate of the completions, whatever the group's size."""
    columns = [c for c in (order, reward, logp, ref_logp, entropy, has_eos, *df.columns) if c and c not in (group, step)]
    row = F.struct(*dict.fromkeys(columns))
    sizes = df.groupBy(group).agg((F.max(order) + 1).alias("_n"))
    half = F.floor(F.col(order) / 2)
    # the first completion of an odd group is the second of its last pair as well
    places = F.when((F.col(order) == 0) & (F.col("_n") % 2 == 1), F.array(F.struct(half.alias("pair"), F.lit(0).alias("side")), F.struct(F.floor(F.col("_n") / 2).alias("pair"), F.lit(1).alias("side"))))
    places = places.otherwise(F.array(F.struct(half.alias("pair"), (F.col(order) % 2).cast("int").alias("side"))))
    at = df.join(sizes.where("_n > 1"), group).withColumn("_row", row).select(group, step, "_row", F.inline(places))
    side = lambda k: F.first(F.when(F.col("side") == k, F.col("_row")), ignorenulls=True)
    first_step = F.first(F.when(F.col("side") == 0, F.col(step)), ignorenulls=True).alias(step)  # a pair's step is its first completion's
    pairs = at.groupBy(group, "pair").agg(first_step, side(0).alias("a"), side(1).alias("b"))
    a, b = F.col("a"), F.col("b")
    wins = first_wins(a, b) if first_wins else a[reward] >= b[reward]
    best, other = F.when(wins, a).otherwise(b), F.when(wins, b).otherwise(a)
    pairs = pairs.select(step, best.alias("w"), other.alias("l"))
    w, lost = F.col("w"), F.col("l")
    z = (w[logp] - lost[logp]) - (w[ref_logp] - lost[ref_logp])
    if loss_type == "sigmoid":
        loss = -rw.log_sigmoid(F.lit(beta) * z)
    elif loss_type == "ipo":
        loss = F.pow(z - 1 / (2 * beta), 2)
    else:
        raise ValueError(f"no such loss: {loss_type}")
    both = lambda f: (f(w) + f(lost)) / 2
    kl = lambda x: x[logp] - x[ref_logp]
    score = (lambda x: x[reward]) if reward else (lambda x: F.lit(None).cast("double"))
    win, loss_ = F.lit(beta) * kl(w), F.lit(beta) * kl(lost)
    return pairs.groupBy(step).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(loss).alias("loss"),
        F.avg(score(w) - score(lost)).alias("objective_scores_margin"), F.avg(both(score)).alias("objective_scores"),
        F.avg(both(lambda x: x[has_eos].cast("double"))).alias("contain_eos"), F.avg(w[logp]).alias("logps_chosen"), F.avg(lost[logp]).alias("logps_rejected"),
        F.avg(both(kl)).alias("objective_kl"), F.avg(both(lambda x: -F.lit(beta) * kl(x))).alias("objective_non_score_reward"),
        F.avg(both(lambda x: score(x) - F.lit(beta) * kl(x))).alias("objective_rlhf_reward"), F.avg(both(lambda x: x[entropy])).alias("objective_entropy"),
        F.avg(win).alias("rewards_chosen"), F.avg(loss_).alias("rewards_rejected"), F.avg(win - loss_).alias("rewards_margins"),
        F.avg((win > loss_).cast("double")).alias("rewards_accuracies"))


def eos_report(df: DataFrame, eos_id: int, pad_id: int, penalty: float, ids: str = "input_ids", key: str = "example_id") -> DataFrame:
    """F4-F6 over whole token lists: truncation and EOS flags, a length score
    less ``penalty`` without EOS, and the tokens that carry loss."""
    truncated, has_eos = rw.is_truncated(ids, eos_id, pad_id), rw.contains_eos(ids, eos_id)
    return df.select(
        key,
        truncated.alias("truncated"),
        has_eos.alias("has_eos"),
        rw.missing_eos_penalty(F.size(ids) / 10.0, has_eos, penalty).alias("score"),
        F.aggregate(rw.mask_truncated(F.transform(ids, lambda _x: F.lit(1)), truncated), F.lit(0), lambda a, x: a + x).alias("loss_tokens"),
    )


def attach_prompt_columns(rollouts: DataFrame, prompts: DataFrame, key: str = "group_id") -> DataFrame:
    """Every generation of a prompt gets the prompt's extra columns
    (an equi-join; AQE broadcasts the prompt side only when it is small)."""
    return rollouts.join(prompts, key)
