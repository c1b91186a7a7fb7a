"""Preference and log-probability analytics over *logged* numbers (A7-A12,
A17, A21-A25, J5).

Inputs are columns of per-sequence log-probabilities: ``c``/``r`` (policy,
chosen/rejected) and ``c0``/``r0`` (reference). Every objective is a
``Column`` builder evaluated per row; reports are one ``groupBy(step)``.
Objectives that depend on the whole batch are expressed as joins:
``bco_pair`` needs a running mean (cumulative per-step aggregate joined back),
``aot``/``aot_pair`` pair the k-th smallest value of one distribution with the
k-th smallest of the other (rank-matched join, J5).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rewards import log_sigmoid, sigmoid, softplus
from .ordering import group_rank
from .scans import Moments, running

# Exp cap (log of the largest float32), default alpha for the
# alpha-divergence, the exo_pair smoothing used when none is given.
EXP_CAP = 88.72283935546875
ALPHA_DIVERGENCE_COEF = 1.0
EXO_DEFAULT_EPS = 1e-3

PAIR_LOSSES = (
    "sigmoid", "robust", "exo_pair", "hinge", "ipo", "bco_pair", "sppo_hard", "nca_pair",
    "aot", "aot_pair", "apo_zero", "apo_down", "discopop",
)


def cap_exp(x: Column) -> Column:
    return F.exp(F.least(x, F.lit(EXP_CAP)))


def pair_logits(
    c="c", r="r", c0="c0", r0="r0", reference_free: bool = False, divergence: str = "reverse_kl", alpha: float = ALPHA_DIVERGENCE_COEF
) -> Column:
    """``z = (c - r) - (c0 - r0)``; alpha-divergence and JS variants (§9)."""
    c, r, c0, r0 = (F.col(x) if isinstance(x, str) else x for x in (c, r, c0, r0))
    cl = c - (F.lit(0.0) if reference_free else c0)
    rl = r - (F.lit(0.0) if reference_free else r0)
    if divergence == "alpha":
        return (cap_exp(rl * -alpha) - cap_exp(cl * -alpha)) / F.lit(alpha)
    ref = F.lit(0.0) if reference_free else (c0 - r0)
    z = (c - r) - ref
    if divergence == "js":
        z = z - (softplus(cl) - softplus(rl))
    return z


def _sig_form(x: Column, beta: float, eps: float) -> Column:
    return -log_sigmoid(F.lit(beta) * x) * (1 - eps) - log_sigmoid(F.lit(-beta) * x) * eps


def pair_loss(
    loss_type: str,
    beta: float = 0.1,
    label_smoothing: float = 0.0,
    c="c", r="r", c0="c0", r0="r0",
    reference_free: bool = False,
    divergence: str = "reverse_kl",
    delta: Column | None = None,
    aot_delta: Column | None = None,
    discopop_tau: float = 0.05,
) -> Column:
    """Per-row preference objective for ``loss_type``.

    ``bco_pair`` needs ``delta`` (running mean reward); ``aot``/``aot_pair``
    need ``aot_delta`` from :func:`rank_matched_delta`."""
    cc, rc, c0c, r0c = (F.col(x) if isinstance(x, str) else x for x in (c, r, c0, r0))
    z = pair_logits(c, r, c0, r0, reference_free, divergence)
    b = F.lit(beta)
    cr = cc - c0c
    rr = rc - r0c
    eps = label_smoothing
    if loss_type == "sigmoid":
        return _sig_form(z, beta, eps)
    if loss_type == "robust":
        return (-log_sigmoid(b * z) * (1 - eps) + log_sigmoid(-b * z) * eps) / (1 - 2 * eps)
    if loss_type == "exo_pair":
        e = eps if eps != 0 else EXO_DEFAULT_EPS
        return sigmoid(b * z) * (log_sigmoid(b * z) - math.log(1 - e)) + sigmoid(-b * z) * (log_sigmoid(-b * z) - math.log(e))
    if loss_type == "hinge":
        return F.greatest(F.lit(0.0), 1 - b * z)
    if loss_type == "ipo":
        return F.pow(z - 1 / (2 * beta), 2)
    if loss_type == "bco_pair":
        if delta is None:
            raise ValueError("bco_pair needs the running reward mean (delta)")
        return -log_sigmoid(b * cr - delta) - log_sigmoid(-(b * rr - delta))
    if loss_type == "sppo_hard":
        return F.pow(cr - 0.5 / beta, 2) + F.pow(rr + 0.5 / beta, 2)
    if loss_type == "nca_pair":
        cw, rw = cr * b, rr * b
        return -log_sigmoid(cw) - 0.5 * log_sigmoid(-cw) - 0.5 * log_sigmoid(-rw)
    if loss_type in ("aot", "aot_pair"):
        if aot_delta is None:
            raise ValueError(f"{loss_type} needs the rank-matched delta")
        return _sig_form(aot_delta, beta, eps)
    if loss_type == "apo_zero":
        return (1 - sigmoid(b * cr)) + sigmoid(b * rr)
    if loss_type == "apo_down":
        return sigmoid(b * cr) + (1 - sigmoid(b * (cr - rr)))
    if loss_type == "discopop":
        y = ((cc - rc) - (c0c - r0c)) * b
        m = sigmoid(y / discopop_tau)
        return -log_sigmoid(y) * (1 - m) + F.exp(-y) * m
    raise ValueError(f"no such loss: {loss_type}")


def mixed_pair_report(df: DataFrame, weights: dict[str, float | None], beta: float = 0.1, step: str = "step", c="c", r="r", c0="c0", r0="r0", *,
                      nll: str | None = None, rpo_alpha: float | None = None, policy_weight: str | None = None, **loss_options) -> DataFrame:
    """A21 with several objectives at once, per step. Each loss type counts by its weight
    (null: 1), and so do the rewards ``β(c - c0)`` and ``β(r - r0)`` that it brings along:
    losses, rewards, margins and accuracy are those of the weighted sums. ``rpo_alpha``
    adds that share of the column ``nll``; ``policy_weight`` multiplies the whole loss."""
    if not weights:
        raise ValueError("a mixture needs one loss at least")
    per = {k: 1.0 if w is None else float(w) for k, w in weights.items()}
    col = lambda x: F.col(x) if isinstance(x, str) else x
    loss = F.lit(0.0)
    for kind, w in per.items():
        loss = loss + pair_loss(kind, beta, c=c, r=r, c0=c0, r0=r0, **loss_options) * w
    if rpo_alpha is not None:
        loss = loss + F.lit(rpo_alpha) * F.col(nll)
    if policy_weight is not None:
        loss = loss * F.col(policy_weight)
    total = sum(per.values())
    chosen, rejected = (col(c) - col(c0)) * (beta * total), (col(r) - col(r0)) * (beta * total)
    rows = df.select(step, loss.alias("_l"), chosen.alias("_c"), rejected.alias("_r"))
    return rows.groupBy(step).agg(
        F.avg("_l").alias("loss"), F.avg("_c").alias("rewards_chosen"), F.avg("_r").alias("rewards_rejected"),
        F.avg((F.col("_c") > F.col("_r")).cast("double")).alias("rewards_accuracies"), F.avg(F.col("_c") - F.col("_r")).alias("rewards_margins"))


def running_reward_mean(df: DataFrame, beta: float, step: str = "step", c="c", r="r", c0="c0", r0="r0") -> DataFrame:
    """Running mean of the batch rewards ``β(c-c0)`` and ``β(r-r0)`` up to and
    including each step (``bco_pair``'s δ): per-step means and counts, then a
    prefix scan of merges over the step table."""
    each = F.lit(beta) * (F.col(c) - F.col(c0)) + F.lit(beta) * (F.col(r) - F.col(r0))
    per = df.groupBy(step).agg((F.count(F.lit(1)) * 2).alias("_n"), (F.avg(each) / 2).alias("_m"))
    run = running(per, Moments, [], [step], [F.col("_n"), F.col("_m"), F.lit(0.0)], ["_cn", "delta", "_m2"])
    return run.select(step, "delta")


def rank_matched_delta(df: DataFrame, kind: str, step: str = "step", key: str = "example_id") -> DataFrame:
    """Per step, sort two value distributions separately and pair them by
    rank. ``aot_pair``: ``c-c0`` vs ``r-r0``; ``aot``: ``c-r`` vs ``c0-r0``.
    Ranks come from the skew-safe ``group_rank`` (one step may be huge).
    Returns ``(step, rank, aot_delta)``."""
    if kind == "aot_pair":
        a, b = F.col("c") - F.col("c0"), F.col("r") - F.col("r0")
    else:
        a, b = F.col("c") - F.col("r"), F.col("c0") - F.col("r0")
    # both distributions ranked in one pass: groups are (step, side)
    both = df.select(step, key, F.lit(0).alias("_tf_side"), a.alias("v")).unionByName(
        df.select(step, key, F.lit(1).alias("_tf_side"), b.alias("v"))
    )
    ranked = group_rank(both, [step, "_tf_side"], ["v", key], "rank")
    left = ranked.filter(F.col("_tf_side") == 0).select(step, "rank", F.col("v").alias("va"))
    right = ranked.filter(F.col("_tf_side") == 1).select(step, "rank", F.col("v").alias("vb"))
    return left.join(right, [step, "rank"]).select(step, "rank", (F.col("va") - F.col("vb")).alias("aot_delta"))


def preference_report(df: DataFrame, loss: Column, beta: float, step: str = "step", by: Sequence[str] = ()) -> DataFrame:
    """Mean loss, chosen/rejected rewards ``β(lp-ref)``, accuracy (ties
    lose), margin and mean log-probs per step (and optional ``by`` keys)."""
    cr = F.lit(beta) * (F.col("c") - F.col("c0"))
    rr = F.lit(beta) * (F.col("r") - F.col("r0"))
    return df.groupBy(step, *by).agg(
        F.avg(loss).alias("loss"),
        F.avg(cr).alias("rewards_chosen"),
        F.avg(rr).alias("rewards_rejected"),
        F.avg(F.when(cr > rr, 1.0).otherwise(0.0)).alias("rewards_accuracies"),
        F.avg(cr - rr).alias("rewards_margins"),
        F.avg("c").alias("logps_chosen"),
        F.avg("r").alias("logps_rejected"),
    )


def unpaired_report(df: DataFrame, beta: float, kl: Column, step: str = "step", label: str = "label",
                    lp: str = "lp", lp0: str = "lp0", desirable_weight: float = 1.0, undesirable_weight: float = 1.0,
                    loss_type: str = "kto") -> DataFrame:
    """A8 + A23: unpaired objective and metrics per step. Rewards are
    summed and counted per class and divided at the end (a mean over all rows,
    not a mean of batch means). ``kl`` is the per-step KL estimate column."""
    ratio = F.col(lp) - F.col(lp0)
    b = F.lit(beta)
    if loss_type == "kto":
        des_loss = 1 - sigmoid(b * (ratio - kl))
        und_loss = 1 - sigmoid(b * (kl - ratio))
    elif loss_type == "apo_zero_unpaired":
        des_loss = 1 - sigmoid(b * ratio)
        und_loss = sigmoid(b * ratio)
    else:
        raise ValueError(f"no such loss: {loss_type}")
    loss = F.when(F.col(label), des_loss * desirable_weight).otherwise(und_loss * undesirable_weight)
    rew = b * ratio
    g = df.groupBy(step).agg(
        F.avg(loss).alias("loss"),
        F.sum(F.when(F.col(label), rew)).alias("_cs"),
        F.count(F.when(F.col(label), 1)).alias("n_chosen"),
        F.sum(F.when(~F.col(label), rew)).alias("_rs"),
        F.count(F.when(~F.col(label), 1)).alias("n_rejected"),
        F.sum(F.when(F.col(label), F.col(lp))).alias("_cl"),
        F.sum(F.when(~F.col(label), F.col(lp))).alias("_rl"),
        F.first(kl).alias("kl"),
    )
    ch = F.col("_cs") / F.nullif(F.col("n_chosen"), F.lit(0))
    rj = F.col("_rs") / F.nullif(F.col("n_rejected"), F.lit(0))
    return g.select(
        step, "loss", "kl", "n_chosen", "n_rejected",
        ch.alias("rewards_chosen"), rj.alias("rewards_rejected"), (ch - rj).alias("rewards_margins"),
        (F.col("_cl") / F.nullif(F.col("n_chosen"), F.lit(0))).alias("logps_chosen"),
        (F.col("_rl") / F.nullif(F.col("n_rejected"), F.lit(0))).alias("logps_rejected"),
    )


def kl_from_mismatched(df: DataFrame, step: str = "step", kl_lp: str = "kl_lp", kl_lp0: str = "kl_lp0") -> DataFrame:
    """KTO's KL estimate per step: mean of ``policy - reference`` over
    mismatched prompt/answer pairs (J2), clamped at 0."""
    return df.groupBy(step).agg(F.greatest(F.avg(F.col(kl_lp) - F.col(kl_lp0)), F.lit(0.0)).alias("kl"))


def pairwise_accuracy(df: DataFrame, s0: str, s1: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy of ``argmax(s0, s1) == label`` with ties dropped; the tie
    count is reported next to it."""
    pred = F.when(F.col(s1) > F.col(s0), 1).otherwise(0)
    tie = F.col(s0) == F.col(s1)
    return df.groupBy(*by).agg(
        F.avg(F.when(~tie, F.when(pred == F.col(label), 1.0).otherwise(0.0))).alias("accuracy"),
        F.count(F.when(tie, 1)).alias("ties"),
    )


def token_accuracy(df: DataFrame, preds: str, labels: str, by: Sequence[str] = (), ignore: int = -100, next_token: bool = False) -> DataFrame:
    """A10: Σcorrect / Σvalid over tokens whose label is not ``ignore``
    (0 when there is no valid token). Per-row sums first, then one aggregate.
    ``next_token``: the prediction at a place is for the label one place on."""
    p, lab = F.col(preds), F.col(labels)
    if next_token:
        n = F.greatest(F.size(lab) - 1, F.lit(0))
        p, lab = F.slice(p, F.lit(1), n), F.slice(lab, F.lit(2), n)
    pairs = F.arrays_zip(p.alias("p"), lab.alias("l"))
    valid = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + F.when(x["l"] != ignore, 1).otherwise(0))
    correct = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + F.when((x["l"] != ignore) & (x["p"] == x["l"]), 1).otherwise(0))
    g = df.groupBy(*by).agg(F.sum(correct).alias("correct"), F.sum(valid).alias("valid"))
    return g.withColumn("accuracy", F.coalesce(F.col("correct") / F.nullif(F.col("valid"), F.lit(0)), F.lit(0.0)))


def reward_model_report(df: DataFrame, rc: str, rr: str, step: str = "step", margin: str | None = None,
                        center_coef: float | None = None) -> DataFrame:
    """min/mean/max reward over both sides, accuracy (chosen > rejected),
    mean margin and the pairwise objective (optional margin and centering)."""
    diff = F.col(rc) - F.col(rr)
    if margin is not None:
        diff = diff - F.col(margin)
    aggs = [
        F.least(F.min(rc), F.min(rr)).alias("min_reward"),
        ((F.sum(rc) + F.sum(rr)) / (2 * F.count(F.lit(1)))).alias("mean_reward"),
        F.greatest(F.max(rc), F.max(rr)).alias("max_reward"),
        F.avg(F.when(F.col(rc) > F.col(rr), 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(F.col(rc) - F.col(rr)).alias("margin"),
        F.avg(-log_sigmoid(diff)).alias("loss"),
    ]
    g = df.groupBy(step).agg(*aggs, F.avg(F.pow(F.col(rc) + F.col(rr), 2)).alias("_center"))
    if center_coef is not None:
        g = g.withColumn("loss", F.col("loss") + F.lit(center_coef) * F.col("_center"))
    return g.drop("_center")


def running_moments(df: DataFrame, value: str, step: str = "step") -> DataFrame:
    """Per step the batch mean and sample std, and the running mean,
    population variance and sample std over all steps so far. Each step is a
    mergeable (n, mean, M2); the running figures are a prefix scan of merges over
    range partitions of the steps."""
    per = df.groupBy(step).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("batch_mean"),
        F.stddev_samp(value).alias("batch_std"),
        F.var_pop(value).alias("_var"),
    )
    out = running(per, Moments, [], [step], [F.col("n"), F.col("batch_mean"), F.col("_var") * F.col("n")], ["_n", "_mean", "_m2"])
    count = F.col("_n").cast("long")
    return out.select(
        step, "n", "batch_mean", "batch_std", count.alias("count"), F.when(count > 0, F.col("_mean")).alias("mean"),
        (F.col("_m2") / F.nullif(F.col("_n"), F.lit(0.0))).alias("var"), F.sqrt(F.col("_m2") / F.nullif(F.col("_n") - 1, F.lit(0.0))).alias("std"))


def k3_kl(logp: Column, ref_logp: Column) -> Column:
    """A17 (per token): ``exp(ref - lp) - (ref - lp) - 1``."""
    d = ref_logp - logp
    return F.exp(d) - d - 1


def masked_mean_per_row(values: Column, mask: Column) -> Column:
    """Mean of ``values`` where ``mask`` is 1 (NULL when the mask is empty)."""
    z = F.zip_with(values, mask, lambda v, m: v * m)
    s = F.aggregate(z, F.lit(0.0), lambda a, x: a + x)
    n = F.aggregate(mask, F.lit(0.0), lambda a, x: a + x)
    return s / F.nullif(n, F.lit(0.0))


def ld_logp(token_logps: Column, public_len: Column | int, alpha: float) -> Column:
    """Length-desensitised sum: the first ``public_len`` token log-probs
    in full, the rest weighted by ``alpha``."""
    pl = public_len if isinstance(public_len, Column) else F.lit(public_len)
    return F.aggregate(
        F.transform(token_logps, lambda x, i: F.when(i < pl, x).otherwise(x * alpha)), F.lit(0.0), lambda a, x: a + x
    )


def odds_ratio(c: Column, r: Column, beta: float) -> dict[str, Column]:
    """ORPO's log-odds and the (positive-signed) ``β·logσ(log_odds)``."""
    log_odds = (c - r) - (F.log1p(-F.exp(c)) - F.log1p(-F.exp(r)))
    ratio = log_sigmoid(log_odds)
    return {"log_odds": log_odds, "ratio": ratio, "or_loss": F.lit(beta) * ratio}


def cpo_loss(c: Column, r: Column, loss_type: str, beta: float, label_smoothing: float = 0.0,
             simpo_gamma: float = 0.5, alpha: float = 0.0) -> dict[str, Column]:
    """Reference-free objectives (sigmoid, hinge, ipo, simpo) with the
    optional alpha-transformed rewards ``(1 - p^{-α})/α``."""
    if alpha != 0.0:
        cw = (1 - F.pow(F.exp(c), -alpha)) / alpha
        rw = (1 - F.pow(F.exp(r), -alpha)) / alpha
    else:
        cw, rw = c, r
    logits = cw - rw
    if loss_type == "simpo":
        loss = _sig_form(logits - simpo_gamma / beta, beta, label_smoothing)
    elif loss_type == "sigmoid":
        loss = _sig_form(logits, beta, label_smoothing)
    elif loss_type == "hinge":
        loss = F.greatest(F.lit(0.0), 1 - F.lit(beta) * logits)
    elif loss_type == "ipo":
        loss = F.pow(logits - 1 / (2 * beta), 2)
    else:
        raise ValueError(f"no such loss: {loss_type}")
    return {"loss": loss, "chosen_reward": F.lit(beta) * cw, "rejected_reward": F.lit(beta) * rw}


def class_balance(df: DataFrame, label: str = "label", desirable_weight: float = 1.0, undesirable_weight: float = 1.0) -> DataFrame:
    """Class counts (floored at 1) and the recommended weight ranges."""
    g = df.agg(
        F.greatest(F.count(F.when(F.col(label), 1)), F.lit(1)).alias("num_desirable"),
        F.greatest(F.count(F.when(~F.col(label), 1)), F.lit(1)).alias("num_undesirable"),
    )
    d, u = F.col("num_desirable").cast("double"), F.col("num_undesirable").cast("double")
    out = g.select(
        "num_desirable", "num_undesirable",
        F.round(u * undesirable_weight / d, 2).alias("des_weight_lower"),
        F.round(u * undesirable_weight / d * 1.33, 2).alias("des_weight_upper"),
        F.round(d * desirable_weight / u / 1.33, 2).alias("und_weight_lower"),
        F.round(d * desirable_weight / u, 2).alias("und_weight_upper"),
    )
    in_range = (
        ((F.col("des_weight_lower") <= desirable_weight) & (F.lit(desirable_weight) <= F.col("des_weight_upper")))
        | ((F.col("und_weight_lower") <= undesirable_weight) & (F.lit(undesirable_weight) <= F.col("und_weight_upper")))
        | (F.col("num_desirable") == F.col("num_undesirable"))
    )
    return out.withColumn("weights_ok", in_range)
