"""Preference / log-probability analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import preference as pf
from ..operators import tokens as tk
from ..sources import views as vw
from ..sources.views import build_sql, with_views
from . import sft
from .catalog import register
from .prep_queries import tok_sql

BETA = 0.1


def ls(x: str) -> str:
    """log-sigmoid in DuckDB SQL."""
    return f"(least({x}, 0) - ln(1 + exp(-abs({x}))))"


def sg(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def sp(x: str) -> str:
    return f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


def _sig_sql(x: str, beta: float, eps: float) -> str:
    return f"(-{ls(f'{beta} * ({x})')} * {1 - eps} - {ls(f'-{beta} * ({x})')} * {eps})"


Z = "((c - r) - (c0 - r0))"
CR = "(c - c0)"
RR = "(r - r0)"

_LOSS_SQL = {
    "sigmoid": _sig_sql(Z, BETA, 0.0),
    "sigmoid_smooth": _sig_sql(Z, BETA, 0.1),
    "robust": f"((-{ls(f'{BETA} * {Z}')} * 0.9 + {ls(f'-{BETA} * {Z}')} * 0.1) / 0.8)",
    "exo_pair": f"({sg(f'{BETA} * {Z}')} * ({ls(f'{BETA} * {Z}')} - ln(1 - 0.001)) + {sg(f'-{BETA} * {Z}')} * ({ls(f'-{BETA} * {Z}')} - ln(0.001)))",
    "hinge": f"greatest(0.0, 1 - {BETA} * {Z})",
    "ipo": f"pow({Z} - 1 / (2 * {BETA}), 2)",
    "sppo_hard": f"(pow({CR} - 0.5 / {BETA}, 2) + pow({RR} + 0.5 / {BETA}, 2))",
    "nca_pair": f"(-{ls(f'{CR} * {BETA}')} - 0.5 * {ls(f'-{CR} * {BETA}')} - 0.5 * {ls(f'-{RR} * {BETA}')})",
    "apo_zero": f"((1 - {sg(f'{BETA} * {CR}')}) + {sg(f'{BETA} * {RR}')})",
    "apo_down": f"({sg(f'{BETA} * {CR}')} + (1 - {sg(f'{BETA} * ({CR} - {RR})')}))",
    "discopop": f"(-{ls(f'{Z} * {BETA}')} * (1 - {sg(f'{Z} * {BETA} / 0.05')}) + exp(-({Z} * {BETA})) * {sg(f'{Z} * {BETA} / 0.05')})",
    "alpha_sigmoid": _sig_sql(f"(exp(least({RR} * -1.0, 88.72283935546875)) - exp(least({CR} * -1.0, 88.72283935546875))) / 1.0", BETA, 0.0),
    "js_sigmoid": _sig_sql(f"({Z} - ({sp(CR)} - {sp(RR)}))", BETA, 0.0),
}


def _losses(df):
    cols = {
        "sigmoid": pf.pair_loss("sigmoid", BETA),
        "sigmoid_smooth": pf.pair_loss("sigmoid", BETA, 0.1),
        "robust": pf.pair_loss("robust", BETA, 0.1),
        "exo_pair": pf.pair_loss("exo_pair", BETA),
        "hinge": pf.pair_loss("hinge", BETA),
        "ipo": pf.pair_loss("ipo", BETA),
        "sppo_hard": pf.pair_loss("sppo_hard", BETA),
        "nca_pair": pf.pair_loss("nca_pair", BETA),
        "apo_zero": pf.pair_loss("apo_zero", BETA),
        "apo_down": pf.pair_loss("apo_down", BETA),
        "discopop": pf.pair_loss("discopop", BETA),
        "alpha_sigmoid": pf.pair_loss("sigmoid", BETA, divergence="alpha"),
        "js_sigmoid": pf.pair_loss("sigmoid", BETA, divergence="js"),
    }
    return df.select("example_id", *[v.alias(k) for k, v in cols.items()])


@register("pair_losses", with_views(
    "SELECT example_id, " + ", ".join(f"{v} AS {k}" for k, v in _LOSS_SQL.items()) + " FROM logps", "logps"))
def pair_losses(spark, d):
    """A21 + F8: every row-wise pair objective (stable log-sigmoid; alpha / JS divergence variants) over logged log-probs."""
    return _losses(vw.logps(spark, d))


@register("dpo_report", with_views(
    f"""SELECT step, avg({_LOSS_SQL['sigmoid']}) AS loss, avg({BETA} * {CR}) AS rewards_chosen, avg({BETA} * {RR}) AS rewards_rejected,
    avg(CASE WHEN {BETA} * {CR} > {BETA} * {RR} THEN 1.0 ELSE 0.0 END) AS rewards_accuracies,
    avg({BETA} * {CR} - {BETA} * {RR}) AS rewards_margins, avg(c) AS logps_chosen, avg(r) AS logps_rejected
    FROM logps GROUP BY step""", "logps"))
def dpo_report(spark, d):
    """A7 + A21: per-step preference metrics with the sigmoid objective."""
    lp = vw.logps(spark, d)
    return pf.preference_report(lp, pf.pair_loss("sigmoid", BETA), BETA)


@register("pair_loss_mixture", with_views(
    f"""SELECT step, avg(0.8 * ({_LOSS_SQL['sigmoid']}) + 0.2 * ({_LOSS_SQL['hinge']}) + ({_LOSS_SQL['ipo']}) + 0.5 * (-c)) AS loss,
    avg(2.0 * {BETA} * {CR}) AS rewards_chosen, avg(2.0 * {BETA} * {RR}) AS rewards_rejected,
    avg(CASE WHEN 2.0 * {BETA} * {CR} > 2.0 * {BETA} * {RR} THEN 1.0 ELSE 0.0 END) AS rewards_accuracies,
    avg(2.0 * {BETA} * {CR} - 2.0 * {BETA} * {RR}) AS rewards_margins FROM logps GROUP BY step""", "logps"))
def pair_loss_mixture(spark, d):
    """A21 with three objectives at weights 0.8, 0.2 and 1, and half of the chosen
    answer's negative log-likelihood."""
    lp = vw.logps(spark, d).withColumn("nll", -F.col("c"))
    return pf.mixed_pair_report(lp, {"sigmoid": 0.8, "hinge": 0.2, "ipo": None}, BETA, nll="nll", rpo_alpha=0.5)


@register("bco_pair_loss", build_sql(["logps"], [
    ("per", f"SELECT step, sum({BETA} * {CR} + {BETA} * {RR}) AS s, count(*) * 2 AS n FROM logps GROUP BY step"),
    ("run", "SELECT step, sum(s) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / "
            "sum(n) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS delta FROM per")],
    f"SELECT step, avg(-{ls(f'{BETA} * {CR} - delta')} - {ls(f'-({BETA} * {RR} - delta)')}) AS loss, max(delta) AS delta "
    "FROM logps JOIN run USING (step) GROUP BY step"))
def bco_pair_loss(spark, d):
    """A21 ``bco_pair`` + A12: objective against the running mean reward."""
    lp = vw.logps(spark, d)
    run = pf.running_reward_mean(lp, BETA)
    j = lp.join(run, "step")
    loss = pf.pair_loss("bco_pair", BETA, delta=F.col("delta"))
    return j.groupBy("step").agg(F.avg(loss).alias("loss"), F.max("delta").alias("delta"))


def _aot_sql(a: str, b: str) -> str:
    return build_sql(["logps"], [
        ("la", f"SELECT step, {a} AS v, row_number() OVER (PARTITION BY step ORDER BY {a}, example_id) AS rk FROM logps"),
        ("lb", f"SELECT step, {b} AS v, row_number() OVER (PARTITION BY step ORDER BY {b}, example_id) AS rk FROM logps")],
        f"SELECT la.step, avg({_sig_sql('la.v - lb.v', BETA, 0.0)}) AS loss, CAST(count(*) AS BIGINT) AS n "
        "FROM la JOIN lb ON la.step = lb.step AND la.rk = lb.rk GROUP BY la.step")


def _aot(spark, d, kind):
    lp = vw.logps(spark, d)
    dl = pf.rank_matched_delta(lp, kind)
    loss = pf.pair_loss(kind, BETA, aot_delta=F.col("aot_delta"))
    return dl.groupBy("step").agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))


@register("aot_pair_loss", _aot_sql("c - c0", "r - r0"))
def aot_pair_loss(spark, d):
    """A21 ``aot_pair`` via J5: sorted chosen vs sorted rejected log-ratios per step."""
    return _aot(spark, d, "aot_pair")


@register("aot_loss", _aot_sql("c - r", "c0 - r0"))
def aot_loss(spark, d):
    """A21 ``aot`` via J5: sorted policy vs sorted reference log-ratios per step."""
    return _aot(spark, d, "aot")


def _unpaired(spark, d):
    """Unpaired rows from logged pairs plus their KL partner (J2: the answer of
    the previous example in the same batch, batch = generation group)."""
    # what the rotation lays out is written: the lengths aren't needed after it
    lp = vw.logps(spark, d).drop("completion_len", "rejected_len")
    rot = jn.rotate_partners(lp, "group_id", "sample_no", ["c", "c0"])
    side = lambda label, lp, lp0: F.struct(F.lit(label).alias("label"), F.col(lp).alias("lp"), F.col(lp0).alias("lp0"))
    both = F.inline(F.array(side(True, "c", "c0"), side(False, "r", "r0")))
    return rot.select("example_id", "step", F.col("KL_c").alias("kl_lp"), F.col("KL_c0").alias("kl_lp0"), both)


_UNPAIRED_CTES = [
    ("rot", "SELECT *, coalesce(lag(c) OVER w, last(c) OVER wa) AS kc, coalesce(lag(c0) OVER w, last(c0) OVER wa) AS kc0 FROM logps "
            "WINDOW w AS (PARTITION BY group_id ORDER BY sample_no), "
            "wa AS (PARTITION BY group_id ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("up", "SELECT example_id, step, true AS label, c AS lp, c0 AS lp0, kc AS kl_lp, kc0 AS kl_lp0 FROM rot "
           "UNION ALL SELECT example_id, step, false, r, r0, kc, kc0 FROM rot"),
    ("kl", "SELECT step, greatest(avg(kl_lp - kl_lp0), 0.0) AS kl FROM up GROUP BY step"),
]


@register("kl_partners", build_sql(["logps"], _UNPAIRED_CTES[:1],
    "SELECT example_id, kc AS kl_c, kc0 AS kl_c0 FROM rot"))
def kl_partners(spark, d):
    """Every example paired with the previous answer of its batch (wrapping around)."""
    lp = vw.logps(spark, d)
    rot = jn.rotate_partners(lp, "group_id", "sample_no", ["c", "c0"])
    return rot.select("example_id", F.col("KL_c").alias("kl_c"), F.col("KL_c0").alias("kl_c0"))


def _kto_sql(loss_type: str) -> str:
    if loss_type == "kto":
        des, und = f"1 - {sg(f'{BETA} * ((lp - lp0) - kl)')}", f"1 - {sg(f'{BETA} * (kl - (lp - lp0))')}"
    else:
        des, und = f"1 - {sg(f'{BETA} * (lp - lp0)')}", sg(f"{BETA} * (lp - lp0)")
    return build_sql(["logps"], _UNPAIRED_CTES, f"""
    SELECT step, loss, kl, n_chosen, n_rejected, cs / nullif(n_chosen, 0) AS rewards_chosen, rs / nullif(n_rejected, 0) AS rewards_rejected,
           cs / nullif(n_chosen, 0) - rs / nullif(n_rejected, 0) AS rewards_margins,
           cl / nullif(n_chosen, 0) AS logps_chosen, rl / nullif(n_rejected, 0) AS logps_rejected
    FROM (SELECT step, avg(CASE WHEN label THEN ({des}) * 1.0 ELSE ({und}) * 1.33 END) AS loss, max(kl) AS kl,
                 sum(CASE WHEN label THEN {BETA} * (lp - lp0) END) AS cs, count(CASE WHEN label THEN 1 END) AS n_chosen,
                 sum(CASE WHEN NOT label THEN {BETA} * (lp - lp0) END) AS rs, count(CASE WHEN NOT label THEN 1 END) AS n_rejected,
                 sum(CASE WHEN label THEN lp END) AS cl, sum(CASE WHEN NOT label THEN lp END) AS rl
          FROM up JOIN kl USING (step) GROUP BY step)""")


def _kto(spark, d, loss_type):
    up = _unpaired(spark, d)
    kl = pf.kl_from_mismatched(up)
    # one row a step, broadcast: else the rows would meet in a task a step
    return pf.unpaired_report(up.join(F.broadcast(kl), "step"), BETA, F.col("kl"), undesirable_weight=1.33, loss_type=loss_type)


@register("kto_report", _kto_sql("kto"))
def kto_report(spark, d):
    """A8 + A23: KTO objective with the clamped KL estimate from J2 partners."""
    return _kto(spark, d, "kto")


@register("apo_unpaired_report", _kto_sql("apo_zero_unpaired"))
def apo_unpaired_report(spark, d):
    """A23 ``apo_zero_unpaired`` with class weights."""
    return _kto(spark, d, "apo_zero_unpaired")


@register("pairwise_accuracy", with_views(
    "SELECT step, avg(CASE WHEN score_0 <> score_1 THEN CASE WHEN (CASE WHEN score_1 > score_0 THEN 1 ELSE 0 END) = judge_c THEN 1.0 ELSE 0.0 END END) AS accuracy, "
    "CAST(count(CASE WHEN score_0 = score_1 THEN 1 END) AS BIGINT) AS ties FROM verdicts GROUP BY step", "verdicts"))
def pairwise_accuracy(spark, d):
    """Pairwise accuracy with ties dropped and counted."""
    v = vw.verdicts(spark, d)
    return pf.pairwise_accuracy(v, "score_0", "score_1", "judge_c", ["step"])


@register("token_accuracy", tok_sql(
    """SELECT CAST(sum(c) AS BIGINT) AS correct, CAST(sum(v) AS BIGINT) AS valid, coalesce(sum(c) / nullif(sum(v), 0), 0.0) AS accuracy FROM (
         SELECT list_sum(list_transform(list_zip(pr, lb), lambda z: CASE WHEN z[2] <> -100 AND z[1] = z[2] THEN 1 ELSE 0 END)) AS c,
                list_sum(list_transform(lb, lambda x: CASE WHEN x <> -100 THEN 1 ELSE 0 END)) AS v
         FROM (SELECT list_transform(input_ids, lambda x: CASE WHEN x % 3 = 0 THEN 0 ELSE x END) AS pr,
                      list_transform(input_ids, lambda x, i: CASE WHEN i <= len(prompt_ids) THEN -100 ELSE x END) AS lb FROM ids))"""))
def token_accuracy(spark, d):
    """A10: token accuracy over labels that are not -100 (predictions: a
    stand-in that misses every id divisible by 3)."""
    t = sft.tokenized(spark, d)
    t = t.select(
        F.transform("input_ids", lambda x: F.when(x % 3 == 0, F.lit(0)).otherwise(x)).alias("preds"),
        tk.lm_labels("input_ids", "completion_mask").alias("labels"),
    )
    return pf.token_accuracy(t, "preds", "labels")


@register("reward_model_report", with_views(
    f"""SELECT step, least(min({CR}), min({RR})) AS min_reward, (sum({CR}) + sum({RR})) / (2 * count(*)) AS mean_reward,
    greatest(max({CR}), max({RR})) AS max_reward, avg(CASE WHEN {CR} > {RR} THEN 1.0 ELSE 0.0 END) AS accuracy,
    avg({CR} - {RR}) AS margin, avg(-{ls(f'{CR} - {RR} - rejected_len / 100.0')}) + 0.01 * avg(pow({CR} + {RR}, 2)) AS loss
    FROM logps GROUP BY step""", "logps"))
def reward_model_report(spark, d):
    """Reward-model metrics with a per-pair margin and reward centering."""
    lp = vw.logps(spark, d).withColumn("rc", F.col("c") - F.col("c0")).withColumn("rr", F.col("r") - F.col("r0"))
    lp = lp.withColumn("margin", F.col("rejected_len") / 100.0)
    return pf.reward_model_report(lp, "rc", "rr", margin="margin", center_coef=0.01)


@register("running_moments", with_views(
    """SELECT step, n, batch_mean, batch_std, CAST(cnt AS BIGINT) AS count, s / cnt AS mean, (q - s * s / cnt) / cnt AS var,
              sqrt((q - s * s / cnt) / cnt * cnt / nullif(cnt - 1, 0)) AS std
       FROM (SELECT step, n, batch_mean, batch_std,
                    sum(n) OVER w AS cnt, sum(s) OVER w AS s, sum(q) OVER w AS q
             FROM (SELECT step, CAST(count(reward_a) AS BIGINT) AS n, avg(reward_a) AS batch_mean, stddev_samp(reward_a) AS batch_std,
                          sum(reward_a) AS s, sum(reward_a * reward_a) AS q FROM rollouts GROUP BY step)
             WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", "rollouts"))
def running_moments(spark, d):
    """Batch and running mean / variance / std of a reward stream."""
    return pf.running_moments(vw.rollouts(spark, d), "reward_a")


@register("running_moments_shifted", with_views(
    """SELECT s.step, any_value(s.n) AS n, any_value(s.batch_mean) AS batch_mean, any_value(s.batch_std) AS batch_std, count(x) AS count,
              avg(x) - 1e6 AS mean, var_pop(x) AS var, stddev_samp(x) AS std
       FROM (SELECT step, count(x) AS n, avg(x) - 1e6 AS batch_mean, stddev_samp(x) AS batch_std FROM (SELECT step, reward_a + 1e6 AS x FROM rollouts) GROUP BY step) s
       JOIN (SELECT step, reward_a + 1e6 AS x FROM rollouts) r ON r.step <= s.step GROUP BY s.step""", "rollouts"))
def running_moments_shifted(spark, d):
    """A12 on rewards a million away from 0: no digits are lost."""
    m = pf.running_moments(vw.rollouts(spark, d).withColumn("far", F.col("reward_a") + 1e6), "far")
    return m.withColumns({"mean": F.col("mean") - 1e6, "batch_mean": F.col("batch_mean") - 1e6})


@register("kl_k3", with_views(
    """SELECT step, avg(k) AS kl FROM (
         SELECT step, list_sum(list_transform(list_zip(logps, ref_logps, mask), lambda z: (exp(z[2] - z[1]) - (z[2] - z[1]) - 1) * z[3]))
                / nullif(list_sum(mask), 0) AS k FROM rtokens) GROUP BY step""", "rtokens"))
def kl_k3(spark, d):
    """k3 KL to the reference, masked mean per sequence, averaged per step."""
    t = vw.rtokens(spark, d)
    per_tok = F.zip_with("logps", "ref_logps", lambda a, b: pf.k3_kl(a, b))
    k = pf.masked_mean_per_row(per_tok, F.transform("mask", lambda m: m.cast("double")))
    return t.groupBy("step").agg(F.avg(k).alias("kl"))


@register("ld_logps", with_views(
    "SELECT example_id, list_sum(list_transform(logps, lambda x, i: CASE WHEN i - 1 < 3 THEN x ELSE x * 0.5 END)) AS ld_logp FROM rtokens",
    "rtokens"))
def ld_logps(spark, d):
    """Length-desensitised log-prob sum (first 3 tokens full, tail × 0.5)."""
    t = vw.rtokens(spark, d)
    return t.select("example_id", pf.ld_logp(F.col("logps"), 3, 0.5).alias("ld_logp"))


_LO = "((c - r) - (ln(1 - exp(c)) - ln(1 - exp(r))))"


@register("orpo_report", with_views(
    f"SELECT step, avg({ls(_LO)}) AS log_odds_ratio, avg({_LO}) AS log_odds_chosen, avg({BETA} * {ls(_LO)}) AS or_term, "
    f"avg({BETA} * c) AS rewards_chosen, avg({BETA} * r) AS rewards_rejected FROM logps GROUP BY step", "logps"))
def orpo_report(spark, d):
    """A24 + F8: odds-ratio term and log-odds ``log1p(-exp)`` per step (reference-free rewards β·logp)."""
    lp = vw.logps(spark, d)
    o = pf.odds_ratio(F.col("c"), F.col("r"), BETA)
    return lp.groupBy("step").agg(
        F.avg(o["ratio"]).alias("log_odds_ratio"), F.avg(o["log_odds"]).alias("log_odds_chosen"),
        F.avg(o["or_loss"]).alias("or_term"), F.avg(F.lit(BETA) * F.col("c")).alias("rewards_chosen"),
        F.avg(F.lit(BETA) * F.col("r")).alias("rewards_rejected"),
    )


_ALPHA_L = "((1 - pow(exp(c), -0.5)) / 0.5 - (1 - pow(exp(r), -0.5)) / 0.5)"


@register("cpo_losses", with_views(
    f"SELECT example_id, {_sig_sql('(c - r) - 0.5 / 0.1', BETA, 0.0)} AS simpo, {_sig_sql('c - r', BETA, 0.0)} AS sigmoid, "
    f"greatest(0.0, 1 - {BETA} * (c - r)) AS hinge, pow((c - r) - 1 / (2 * {BETA}), 2) AS ipo, "
    f"{_sig_sql(_ALPHA_L, BETA, 0.0)} AS alpha_sigmoid FROM logps", "logps"))
def cpo_losses(spark, d):
    """Reference-free objectives (simpo γ=0.5, sigmoid, hinge, ipo, α-transformed sigmoid)."""
    lp = vw.logps(spark, d)
    c, r = F.col("c"), F.col("r")
    return lp.select(
        "example_id",
        pf.cpo_loss(c, r, "simpo", BETA)["loss"].alias("simpo"),
        pf.cpo_loss(c, r, "sigmoid", BETA)["loss"].alias("sigmoid"),
        pf.cpo_loss(c, r, "hinge", BETA)["loss"].alias("hinge"),
        pf.cpo_loss(c, r, "ipo", BETA)["loss"].alias("ipo"),
        pf.cpo_loss(c, r, "sigmoid", BETA, alpha=0.5)["loss"].alias("alpha_sigmoid"),
    )


@register("class_balance", """
SELECT num_desirable, num_undesirable, round(num_undesirable * 1.0 / num_desirable, 2) AS des_weight_lower,
       round(num_undesirable * 1.0 / num_desirable * 1.33, 2) AS des_weight_upper,
       round(num_desirable * 1.0 / num_undesirable / 1.33, 2) AS und_weight_lower,
       round(num_desirable * 1.0 / num_undesirable, 2) AS und_weight_upper,
       (round(num_undesirable * 1.0 / num_desirable, 2) <= 1.0 AND 1.0 <= round(num_undesirable * 1.0 / num_desirable * 1.33, 2))
       OR (round(num_desirable * 1.0 / num_undesirable / 1.33, 2) <= 1.0 AND 1.0 <= round(num_desirable * 1.0 / num_undesirable, 2))
       OR num_desirable = num_undesirable AS weights_ok
FROM (SELECT CAST(greatest(count(CASE WHEN quality = 1 THEN 1 END), 1) AS BIGINT) AS num_desirable,
             CAST(greatest(count(CASE WHEN quality <> 1 THEN 1 END), 1) AS BIGINT) AS num_undesirable FROM labels)
""")
def class_balance(spark, d):
    """Class counts of an unpaired dataset and recommended loss weights."""
    lab = vw.table(spark, d, "labels").select((F.col("quality") == 1).alias("label"))
    return pf.class_balance(lab)


@register("ref_logp_join", with_views(
    "SELECT step, CAST(count(*) AS BIGINT) AS n, avg(c - c0) AS chosen_logratio, avg(r - r0) AS rejected_logratio FROM logps GROUP BY step",
    "logps"))
def ref_logp_join(spark, d):
    """Attach precomputed reference log-probs to the policy rows by key."""
    lp = vw.logps(spark, d)
    pol = lp.select("example_id", "step", "c", "r")
    ref = lp.select("example_id", "c0", "r0")
    joined, missing = jn.attach_reference_logps(pol, ref)
    return joined.groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("c") - F.col("c0")).alias("chosen_logratio"),
        F.avg(F.col("r") - F.col("r0")).alias("rejected_logratio"),
    )


@register("ref_policy_pairs", with_views(
    "SELECT group_id AS prompt_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(completion)) AS BIGINT) AS policy_chars, "
    "CAST(sum(length(solution)) AS BIGINT) AS reference_chars FROM completions GROUP BY group_id", "completions"))
def ref_policy_pairs(spark, d):
    """Policy and reference completions of the same prompt, lined up by key."""
    c = vw.completions(spark, d)
    pol = c.select(F.col("example_id"), F.col("group_id").alias("prompt_id"), F.col("completion"))
    ref = c.select(F.col("example_id"), F.col("solution"))
    j = jn.pair_with_reference(pol, ref, "example_id")
    return j.groupBy("prompt_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("completion")).alias("policy_chars"),
        F.sum(F.length("solution")).alias("reference_chars"),
    )


@register("token_accuracy_next", tok_sql(
    """SELECT CAST(sum(c) AS BIGINT) AS correct, CAST(sum(v) AS BIGINT) AS valid, coalesce(sum(c) / nullif(sum(v), 0), 0.0) AS accuracy FROM (
         SELECT list_sum(list_transform(list_zip(pr, lb), lambda z: CASE WHEN z[2] <> -100 AND z[1] = z[2] THEN 1 ELSE 0 END)) AS c,
                list_sum(list_transform(lb, lambda x: CASE WHEN x <> -100 THEN 1 ELSE 0 END)) AS v
         FROM (SELECT list_slice(input_ids, 1, len(input_ids) - 1) AS pr,
                      list_slice(list_transform(input_ids, lambda x, i: CASE WHEN i <= len(prompt_ids) THEN -100 ELSE x END), 2, len(input_ids)) AS lb FROM ids))"""))
def token_accuracy_next(spark, d):
    """A10 in next-token form: the stand-in prediction at each place is that
    place's own token, right where a token repeats."""
    t = sft.tokenized(spark, d)
    t = t.select(F.col("input_ids").alias("preds"), tk.lm_labels("input_ids", "completion_mask").alias("labels"))
    return pf.token_accuracy(t, "preds", "labels", next_token=True)
