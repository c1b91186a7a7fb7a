"""Token-level policy diagnostics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy as po
from ..operators import rollouts as ro
from ..sources import views as vw
from ..sources.views import build_sql, with_views
from .catalog import register

_ADV_CTES = [
    ("ga", "SELECT group_id, avg(reward_a) AS gm, stddev_samp(reward_a) AS gs FROM rtokens GROUP BY group_id"),
    ("rt", "SELECT rtokens.*, coalesce((reward_a - gm) / (gs + 1e-4), 0.0) AS advantage FROM rtokens JOIN ga USING (group_id)"),
]


def _rt(spark, d):
    t = vw.rtokens(spark, d).withColumn("reward", F.col("reward_a"))
    g = ro.group_advantages(t, scale="group")
    return g.withColumn("advantage", F.coalesce("advantage", F.lit(0.0))).drop("group_mean", "group_std", "group_size", "zero_std", "reward")


def rt_sql(select: str, extra=()) -> str:
    return build_sql(["rollouts", "rtokens"], _ADV_CTES + list(extra), select)


# A13 ---------------------------------------------------------------------
_MOM = ("mom", """SELECT step, s / n AS mean, (q / n - (s / n) * (s / n)) * n / nullif(n - 1, 0) AS var FROM (
    SELECT step, sum(list_sum(list_transform(list_zip("values", mask), lambda z: z[1] * z[2]))) AS s,
           sum(list_sum(list_transform(list_zip("values", mask), lambda z: z[1] * z[1] * z[2]))) AS q,
           sum(list_sum(mask)) AS n FROM rtokens GROUP BY step)""")


@register("masked_whiten", rt_sql(
    """SELECT example_id, list_sum(list_transform("values", lambda x: (x - mean) / sqrt(var + 1e-8))) AS whitened_sum
       FROM rtokens JOIN mom USING (step)""", [_MOM]))
def masked_whiten(spark, d):
    """Values whitened with the step's masked mean and unbiased variance."""
    t = vw.rtokens(spark, d)
    w = po.masked_whiten(t, "values", "mask", out="w")
    return w.select("example_id", F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("whitened_sum"))


@register("masked_moments_shifted", with_views(
    """SELECT step, avg(x) - 1e6 AS mean, var_samp(x) AS var, CAST(count(x) AS DOUBLE) AS mask_sum
       FROM (SELECT step, unnest(list_transform(list_filter(list_zip("values", mask), lambda z: z[2] = 1), lambda z: z[1] + 1e6)) AS x FROM rtokens) GROUP BY step""", "rtokens"))
def masked_moments_shifted(spark, d):
    """A13 on values a million away from 0: no digits are lost."""
    t = vw.rtokens(spark, d).withColumn("far", F.transform("values", lambda v: v + 1e6))
    return po.masked_moments(t, "far", "mask").withColumn("mean", F.col("mean") - 1e6)


# A14 + A15 -----------------------------------------------------------------
_KLR = "list_transform(list_zip(logps, ref_logps), lambda z, i: -0.05 * (exp(z[2] - z[1]) - 1 - (z[2] - z[1])) + CASE WHEN i - 1 = list_sum(mask) - 1 THEN reward_a / 50.0 ELSE 0.0 END)"


@register("kl_token_rewards", with_views(
    f"SELECT example_id, list_sum({_KLR}) AS reward_sum, ({_KLR})[-1] AS last_reward FROM rtokens", "rtokens"))
def kl_token_rewards(spark, d):
    """k3 KL-shaped token rewards (coef 0.05) plus the score at the last valid token."""
    t = vw.rtokens(spark, d).withColumn("score", F.col("reward_a") / 50.0)
    r = po.kl_token_rewards("logps", "ref_logps", "mask", "score", 0.05, "k3")
    return t.select("example_id", F.aggregate(r, F.lit(0.0), lambda a, x: a + x).alias("reward_sum"),
                    F.try_element_at(r, F.lit(-1)).alias("last_reward"))


GAMMA, LAM = 0.99, 0.95
# closed form of the recursion: A_t = Σ_{k>=t} (γλ)^{k-t} δ_k, δ_k = r_k + γ V_{k+1} - V_k
_DELTA = ("dl", f"""SELECT example_id, step, "values" AS v, list_transform(range(len(r)), lambda k:
    r[k + 1] + {GAMMA} * coalesce("values"[k + 2], 0.0) - "values"[k + 1]) AS delta
    FROM (SELECT example_id, step, "values", {_KLR} AS r FROM rtokens)""")
_ADVS = ("av", f"""SELECT example_id, step, v, list_transform(range(len(delta)), lambda t:
    list_sum(list_transform(range(t, len(delta)), lambda k: pow({GAMMA * LAM}, k - t) * delta[k + 1]))) AS adv FROM dl""")


def _gae(spark, d):
    t = vw.rtokens(spark, d).withColumn("score", F.col("reward_a") / 50.0)
    t = t.withColumn("rewards", po.kl_token_rewards("logps", "ref_logps", "mask", "score", 0.05, "k3"))
    adv, ret = po.gae("rewards", "values", GAMMA, LAM)
    return t.withColumn("advantages", adv).withColumn("returns", ret)


@register("gae_advantages", build_sql(["rtokens"], [_DELTA, _ADVS],
    "SELECT example_id, adv[1] AS adv_first, list_sum(adv) AS adv_sum, list_sum(list_transform(list_zip(adv, v), lambda z: z[1] + z[2])) AS return_sum FROM av"))
def gae_advantages(spark, d):
    """A15 (with A14 rewards): generalised advantages and returns (γ=0.99, λ=0.95)."""
    g = _gae(spark, d)
    s = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return g.select("example_id", F.element_at("advantages", 1).alias("adv_first"), s(F.col("advantages")).alias("adv_sum"),
                    s(F.col("returns")).alias("return_sum"))


@register("gae_long_tokens", build_sql(["rtokens"], [_DELTA, _ADVS],
    "SELECT example_id, adv[1] AS adv_first, list_sum(adv) AS adv_sum, list_sum(list_transform(list_zip(adv, v), lambda z: z[1] + z[2])) AS return_sum FROM av"))
def gae_long_tokens(spark, d):
    """A15 with a row for each token: the same advantages by a scan over range partitions."""
    t = vw.rtokens(spark, d).withColumn("score", F.col("reward_a") / 50.0)
    r = po.kl_token_rewards("logps", "ref_logps", "mask", "score", 0.05, "k3")
    # a trajectory's key is two numbers, not the text they make: shorter rows to sort and write
    t = t.select("group_id", F.col("sample_no").cast("int").alias("sample_no"), F.posexplode(F.arrays_zip(r.alias("r"), F.col("values").alias("v"))).alias("t", "z"))
    g = po.gae_long(t.select("group_id", "sample_no", "t", "z.r", "z.v"), ["group_id", "sample_no"], "t", "r", "v", GAMMA, LAM)
    g = g.groupBy("group_id", "sample_no").agg(F.max(F.when(F.col("t") == 0, F.col("advantage"))).alias("adv_first"), F.sum("advantage").alias("adv_sum"), F.sum("ret").alias("return_sum"))
    return g.select(F.concat_ws("-", "group_id", "sample_no").alias("example_id"), "adv_first", "adv_sum", "return_sum")


@register("gae_event_trajectories", build_sql([], [
    ("e", "SELECT event_type, value AS r, value / 3.0 AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t, event_id FROM events"),
    ("dl", f"SELECT *, r + {GAMMA} * coalesce(lead(v) OVER (PARTITION BY event_type ORDER BY t), 0.0) - v AS delta FROM e"),
    # beyond 700 steps a term is below 1e-18 of the first
    ("av", f"SELECT a.event_id, any_value(a.v) AS v, sum(pow({GAMMA * LAM}, b.t - a.t) * b.delta) AS adv FROM dl a JOIN dl b ON a.event_type = b.event_type AND b.t BETWEEN a.t AND a.t + 700 GROUP BY a.event_id")],
    "SELECT event_id, adv AS advantage, adv + v AS ret FROM av"))
def gae_event_trajectories(spark, d):
    """A15 over five trajectories that hold all events between them."""
    ev = vw.table(spark, d, "events").select("event_id", "event_type", F.struct("ts", "event_id").alias("t"), F.col("value").alias("r"), (F.col("value") / 3.0).alias("v"))
    return po.gae_long(ev, ["event_type"], "t", "r", "v", GAMMA, LAM).select("event_id", "advantage", "ret")


@register("ppo_report", build_sql(["rtokens"], [_DELTA, _ADVS],
    """SELECT step, sum(pg) / sum(n) AS pg_loss, sum(pgc) / sum(n) AS pg_clipfrac, 0.5 * sum(d2) / sum(ntok) AS approxkl,
              sum(ratio) / sum(n) AS ratio_mean, 0.5 * sum(vf) / sum(n) AS vf_loss, sum(vfc) / sum(n) AS vf_clipfrac, sum(ent) / sum(n) AS entropy
       FROM (SELECT step,
         list_sum(list_transform(z, lambda x: greatest(-x.a * exp(x.lp - x.ol), -x.a * least(greatest(exp(x.lp - x.ol), 0.8), 1.2)) * x.m)) AS pg,
         list_sum(list_transform(z, lambda x: CASE WHEN -x.a * least(greatest(exp(x.lp - x.ol), 0.8), 1.2) > -x.a * exp(x.lp - x.ol) THEN 1.0 ELSE 0.0 END * x.m)) AS pgc,
         list_sum(list_transform(z, lambda x: exp(x.lp - x.ol) * x.m)) AS ratio,
         list_sum(list_transform(z, lambda x: (x.lp - x.ol) * (x.lp - x.ol))) AS d2, len(z) AS ntok,
         list_sum(list_transform(z, lambda x: greatest(pow(x.p - x.R, 2), pow(least(greatest(x.p, x.v - 0.2), x.v + 0.2) - x.R, 2)) * x.m)) AS vf,
         list_sum(list_transform(z, lambda x: CASE WHEN pow(least(greatest(x.p, x.v - 0.2), x.v + 0.2) - x.R, 2) > pow(x.p - x.R, 2) THEN 1.0 ELSE 0.0 END * x.m)) AS vfc,
         list_sum(list_transform(z, lambda x: x.e * x.m)) AS ent, list_sum(list_transform(z, lambda x: x.m)) AS n
       FROM (SELECT step, list_transform(range(len(adv)), lambda k: {'lp': logps[k + 1], 'ol': old_logps[k + 1], 'a': adv[k + 1],
               'v': v[k + 1], 'p': v[k + 1] * 0.9, 'R': adv[k + 1] + v[k + 1], 'e': entropies[k + 1], 'm': mask[k + 1]}) AS z
             FROM av JOIN rtokens USING (example_id, step)))
       GROUP BY step"""))
def ppo_report(spark, d):
    """PPO policy/value diagnostics with GAE advantages and returns
    (value predictions = 0.9·values; clip ranges 0.2)."""
    g = _gae(spark, d).withColumn("vpred", F.transform("values", lambda v: v * 0.9))
    return po.ppo_report(g)


_HIT = "list_sum(list_transform(list_zip(logps, old_logps, mask), lambda z: CASE WHEN {} THEN z[3] ELSE 0 END))"


@register("clip_ratios", rt_sql(
    """SELECT step, avg(low / n) AS low_mean, min(low / n) AS low_min, avg(high / n) AS high_mean, max(high / n) AS high_max, avg((low + high) / n) AS region_mean
       FROM (SELECT step, group_id % 8 AS batch, sum(low) AS low, sum(high) AS high, sum(n) AS n FROM per GROUP BY ALL HAVING sum(n) > 0) GROUP BY step""",
    [("per", f"""SELECT step, group_id, CAST({_HIT.format('exp(z[1] - z[2]) < 0.99 AND advantage < 0')} AS DOUBLE) AS low,
        CAST({_HIT.format('exp(z[1] - z[2]) > 0.995 AND advantage > 0')} AS DOUBLE) AS high, CAST(list_sum(mask) AS DOUBLE) AS n FROM rt""")]))
def clip_ratios(spark, d):
    """Clip shares over eight processes' batches a step: means, smallest low and
    largest high share (narrow bounds, as the logged policies are close)."""
    t = _rt(spark, d).withColumn("batch", F.col("group_id") % 8)
    return po.clip_ratio_report(t, epsilon_low=0.01, epsilon_high=-0.005)


# A28 -----------------------------------------------------------------------
_SAMPLES = ("s", """SELECT group_id, sample_no, step, reward_a AS reward, NOT truncated AS eos,
    list_sum(list_transform(list_zip(logps, mask), lambda z: z[1] * z[2])) AS lp, list_sum(list_transform(list_zip(ref_logps, mask), lambda z: z[1] * z[2])) AS rp FROM rtokens""")


def _pair_stats_sql(first_wins: str, scored: bool) -> str:
    side = lambda x, y: f"CASE WHEN {first_wins} THEN {x} ELSE {y} END"
    pairs = f"""SELECT a.step, {side('a.lp', 'b.lp')} AS lw, {side('b.lp', 'a.lp')} AS ll, {side('a.rp', 'b.rp')} AS rw, {side('b.rp', 'a.rp')} AS rl,
        {side('a.reward', 'b.reward')} AS sw, {side('b.reward', 'a.reward')} AS sl, CAST(a.eos AS INT) + CAST(b.eos AS INT) AS eos
        FROM s a JOIN (SELECT group_id, count(*) AS n FROM s GROUP BY group_id) USING (group_id) JOIN s b ON b.group_id = a.group_id AND b.sample_no = (a.sample_no + 1) % n
        WHERE a.sample_no % 2 = 0 AND n >= 2"""
    score = lambda x: f"avg({x})" if scored else "CAST(NULL AS DOUBLE)"
    return build_sql(["rtokens"], [_SAMPLES, ("p", pairs)], f"""SELECT step, count(*) AS pairs, avg(ln(1 + exp(-0.1 * ((lw - ll) - (rw - rl))))) AS loss,
        {score('sw - sl')} AS objective_scores_margin, {score('(sw + sl) / 2')} AS objective_scores, avg(eos / 2.0) AS contain_eos, avg(lw) AS logps_chosen, avg(ll) AS logps_rejected,
        avg((lw - rw + ll - rl) / 2) AS objective_kl, avg(-0.1 * (lw - rw + ll - rl) / 2) AS objective_non_score_reward,
        {score('(sw + sl - 0.1 * (lw - rw + ll - rl)) / 2')} AS objective_rlhf_reward, avg(-(lw + ll) / 2) AS objective_entropy,
        avg(0.1 * (lw - rw)) AS rewards_chosen, avg(0.1 * (ll - rl)) AS rewards_rejected, avg(0.1 * (lw - rw) - 0.1 * (ll - rl)) AS rewards_margins,
        avg(CASE WHEN 0.1 * (lw - rw) > 0.1 * (ll - rl) THEN 1.0 ELSE 0.0 END) AS rewards_accuracies FROM p GROUP BY step""")


def _samples(spark, d):
    t = vw.rtokens(spark, d)
    total = lambda c: F.aggregate(F.zip_with(c, "mask", lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    t = t.select("group_id", "sample_no", "step", F.col("reward_a").alias("reward"), (~F.col("truncated")).alias("has_eos"), total("logps").alias("logp"), total("ref_logps").alias("ref_logp"))
    return t.withColumn("entropy", -F.col("logp"))


@register("online_pair_stats", _pair_stats_sql("a.reward >= b.reward", True))
def online_pair_stats(spark, d):
    """What training logs of the pairs chosen by reward: loss, scores, KL, entropy,
    rewards with and without score, margins."""
    return ro.online_pair_report(_samples(spark, d))


@register("online_pair_stats_judged", _pair_stats_sql("a.rp >= b.rp", False))
def online_pair_stats_judged(spark, d):
    """A28 with a judge in the rewards' place: it ranks the completion first that the
    reference model finds likelier."""
    return ro.online_pair_report(_samples(spark, d), reward=None, first_wins=lambda a, b: a["ref_logp"] >= b["ref_logp"])


# A19 -----------------------------------------------------------------------
@register("entropy_mask", with_views(
    """SELECT step, threshold, CAST(sum(kept) AS BIGINT) AS kept FROM (
         SELECT r.step, t.threshold, list_sum(list_transform(list_zip(entropies, mask), lambda z: CASE WHEN z[2] = 1 AND z[1] * z[2] >= t.threshold THEN 1 ELSE 0 END)) AS kept
         FROM rtokens r JOIN (SELECT step, quantile_cont(e, 0.8) AS threshold FROM
               (SELECT step, unnest(list_transform(list_filter(list_zip(entropies, mask), lambda z: z[2] = 1), lambda z: z[1])) AS e FROM rtokens)
             GROUP BY step) t USING (step)) GROUP BY step, threshold""", "rtokens"))
def entropy_mask(spark, d):
    """High-entropy token mask (top 20 % of valid-token entropies per step, exact quantile)."""
    t = vw.rtokens(spark, d)
    m = po.high_entropy_mask(t, "entropies", "mask", 0.2)
    return m.groupBy("step", "threshold").agg(F.sum(F.aggregate("entropy_mask", F.lit(0), lambda a, x: a + x)).alias("kept"))


@register("sampler_mismatch", with_views(
    """SELECT step, avg(abs(t - s)) AS logp_diff_mean, max(abs(t - s)) AS logp_diff_max,
              min(least(exp(t - s), 2.0)) AS is_ratio_min, avg(least(exp(t - s), 2.0)) AS is_ratio_mean, max(least(exp(t - s), 2.0)) AS is_ratio_max
       FROM (SELECT step, unnest(list_transform(list_filter(list_zip(logps, old_logps, mask), lambda z: z[3] = 1), lambda z: z[1])) AS t,
                    unnest(list_transform(list_filter(list_zip(logps, old_logps, mask), lambda z: z[3] = 1), lambda z: z[2])) AS s FROM rtokens)
       GROUP BY step""", "rtokens"))
def sampler_mismatch(spark, d):
    """Trainer vs sampler log-prob gap and capped (2.0) importance ratios per step."""
    return po.sampler_mismatch(vw.rtokens(spark, d), "logps", "old_logps", "mask", 2.0)


# A20 + A17 -----------------------------------------------------------------
def _policy_sql(loss_type: str, lo: float, hi: float, delta, beta: float, level: str, max_len=None, importance=False, entropy=False) -> str:
    total = "list_sum(list_transform(list_zip(logps, old_logps, mask), lambda y: (y[1] - y[2]) * y[3]))"
    w = {"token": "z.lp - z.ol", "sequence_sum": total}.get(level, f"{total} / greatest(list_sum(mask), 1)")
    c1 = f"exp({w})"
    cm = f"least({c1}, {delta})" if delta is not None else c1
    kl = "(exp(z.rf - z.lp) - (z.rf - z.lp) - 1)"
    if loss_type == "cispo":
        lt = f"(-least({c1}, {hi}) * advantage * z.lp)"
    else:
        lt = f"(-least({cm} * advantage, least(greatest({c1}, {1 - lo}), {1 + hi}) * advantage))"
    if entropy:
        lt = f"({lt} * CASE WHEN z.m = 1 AND z.e * z.m >= threshold THEN 1 ELSE 0 END)"
    if importance:
        lt = f"({lt} * least(exp(z.ol - z.rf), 2.0))"
    if beta:
        lt = f"({lt} + {beta} * {kl})"
    zz = "list_transform(range(len(logps)), lambda k: {'lp': logps[k + 1], 'ol': old_logps[k + 1], 'rf': ref_logps[k + 1], 'm': mask[k + 1], 'e': entropies[k + 1]})"

    def ms(expr):
        return f"list_sum(list_transform({zz}, lambda z: {expr} * z.m))"

    one_ratio = level in ("sequence", "sequence_sum")  # a metric over sequences: each counts once

    def clip(expr):
        return f"list_transform({zz}, lambda z: {expr})[1]" if one_ratio else ms(expr)

    low = f"CASE WHEN {cm} < {1 - lo} AND advantage < 0 THEN 1.0 ELSE 0.0 END"
    high = f"CASE WHEN {cm} > {1 + hi} AND advantage > 0 THEN 1.0 ELSE 0.0 END"
    cis = f"CASE WHEN {c1} > {hi} AND advantage > 0 THEN 1.0 ELSE 0.0 END"
    per = (f"SELECT step, {ms(lt)} AS l, {ms(lt)} / greatest(list_sum(mask), 1) AS lseq, list_sum(mask) AS n, len(mask) AS ntok, "
           f"{clip(low)} AS low, {clip(high)} AS high, {clip(cis)} AS cis, {ms(kl)} AS kl, {ms('z.e')} AS ent FROM rt"
           + (" JOIN thresholds USING (step)" if entropy else ""))
    n = "greatest(sum(n), 1)"
    loss = {"grpo": "avg(lseq)", "bnpo": f"sum(l) / {n}", "dr_grpo": f"sum(l) / (count(*) * {max_len})"}.get(loss_type, "sum(l) / sum(ntok)")
    cols = [f"{loss} AS loss", f"sum(kl) / {n} AS kl", f"sum(ent) / {n} AS entropy"]
    over = "count(*)" if one_ratio else n
    if loss_type == "cispo":
        cols.append(f"sum(cis) / {over} AS cispo_clip_ratio")
    else:
        cols += [f"sum(low) / {over} AS clip_low", f"sum(high) / {over} AS clip_high", f"(sum(low) + sum(high)) / {over} AS clip_region"]
    extra = [("thresholds", "SELECT step, quantile_cont(e, 0.8) AS threshold FROM (SELECT step, unnest(list_transform(list_filter(list_zip(entropies, mask), "
              "lambda z: z[2] = 1), lambda z: z[1])) AS e FROM rtokens) GROUP BY step")] if entropy else []
    return rt_sql(f"SELECT step, {', '.join(cols)} FROM ({per}) GROUP BY step", extra)


_POLICY_CASES = {
    "policy_grpo": dict(loss_type="grpo", lo=0.2, hi=0.28, delta=None, beta=0.04, level="token"),
    "policy_bnpo": dict(loss_type="bnpo", lo=0.2, hi=0.2, delta=1.5, beta=0.0, level="token"),
    "policy_dr_grpo": dict(loss_type="dr_grpo", lo=0.2, hi=0.2, delta=None, beta=0.0, level="token", max_len=16),
    "policy_dapo": dict(loss_type="dapo", lo=0.2, hi=0.28, delta=None, beta=0.0, level="token"),
    "policy_cispo": dict(loss_type="cispo", lo=0.2, hi=1.02, delta=None, beta=0.0, level="token"),
    "policy_sequence_ratio": dict(loss_type="grpo", lo=0.0003, hi=0.0004, delta=None, beta=0.0, level="sequence"),
    "policy_sequence_token": dict(loss_type="grpo", lo=0.0003, hi=0.0004, delta=None, beta=0.0, level="sequence_token"),
    "policy_sequence_sum": dict(loss_type="grpo", lo=0.01, hi=0.01, delta=None, beta=0.0, level="sequence_sum"),
    "policy_importance": dict(loss_type="grpo", lo=0.2, hi=0.2, delta=None, beta=0.04, level="token", importance=True),
    "policy_entropy_mask": dict(loss_type="dapo", lo=0.2, hi=0.28, delta=None, beta=0.0, level="token", entropy=True),
}


def _policy_query(cfg):
    def run(spark, d):
        t = _rt(spark, d)
        if cfg.get("entropy"):
            t = po.high_entropy_mask(t, "entropies", "mask", 0.2)
        if cfg.get("importance"):  # the sampler's factor from logged log-probabilities, capped at 2
            t = t.withColumn("importance", F.zip_with("old_logps", "ref_logps", lambda a, b: F.least(F.exp(a - b), F.lit(2.0))))
        return po.token_policy_report(
            t, loss_type=cfg["loss_type"], epsilon_low=cfg["lo"], epsilon_high=cfg["hi"], delta=cfg["delta"],
            beta=cfg["beta"], level=cfg["level"], max_completion_length=cfg.get("max_len"),
            entropy_mask="entropy_mask" if cfg.get("entropy") else None, importance="importance" if cfg.get("importance") else None,
        )

    run.__doc__ = f"A20 + A17: token-policy objective report ({cfg['loss_type']}, {cfg['level']}-level ratios)."
    return run


for _name, _cfg in _POLICY_CASES.items():
    register(_name, _policy_sql(**_cfg))(_policy_query(_cfg))


# A29 -----------------------------------------------------------------------
def _dists(spark, d):
    """Student / teacher token distributions per position (position = vector,
    vocabulary = its 64 dimensions): log-softmax of the vector (student) and
    of the vector read backwards (teacher)."""
    e = vw.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("tok", "x"))
    e = e.withColumn("x", F.col("x").cast("double"))
    rev = e.select("vec_id", (F.lit(63) - F.col("tok")).alias("tok"), F.col("x").alias("y"))
    j = e.join(rev, ["vec_id", "tok"])
    mx = j.groupBy("vec_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    jj = j.join(mx, "vec_id")
    z = jj.groupBy("vec_id").agg(F.sum(F.exp(F.col("x") - F.col("mx"))).alias("zx"), F.sum(F.exp(F.col("y") - F.col("my"))).alias("zy"))
    out = jj.join(z, "vec_id")
    return out.select(
        "vec_id", "tok",
        (F.col("x") - F.col("mx") - F.log("zx")).alias("lp_s"),
        (F.col("y") - F.col("my") - F.log("zy")).alias("lp_t"),
    )


_DIST_SQL = """
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS tok FROM embeddings),
j AS (SELECT a.vec_id, a.tok, a.x, b.x AS y FROM e a JOIN e b ON a.vec_id = b.vec_id AND b.tok = 63 - a.tok),
m AS (SELECT vec_id, max(x) AS mx, max(y) AS my FROM j GROUP BY vec_id),
z AS (SELECT vec_id, sum(exp(x - mx)) AS zx, sum(exp(y - my)) AS zy FROM j JOIN m USING (vec_id) GROUP BY vec_id),
lp AS (SELECT vec_id, tok, x - mx - ln(zx) AS lp_s, y - my - ln(zy) AS lp_t FROM j JOIN m USING (vec_id) JOIN z USING (vec_id))
"""


@register("distillation_jsd", _DIST_SQL + """
SELECT vec_id, sum(exp(lp_t) * (lp_t - lp_s)) AS kl_teacher_student, sum(exp(lp_s) * (lp_s - lp_t)) AS kl_student_teacher,
       sum(0.5 * exp(lp_t) * (lp_t - mix) + 0.5 * exp(lp_s) * (lp_s - mix)) AS jsd
FROM (SELECT *, greatest(lp_s + ln(0.5), lp_t + ln(0.5)) + ln(exp(lp_s + ln(0.5) - greatest(lp_s + ln(0.5), lp_t + ln(0.5)))
             + exp(lp_t + ln(0.5) - greatest(lp_s + ln(0.5), lp_t + ln(0.5)))) AS mix FROM lp)
GROUP BY vec_id""")
def distillation_jsd(spark, d):
    """Per position KL(T‖S) (β=0), KL(S‖T) (β=1) and the generalised JSD at β=0.5."""
    lp = _dists(spark, d)
    a = po.generalized_jsd(lp, 0.0, ["vec_id"]).withColumnRenamed("jsd", "kl_teacher_student")
    b = po.generalized_jsd(lp, 1.0, ["vec_id"]).withColumnRenamed("jsd", "kl_student_teacher")
    c = po.generalized_jsd(lp, 0.5, ["vec_id"])
    return a.join(b, "vec_id").join(c, "vec_id")


# A30 -----------------------------------------------------------------------
@register("game_report", with_views(
    """SELECT step, avg(0.1 * kll - (p - 0.5) * lps) AS loss, avg((p - 0.5) * lps) AS score, avg(lps - rfs) AS kl,
              avg(lps) AS logps_chosen, avg(rfs) AS logps_rejected, avg(p) AS probabilities, avg(-lps) AS entropy,
              avg(lps - rfs) AS margins, avg(CASE WHEN lps - rfs > 0 THEN 1.0 ELSE 0.0 END) AS accuracies
       FROM (SELECT step, list_sum(logps) AS lps, list_sum(ref_logps) AS rfs,
                    list_sum(list_transform(list_zip(logps, ref_logps), lambda z: (z[1] - z[2]) * z[1])) AS kll,
                    1.0 / (1.0 + exp(-(reward_a - 25.0) / 10.0)) AS p FROM rtokens)
       GROUP BY step""", "rtokens"))
def game_report(spark, d):
    """Policy-vs-mixture game statistics (win probability from a
    scored comparison, KL, score, margins)."""
    t = vw.rtokens(spark, d).withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("reward_a") - 25.0) / 10.0)))
    return po.game_report(t, 0.1)


@register("game_report_masked", with_views(
    """SELECT step, avg(0.1 * kll - (p - 0.5) * lps) AS loss, avg((p - 0.5) * lps) AS score, avg(lps - rfs) AS kl,
              avg(lps) AS logps_chosen, avg(rfs) AS logps_rejected, avg(p) AS probabilities, avg(-lps) AS entropy,
              avg(lps - rfs) AS margins, avg(CASE WHEN lps - rfs > 0 THEN 1.0 ELSE 0.0 END) AS accuracies
       FROM (SELECT step, list_sum(list_transform(list_zip(logps, mask), lambda z: z[1] * z[2])) AS lps,
                    list_sum(list_transform(list_zip(ref_logps, mask), lambda z: z[1] * z[2])) AS rfs,
                    list_sum(list_transform(list_zip(logps, ref_logps, mask), lambda z: (z[1] - z[2]) * z[1] * z[3])) AS kll,
                    1.0 / (1.0 + exp(-(reward_a - 25.0) / 10.0)) AS p FROM rtokens)
       GROUP BY step""", "rtokens"))
def game_report_masked(spark, d):
    """A30 over completion tokens only (masked tokens are padding)."""
    t = vw.rtokens(spark, d).withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("reward_a") - 25.0) / 10.0)))
    return po.game_report(t, 0.1, mask="mask")
