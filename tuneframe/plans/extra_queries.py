"""Remaining operators: multimodal blocks (P13), token alignment (J6),
density-ratio weights and the classifier objective (A26, A27), scorer
summaries and metric logs (A31, A32), user hooks (U1-U5), formatting
functions and processed-data detection (P15, P18, P19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewards as rw
from ..functions import udf as hooks
from ..operators import density as dn
from ..operators import formats as fm
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import multimodal as mm
from ..operators import preference as pf
from ..operators import tokens as tk
from ..sources import views as vw
from ..sources.views import build_sql, with_views
from . import sft
from .catalog import ints_text, register
from .prep_queries import tok_sql
from .preference_queries import BETA, CR, RR, ls


# P13 -----------------------------------------------------------------------
def _with_images(spark, d):
    m = vw.msgs(spark, d)
    k = (F.col("example_id") % 3).cast("int")
    imgs = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.concat(F.lit("img://"), F.col("example_id").cast("string"), F.lit("/"), j.cast("string")))
    return m.withColumn("images", F.when(k > 0, imgs).otherwise(F.array().cast("array<string>")))


@register("multimodal_blocks", with_views(
    """SELECT example_id, CASE WHEN u IS NULL AND len(images) > 0 THEN NULL ELSE
         array_to_string(list_transform(messages, lambda m, i: m.role || ':' || CASE WHEN i = u THEN
             array_to_string(list_transform(images, lambda x: '[img:' || x || ']'), '') ELSE '' END || m.content), '|') END AS rendered,
         CASE WHEN u IS NULL AND len(images) > 0 THEN 'images given (' || len(images) || ') differ from placeholders (0)' END AS reject_reason
       FROM (SELECT example_id, messages, images, list_position(list_transform(messages, lambda m: m.role = 'user'), true) AS u
             FROM (SELECT example_id, messages, CASE WHEN example_id % 3 > 0 THEN list_transform(range(example_id % 3), lambda j: 'img://' || example_id || '/' || j) ELSE [] END AS images FROM msgs))""",
    "msgs"))
def multimodal_blocks(spark, d):
    """Text blocks, image placeholders before the first user turn, image
    references bound in order; mismatches rejected."""
    out = mm.prepare_multimodal(_with_images(spark, d))
    blk = lambda b: F.when(b["type"] == "image", F.concat(F.lit("[img:"), b["image"], F.lit("]"))).otherwise(b["text"])
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.array_join(F.transform(m["content"], blk), ""))), "|")
    return out.select("example_id", F.when(F.col("reject_reason").isNull(), rendered).alias("rendered"), "reject_reason")


@register("bind_image_blocks", with_views(
    """SELECT example_id, CASE WHEN u IS NULL THEN CASE WHEN k > 0 THEN NULL ELSE body END WHEN k <> n THEN NULL ELSE body END AS rendered,
         CASE WHEN coalesce(CASE WHEN u IS NULL THEN 0 ELSE n END, 0) <> k THEN 'image count does not match placeholders' END AS reject_reason
       FROM (SELECT example_id, u, n, k, array_to_string(list_transform(messages, lambda m, i: m.role || ':' || CASE WHEN i = u THEN
               array_to_string(list_transform(range(n), lambda j: '[img:img://' || example_id || '/' || j || ']'), '') ELSE '' END || m.content), '|') AS body
             FROM (SELECT example_id, messages, list_position(list_transform(messages, lambda m: m.role = 'user'), true) AS u, example_id % 3 AS n,
                          example_id % 3 + CASE WHEN example_id % 5 = 0 THEN 1 ELSE 0 END AS k FROM msgs))""", "msgs"))
def bind_image_blocks(spark, d):
    """P13 for contents that are blocks already: empty image blocks get the references in
    order; every fifth conversation has an image too many."""
    m = vw.msgs(spark, d)
    refs = lambda n: F.transform(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda j: F.concat(F.lit("img://"), F.col("example_id").cast("string"), F.lit("/"), j.cast("string")))
    n = F.col("example_id") % 3
    # rows without a user turn have no place for images: no block is made there
    made = mm.prepare_multimodal(m.withColumn("images", refs(n)))
    empty = lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), F.lit(None).cast("string").alias("image"))
    open_ = made.withColumn("messages", F.transform("messages", lambda x: F.struct(x["role"].alias("role"), F.transform(x["content"], empty).alias("content"))))
    out = mm.bind_images(open_.withColumn("images", refs(n + F.when(F.col("example_id") % 5 == 0, 1).otherwise(0))).drop("reject_reason"))
    blk = lambda b: F.when(b["type"] == "image", F.concat(F.lit("[img:"), b["image"], F.lit("]"))).otherwise(b["text"])
    rendered = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), F.array_join(F.transform(x["content"], blk), ""))), "|")
    return out.select("example_id", F.when(F.col("reject_reason").isNull(), rendered).alias("rendered"), "reject_reason")


# J6 ------------------------------------------------------------------------
_WS_SPLIT = r"\S+|\s+"


def _two_tokenizations(spark, d):
    b = vw.table(spark, d, "benchmark").select(F.col("item_id").alias("text_id"), "text")
    a = b.select("text_id", F.posexplode(tk.split_tokens("text")).alias("pos", "tok")).select("text_id", "pos", F.length("tok").alias("n_chars"))
    c = b.select("text_id", F.posexplode(F.regexp_extract_all("text", F.lit(_WS_SPLIT), 0)).alias("pos", "tok")).select("text_id", "pos", F.length("tok").alias("n_chars"))
    return a, c


_TOKEN_RE_SQL = tk.TOKEN_PATTERN


@register("token_alignment", f"""
WITH a0 AS (SELECT item_id AS text_id, unnest(regexp_extract_all(text, '{_TOKEN_RE_SQL}')) AS tok, unnest(range(len(regexp_extract_all(text, '{_TOKEN_RE_SQL}')))) AS pos FROM benchmark),
b0 AS (SELECT item_id AS text_id, unnest(regexp_extract_all(text, '{_WS_SPLIT}')) AS tok, unnest(range(len(regexp_extract_all(text, '{_WS_SPLIT}')))) AS pos FROM benchmark),
a AS (SELECT text_id, pos, sum(length(tok)) OVER (PARTITION BY text_id ORDER BY pos) AS e FROM a0),
b AS (SELECT text_id, pos, sum(length(tok)) OVER (PARTITION BY text_id ORDER BY pos) AS e FROM b0),
cb AS (SELECT DISTINCT a.text_id, a.e FROM a JOIN b ON a.text_id = b.text_id AND a.e = b.e),
ga AS (SELECT a.text_id, a.pos, (SELECT count(*) FROM cb WHERE cb.text_id = a.text_id AND cb.e < a.e) AS grp FROM a),
gb AS (SELECT b.text_id, b.pos, (SELECT count(*) FROM cb WHERE cb.text_id = b.text_id AND cb.e < b.e) AS grp FROM b),
pa AS (SELECT text_id, grp, array_to_string(list(pos ORDER BY pos), ' ') AS positions_a FROM ga GROUP BY 1, 2),
pb AS (SELECT text_id, grp, array_to_string(list(pos ORDER BY pos), ' ') AS positions_b FROM gb GROUP BY 1, 2)
SELECT text_id, CAST(grp AS BIGINT) AS grp, coalesce(positions_a, '') AS positions_a, coalesce(positions_b, '') AS positions_b
FROM pa FULL JOIN pb USING (text_id, grp)""")
def token_alignment(spark, d):
    """Align two tokenisations of the same texts (regex tokens vs
    whitespace runs) into groups between common character boundaries."""
    a, b = _two_tokenizations(spark, d)
    g = jn.align_token_groups(a, b)
    return g.select("text_id", F.col("grp").cast("long").alias("grp"), ints_text("positions_a").alias("positions_a"), ints_text("positions_b").alias("positions_b"))


# A26 / A27 -----------------------------------------------------------------
@register("density_weights")
def density_weights(spark, d):
    """Logistic-regression density ratio P(desirable|embedding) ->
    ``p/(1-p+1e-8)`` clamped to [0.2, 10] (MLlib fit; no SQL twin)."""
    e = vw.table(spark, d, "embeddings").withColumn("desirable", F.col("label") % 2 == 1)
    model = dn.fit_density_classifier(e)
    w = dn.density_ratio_weights(model, e, min_ratio=0.2, max_ratio=10.0)
    return w.select("vec_id", "prob_desirable", "weight")


@register("bco_objective", build_sql(["logps"], [
    ("per", f"SELECT step, sum({BETA} * {CR} + {BETA} * {RR}) AS s, count(*) * 2 AS n FROM logps GROUP BY step"),
    ("run", "SELECT step, sum(s) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / "
            "sum(n) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS delta FROM per")],
    f"SELECT step, avg(-{ls(f'{BETA} * {CR} - delta')}) AS chosen_loss, avg(-{ls(f'-({BETA} * {RR} - delta)')}) AS rejected_loss, "
    f"avg({BETA} * {CR}) AS rewards_chosen, avg({BETA} * {RR}) AS rewards_rejected, max(delta) AS delta FROM logps JOIN run USING (step) GROUP BY step"))
def bco_objective(spark, d):
    """Binary-classifier objective against the running mean reward δ."""
    lp = vw.logps(spark, d)
    j = lp.join(pf.running_reward_mean(lp, BETA), "step")
    cr, rr = F.lit(BETA) * (F.col("c") - F.col("c0")), F.lit(BETA) * (F.col("r") - F.col("r0"))
    c_loss, r_loss = dn.bco_losses(cr, rr, F.col("delta"))
    return j.groupBy("step").agg(F.avg(c_loss).alias("chosen_loss"), F.avg(r_loss).alias("rejected_loss"), F.avg(cr).alias("rewards_chosen"),
                                 F.avg(rr).alias("rewards_rejected"), F.max("delta").alias("delta"))


@register("bco_objective_weighted")
def bco_objective_weighted(spark, d):
    """A27 with A26: the undesirable side weighted by the density ratio of its pair's
    embedding (a hash of the pair's key picks the vector, as the tables share no key)."""
    e = vw.table(spark, d, "embeddings").withColumn("desirable", F.col("label") % 2 == 1)
    w = dn.density_ratio_weights(dn.fit_density_classifier(e, per_class=512), e).select("vec_id", "weight")
    n = e.agg((F.max("vec_id") + 1).alias("n"))
    lp = vw.logps(spark, d)
    j = lp.join(pf.running_reward_mean(lp, BETA), "step").join(F.broadcast(n), how="inner", on=F.lit(True))
    j = j.withColumn("vec_id", F.pmod(F.xxhash64("example_id"), F.col("n"))).join(w, "vec_id")
    cr, rr = F.lit(BETA) * (F.col("c") - F.col("c0")), F.lit(BETA) * (F.col("r") - F.col("r0"))
    c_loss, r_loss = dn.bco_losses(cr, rr, F.col("delta"), F.col("weight"))
    return j.groupBy("step").agg(F.avg(c_loss).alias("chosen_loss"), F.avg(r_loss).alias("rejected_loss"), F.avg("weight").alias("mean_weight"), F.count(F.lit(1)).alias("pairs"))


# A31 / A32 -----------------------------------------------------------------
@register("scorer_summary", with_views(
    """SELECT CAST(count(*) AS BIGINT) AS total_predictions, avg(fmt) AS avg_fmt, CAST(count(CASE WHEN fmt IS NULL THEN 1 END) AS BIGINT) AS failed_fmt,
              avg(short) AS avg_short, CAST(count(CASE WHEN short IS NULL THEN 1 END) AS BIGINT) AS failed_short
       FROM (SELECT CASE WHEN starts_with(completion, '<think>') AND position('<think>' IN substr(completion, 8)) = 0
                          AND position('</think>' IN substr(completion, 8)) > 0 THEN 1.0 ELSE 0.0 END AS fmt,
                    CASE WHEN length(completion) <= 2000 THEN length(completion) / 2000.0 END AS short FROM completions)""", "completions"))
def scorer_summary(spark, d):
    """Per-scorer means over successful rows and failure counts (the
    length scorer fails on completions over 2000 characters)."""
    c = vw.completions(spark, d)
    s = hooks.score_with(c, {"fmt": rw.think_format("completion"),
                             "short": F.when(F.length("completion") <= 2000, F.length("completion") / 2000.0)})
    return mt.scorer_summary(s, ["fmt", "short"])


@register("metric_log", """
SELECT CAST(floor((dayofmonth(ts) - 1) / 7) AS BIGINT) AS log_window,
       CASE WHEN user_id % 5 = 0 THEN 'eval_' || event_type ELSE event_type END AS name,
       avg(value) AS value, CAST(max(dayofmonth(ts)) AS INTEGER) AS log_step, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1, 2""")
def metric_log(spark, d):
    """Metric means over every 7 logged steps, ``eval_`` prefix for evaluation rows."""
    ev = vw.table(spark, d, "events").select(
        F.dayofmonth("ts").alias("step"), F.col("event_type").alias("metric"), "value",
        F.when(F.col("user_id") % 5 == 0, F.lit("eval")).otherwise(F.lit("train")).alias("mode"),
    )
    return mt.metric_log(ev, 7)


# U1-U5 ---------------------------------------------------------------------
def _len_reward(s):
    return s.str.len() / 1000.0


@register("reward_hooks", with_views(
    """SELECT example_id, length(completion) / 1000.0 AS len_reward, fmt AS format_reward, 0.5 * (length(completion) / 1000.0) + 1.0 * fmt AS reward
       FROM (SELECT *, CASE WHEN starts_with(completion, '<think>') AND position('<think>' IN substr(completion, 8)) = 0
                            AND position('</think>' IN substr(completion, 8)) > 0 THEN 1.0 ELSE 0.0 END AS fmt FROM completions)""", "completions"))
def reward_hooks(spark, d):
    """A vectorised Python reward (Arrow pandas UDF) and a Column
    reward combined with weights."""
    c = vw.completions(spark, d).select("example_id", "completion")
    lr = hooks.vectorized(_len_reward)
    out = hooks.apply_reward_functions(c, {"len_reward": lr(F.col("completion")), "format_reward": rw.think_format("completion")}, [0.5, 1.0])
    return out.select("example_id", "len_reward", "format_reward", "reward")


@register("group_filter_hook", with_views(
    """SELECT example_id, group_id, reward_a FROM (
         SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sc DESC NULLS LAST, sample_no) AS rk
         FROM (SELECT *, reward_a - avg(reward_a) OVER (PARTITION BY group_id) AS sc FROM rollouts)) WHERE rk <= 2""", "rollouts"))
def group_filter_hook(spark, d):
    """A group-aware filter score (reward minus its group mean) keeps the
    best two completions per group."""
    r = vw.rollouts(spark, d)
    # group statistics as a partial aggregate joined back (no per-group window)
    means = r.groupBy("group_id").agg(F.avg("reward_a").alias("_group_mean"))
    r = r.join(means, "group_id")
    score = F.col("reward_a") - F.col("_group_mean")
    return hooks.group_filter(r, score, 2).select("example_id", "group_id", "reward_a")


@register("formatting_func", with_views(
    "SELECT example_id, 'Q: ' || prompt || chr(10) || 'A: ' || completion AS text FROM completions", "completions"))
def formatting_func(spark, d):
    """P18 (U3): a user formatting function (a Column builder) -> ``text``."""
    c = vw.completions(spark, d).select("example_id", "prompt", "completion")
    out = fm.apply_formatting_func(c, lambda df: F.concat(F.lit("Q: "), df["prompt"], F.lit("\nA: "), df["completion"]))
    return out.select("example_id", "text")


@register("processed_prune", tok_sql("SELECT example_id, CAST(len(input_ids) AS INTEGER) AS n_tokens FROM ids"))
def processed_prune(spark, d):
    """P19 + P15: data that already carries ``input_ids`` skips preparation
    and is pruned to the training signature."""
    t = sft.tokenized(spark, d)
    if fm.is_processed(t):
        t = fm.prune(t, ["example_id", "input_ids", "completion_mask", "labels"])
    return t.select("example_id", F.size("input_ids").alias("n_tokens"))
