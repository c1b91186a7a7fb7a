"""Judging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sampling import uniform_sql
from ..operators import judging as jd
from ..sources import views as vw
from ..sources.views import build_sql, with_views
from .catalog import ints_text, register


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _judge_prompt_sql() -> str:
    import string

    parts = []
    names = {"prompt": "prompt", "response0": "solution", "response1": "completion"}
    for literal, field, _s, _c in string.Formatter().parse(jd.DEFAULT_PAIRWISE_SYSTEM_PROMPT):
        if literal:
            parts.append(_sql_str(literal))
        if field is not None:
            parts.append(names[field])
    return " || ".join(parts)


@register("judge_prompt_render", with_views(
    f"SELECT example_id, {_judge_prompt_sql()} AS request FROM completions", "completions"))
def judge_prompt_render(spark, d):
    """The pairwise judge request for reference (solution) vs policy completion."""
    c = vw.completions(spark, d)
    req = jd.render_template(jd.DEFAULT_PAIRWISE_SYSTEM_PROMPT, {"prompt": "prompt", "response0": "solution", "response1": "completion"})
    return c.select("example_id", req.alias("request"))


@register("verdict_parse", with_views(
    "SELECT example_id, CASE WHEN reply = '0' THEN 0 WHEN reply = '1' THEN 1 ELSE -1 END AS rank FROM verdicts", "verdicts"))
def verdict_parse(spark, d):
    """Judge replies -> 0 / 1 / -1."""
    v = vw.verdicts(spark, d)
    return v.select("example_id", jd.parse_verdict("reply").alias("rank"))


@register("verdict_unflip", with_views(
    "SELECT example_id, CASE WHEN example_id % 2 = 1 AND judge_a IN (0, 1) THEN 1 - judge_a ELSE judge_a END AS rank FROM verdicts",
    "verdicts"))
def verdict_unflip(spark, d):
    """G1: verdicts given on flipped pairs mapped back (-1 stays -1); the flip
    flag here is logged with the reply (odd comparison ids)."""
    v = vw.verdicts(spark, d).withColumn("flipped", F.col("example_id") % 2 == 1)
    return v.select("example_id", jd.unflip("judge_a", "flipped").alias("rank"))


@register("judge_flip_sample", with_views(
    f"""SELECT example_id, flipped, CAST(length(CASE WHEN flipped THEN completion ELSE solution END) AS INTEGER) AS first_len,
               CAST(length(CASE WHEN flipped THEN solution ELSE completion END) AS INTEGER) AS second_len
        FROM (SELECT *, {uniform_sql('example_id', 7)} < 0.5 AS flipped FROM completions)""", "completions"))
def judge_flip_sample(spark, d):
    """G1: hash-seeded order randomisation of candidate pairs; tests check that
    flipping twice is the identity and that about half the rows flip."""
    c = vw.completions(spark, d).select("example_id", "solution", "completion")
    f = jd.flip_pair(c, "solution", "completion", jd.flip_flag("example_id", seed=7))
    return f.select("example_id", "flipped", F.length("solution").alias("first_len"), F.length("completion").alias("second_len"))


@register("soft_verdict", with_views(
    "SELECT example_id, 1.0 / (1.0 + exp((score_1 - score_0) / 0.5)) AS p_first FROM verdicts", "verdicts"))
def soft_verdict(spark, d):
    """Temperature-scaled (T=0.5) softmax probability that the first candidate wins."""
    v = vw.verdicts(spark, d)
    return v.select("example_id", jd.soft_verdict("score_0", "score_1", 0.5).alias("p_first"))


@register("judge_mixture", with_views(
    """SELECT example_id, CASE WHEN least(judge_a, judge_b, judge_c) = -1 THEN -1
           WHEN judge_a = 1 AND judge_b = 1 AND judge_c = 1 THEN 1 ELSE 0 END AS verdict FROM verdicts""", "verdicts"))
def judge_mixture(spark, d):
    """G5 + U4: unify three judges given as tables of verdicts (-1 if any invalid, 1 if all agree on 1, else 0)."""
    v = vw.verdicts(spark, d)
    return v.select("example_id", jd.combine_judges(["judge_a", "judge_b", "judge_c"]).alias("verdict"))


@register("win_rate", with_views(
    "SELECT step, avg(CASE WHEN judge_a = 1 THEN 1.0 ELSE 0.0 END) AS win_rate, CAST(count(CASE WHEN judge_a = -1 THEN 1 END) AS BIGINT) AS invalid, "
    "CAST(count(*) AS BIGINT) AS n FROM verdicts GROUP BY step", "verdicts"))
def win_rate(spark, d):
    """Win rate per evaluation step with invalid verdicts counted."""
    return jd.win_rate(vw.verdicts(spark, d), "judge_a")


@register("soft_win_rate", build_sql(["verdicts"], [("p", "SELECT step, 1.0 / (1.0 + exp((score_1 - score_0) / 0.5)) AS pr FROM verdicts")],
    "SELECT step, 1.0 - avg(pr) AS avg_win_prob, avg(CASE WHEN pr > 0.5 THEN 0.0 ELSE 1.0 END) AS win_rate FROM p GROUP BY step"))
def soft_win_rate(spark, d):
    """G6 soft: average win probability against the reference and the implied win rate."""
    v = vw.verdicts(spark, d).withColumn("pr", jd.soft_verdict("score_0", "score_1", 0.5))
    return jd.soft_win_rate(v, "pr")


@register("rank_lists", with_views(
    "SELECT group_id, array_to_string(list(sample_no ORDER BY reward_a DESC, sample_no), ' ') AS ranking FROM rollouts GROUP BY group_id",
    "rollouts"))
def rank_lists(spark, d):
    """Per prompt, completions ranked by score (best first)."""
    r = vw.rollouts(spark, d)
    g = jd.rank_lists(r, "group_id", "sample_no", "reward_a")
    return g.select("group_id", ints_text("ranking").alias("ranking"))
