"""Replay buffer over scored generation groups.

The buffer has a fixed capacity, so it is a bounded table by construction;
sampling from it and pairing its groups with the groups to replace are joins
against that bounded table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import global_rank
from .sampling import weighted_draws, weighted_sample, weighted_sample_with_replacement


def group_replay_scores(adv: DataFrame, group: str = "group_id", step: str = "step") -> DataFrame:
    """Per group: ``Σ|advantage| · std`` (the buffer priority), whether the
    group has reward variance (``std > 0``), and its arrival step."""
    return adv.groupBy(group).agg(
        (F.sum(F.abs("advantage")) * F.first("group_std")).alias("score"),
        F.coalesce(F.first("group_std") > 0, F.lit(False)).alias("has_variance"),
        F.min(step).alias("arrival"),
    )


def buffer_add(scored: DataFrame, capacity: int, group: str = "group_id") -> DataFrame:
    """The buffer after adding every group with variance in arrival
    order, keeping the ``capacity`` best scores; a newcomer must be strictly
    better than the current minimum, so among equal scores earlier arrivals
    stay. Equivalent to a top-``capacity`` by ``(score desc, arrival, group)``."""
    cand = scored.filter("has_variance")
    return cand.orderBy(F.col("score").desc(), F.col("arrival"), F.col(group)).limit(capacity)


def sample_buffer(buffer: DataFrame, n: int, group: str = "group_id", seed: int = 0, replacement: bool = False) -> DataFrame:
    """``n`` groups ∝ score, without replacement (at most the buffer's
    groups) or with; a caller that needs more groups than the buffer holds asks
    for replacement."""
    if not replacement:
        return weighted_sample(buffer, n, "score", group, seed).withColumn("draw", F.lit(None).cast("long"))
    return weighted_sample_with_replacement(buffer, n, "score", group, seed)


def replace_zero_variance(scored: DataFrame, buffer: DataFrame, group: str = "group_id", seed: int = 0) -> DataFrame:
    """Groups without reward variance are replaced by groups drawn from the
    buffer with replacement; the k-th group to replace (by key) gets draw k - 1.
    Returns ``(group_id, replacement_group_id)`` for the replaced groups."""
    todo = global_rank(scored.filter(~F.col("has_variance")).select(group), [group], "k")
    todo = todo.select(F.col(group).alias("_tf_group"), (F.col("k") - 1).alias("draw"))
    drawn = weighted_draws(todo, buffer, "score", group, seed)
    return drawn.select(F.col("_tf_group").alias(group), F.col(group).alias("replacement_group_id"))


def replace_rollouts(rollouts: DataFrame, stored: DataFrame, scored: DataFrame, buffer: DataFrame, group: str = "group_id", seed: int = 0) -> DataFrame:
    """L7 with the rollouts themselves: every group of ``rollouts`` without reward variance
    gets the rows of its replacement in ``stored`` (the rollouts of the buffer's groups),
    under its own key; ``source_group_id`` says where a row came from. With an empty buffer
    nothing is replaced. The joins are by group; a buffer group that is drawn often is
    copied once for each group it replaces."""
    to = replace_zero_variance(scored, buffer, group, seed)
    source = f"source_{group}"
    kept = rollouts.join(to.select(group), group, "left_anti").withColumn(source, F.col(group))
    new = stored.withColumnRenamed(group, source).join(to.withColumnRenamed("replacement_group_id", source), source)
    return kept.unionByName(new.select(*kept.columns))
