"""Metric tables.

Metrics are a long table ``(step, metric, value[, mode])``; logging averages
a metric over the steps since the previous log (a mean of the logged values,
not of per-step means), with an ``eval_`` prefix in evaluation mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scorer_summary(df: DataFrame, scorers: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per scorer, the mean over rows where it succeeded (NULL = failed)
    and the failure count, plus total rows."""
    aggs = [F.count(F.lit(1)).alias("total_predictions")]
    for s in scorers:
        aggs += [F.avg(s).alias(f"avg_{s}"), F.count(F.when(F.col(s).isNull(), 1)).alias(f"failed_{s}")]
    return df.groupBy(*by).agg(*aggs)


def metric_log(df: DataFrame, log_every: int, step: str = "step", metric: str = "metric", value: str = "value", mode: str | None = "mode") -> DataFrame:
    """Mean of each metric over every ``log_every`` steps; metric names
    get an ``eval_`` prefix for evaluation rows."""
    window = F.floor((F.col(step) - 1) / log_every).cast("long")
    name = F.col(metric)
    if mode is not None:
        name = F.when(F.col(mode) == "eval", F.concat(F.lit("eval_"), F.col(metric))).otherwise(F.col(metric))
    return df.groupBy(window.alias("log_window"), name.alias("name")).agg(
        F.avg(value).alias("value"), F.max(step).alias("log_step"), F.count(F.lit(1)).alias("n")
    )
