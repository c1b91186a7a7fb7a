"""User hooks (U1-U5): reward functions, group filters, formatting
functions, judges and scorers.

The preferred hook is a ``Column`` builder (stays JVM-side, inside
whole-stage code generation). Python logic is accepted as a vectorised
function over pandas Series, wrapped in an Arrow ``pandas_udf`` (batches, not
rows). ``None``/NaN from a hook means "not applicable" and becomes NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rollouts import top_k_per_group, weighted_reward

Hook = Column | Callable[..., Column]


def vectorized(fn: Callable[..., pd.Series], return_type: T.DataType | str = "double"):
    """Wrap ``fn(*series) -> series`` as an Arrow-batched pandas UDF; NaN
    results become NULL."""

    @F.pandas_udf(return_type)
    def run(*cols: pd.Series) -> pd.Series:
        out = pd.Series(fn(*cols))
        return out.where(out.notna(), None)

    return run


def apply_reward_functions(df: DataFrame, funcs: Mapping[str, Hook], weights: Sequence[float] | None = None,
                           out: str = "reward") -> DataFrame:
    """U1 + A1: add one column per reward function (a ``Column``, or a
    callable taking the frame and returning one) and their weighted sum."""
    for name, f in funcs.items():
        df = df.withColumn(name, f(df) if callable(f) and not isinstance(f, Column) else f)
    total, missing = weighted_reward(list(funcs), weights)
    return df.withColumn(out, total).withColumn(f"{out}_all_missing", missing)


def group_filter(df: DataFrame, score: Hook, k: int, group: str = "group_id", tie: str = "sample_no") -> DataFrame:
    """Score every completion with a group-aware hook (a ``Column``, e.g.
    built with group windows of bounded groups), keep the best ``k`` per
    group."""
    scored = df.withColumn("_tf_filter_score", score(df) if callable(score) and not isinstance(score, Column) else score)
    return top_k_per_group(scored, k, "_tf_filter_score", group, tie).drop("_tf_filter_score")


def score_with(df: DataFrame, scorers: Mapping[str, Hook]) -> DataFrame:
    """Judges and scorers over (prompt, completion) columns; each
    becomes a column (NULL where it failed / did not apply)."""
    for name, f in scorers.items():
        df = df.withColumn(name, f(df) if callable(f) and not isinstance(f, Column) else f)
    return df
