"""Density-ratio weights and the binary-classifier preference objective
(A26, A27).

A26 fits a logistic-regression classifier P(desirable | embedding) with
``pyspark.ml`` (distributed training over the embedding table, classes
balanced) and turns its
probability into ``p / (1 - p + 1e-8)`` clamped to ``[min_ratio, max_ratio]``.
A27 is the objective ``-logσ(r_c - δ)`` / ``-logσ(-(r_r - δ))`` with δ the
running mean reward, the undesirable side optionally weighted by A26.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rewards import log_sigmoid
from .sampling import uniform_draws


def fit_density_classifier(train: DataFrame, features: str = "embedding", label: str = "desirable", max_iter: int = 50, reg: float = 0.0,
                           per_class: int | None = None, order: Sequence[str] = ("vec_id",), seed: int = 0):
    """Fit P(desirable | embedding); ``features`` is an ``array<float|double>``.

    Both classes weigh the same in total (``rows / (classes * rows of the
    class)``), so the odds of the classes do not shift the ratio. All rows are
    learned from, or with ``per_class`` so many draws a class with replacement."""
    data = train.withColumn("label", F.col(label).cast("double")).filter("label IS NOT NULL")
    if per_class:
        data = uniform_draws(data, per_class, list(order), "label", seed)
    counts = data.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    weights = counts.join(F.broadcast(total), how="inner", on=F.lit(True)).select("label", (F.col("_total") / (F.col("_classes") * F.col("_n"))).alias("_weight"))
    data = data.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), "label").join(F.broadcast(weights), "label")
    return LogisticRegression(maxIter=max_iter, regParam=reg, weightCol="_weight").fit(data)


def density_ratio_weights(model, df: DataFrame, features: str = "embedding", min_ratio: float = 0.2, max_ratio: float = 10.0) -> DataFrame:
    """``prob_desirable`` and the clamped density-ratio ``weight`` per row."""
    vec = df.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    scored = model.transform(vec)
    out = scored.withColumn("prob_desirable", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction", "probability")
    p = F.col("prob_desirable")
    return out.withColumn("weight", F.least(F.greatest(p / (F.lit(1.0) - p + F.lit(1e-8)), F.lit(min_ratio)), F.lit(max_ratio)))


def bco_losses(chosen_reward: Column, rejected_reward: Column, delta: Column, rejected_weight: Column | None = None) -> tuple[Column, Column]:
    """Per-pair desirable and (weighted) undesirable losses against δ."""
    c = -log_sigmoid(chosen_reward - delta)
    r = -log_sigmoid(-(rejected_reward - delta))
    if rejected_weight is not None:
        r = rejected_weight * r
    return c, r
