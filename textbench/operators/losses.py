"""Scored tables and loss statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.functions import logits as L
from textbench.operators.balance import attach_class_weight


def score_logits(df: DataFrame, k: int) -> DataFrame:
    """(row_id, y, pred, p_true, probabilities) from (row_id, z, y)."""
    z, y = F.col("z"), F.col("y")
    return df.select(
        "row_id",
        "y",
        L.predicted_class(z, k).alias("pred"),
        L.class_probability(z, y, k).alias("p_true"),
        L.softmax(z, k).alias("probabilities"),
    )


def score_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("y", "pred").agg(F.count("*").alias("n"))


def cross_entropy(df: DataFrame, k: int, smoothing: float = 0.0) -> DataFrame:
    return df.select("row_id", "y", L.cross_entropy(F.col("z"), F.col("y"), k, smoothing).alias("loss"))


def focal_loss(
    df: DataFrame, k: int, gamma: float = 2.0, alpha: Sequence[float] | None = None, smoothing: float = 0.0
) -> DataFrame:
    return df.select("row_id", "y", L.focal_loss(F.col("z"), F.col("y"), k, gamma, alpha, smoothing).alias("loss"))


def mean_loss(losses: DataFrame) -> DataFrame:
    return losses.agg(F.count("*").alias("n"), F.avg("loss").alias("mean_loss"))


def weighted_mean_loss(losses: DataFrame, weights: DataFrame) -> DataFrame:
    """sum(w_y * loss) / sum(w_y)."""
    weighted = attach_class_weight(losses.withColumn("label_id", F.col("y")), weights)
    return weighted.agg(
        F.count("*").alias("n"),
        (F.sum(F.col("weight") * F.col("loss")) / F.sum("weight")).alias("weighted_mean_loss"),
    )
