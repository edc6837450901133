"""Training-log statistics: loss per epoch, best epoch, early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.operators.rows import running_totals


def epoch_loss(batches: DataFrame) -> DataFrame:
    """Mean batch loss per epoch."""
    return batches.groupBy("run_id", "epoch").agg(F.count("*").alias("n_batches"), F.avg("loss").alias("mean_loss"))


def running_epoch_loss(batches: DataFrame) -> DataFrame:
    """Mean loss of the batches so far, within an epoch."""
    totals = {"_loss": (F.col("loss"), "sum"), "_n": (F.lit(1).cast("bigint"), "sum")}
    summed = running_totals(batches, ["run_id", "epoch"], "batch", totals)
    return summed.select("run_id", "epoch", "batch", "loss", (F.col("_loss") / F.col("_n")).alias("running_loss"))


def _scored_epoch() -> Column:
    """Orders epochs by score, then the earlier one first; NULL for a score that can never be the best."""
    counts = (F.col("val_f1") > 0) & ~F.isnan("val_f1")
    return F.when(counts, F.struct(F.col("val_f1"), (-F.col("epoch")).alias("neg_epoch")))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """Epoch of the best score; the earliest of equals, none if no score exceeds 0.

    Plain aggregates, so they combine before the shuffle.
    """
    return (
        epochs.groupBy("run_id")
        .agg(F.count("*").alias("n_epochs"), F.max(_scored_epoch()).alias("best"))
        .select("run_id", "n_epochs", (-F.col("best.neg_epoch")).alias("best_epoch"), F.col("best.val_f1").alias("best_f1"))
    )


def early_stop(epochs: DataFrame, patience: int) -> DataFrame:
    """Where training with this patience stops, and the best epoch up to there.

    Epochs are numbered 1, 2, ... in each run. An epoch improves if its score is
    greater than 0 and than all scores before it, so the last improvement is the
    earliest epoch with the greatest score so far. The run stops at the first epoch
    that lies ``patience`` epochs after it; 0 means never.
    """
    scored = epochs.select("run_id", "epoch", _scored_epoch().alias("_scored"))
    best = running_totals(scored, ["run_id"], "epoch", {"_best": (F.col("_scored"), "max")}).select(
        "run_id",
        "epoch",
        F.coalesce(-F.col("_best.neg_epoch"), F.lit(0)).alias("_best_epoch"),
        F.coalesce("_best.val_f1", F.lit(0.0)).alias("_best_f1"),
    )
    reached = (F.lit(patience) > 0) & (F.col("epoch") - F.col("_best_epoch") >= patience)

    # no column ever falls along a run: its least value among the epochs that reach
    # the patience is the one at the stop, its greatest is the one at the end
    def at_stop(column: str) -> Column:
        return F.coalesce(F.min(F.when(reached, F.col(column))), F.max(column))

    return best.groupBy("run_id").agg(
        at_stop("epoch").alias("stop_epoch"),
        F.nullif(at_stop("_best_epoch"), F.lit(0)).alias("best_epoch"),
        at_stop("_best_f1").alias("best_f1"),
        F.coalesce(F.max(reached), F.lit(False)).alias("stopped_early"),
    )
