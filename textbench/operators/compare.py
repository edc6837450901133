"""Comparison of models."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textbench.fixed import LABELS
from textbench.functions.labels import encode_label, label_array
from textbench.operators.metrics import metrics_summary


def compare_models(
    predictions: DataFrame, order: Sequence[str] | None = None, labels: Sequence[str] = LABELS
) -> DataFrame:
    """(rank, model, macro_f1, accuracy, n), best macro-F1 first.

    Ties keep the given ``order`` of the models, models outside it come after those
    in it, by name. A model of ``order`` without rows is ranked too: all 0, and last.
    The window sees one row per model. ``n`` shows whether the models were scored on
    as many rows.
    """
    summary = metrics_summary(predictions, labels).select("model", "macro_f1", "accuracy", "n")
    place, used = F.lit(0), F.lit(0)
    if order:
        named = predictions.sparkSession.range(1).select(F.explode(label_array(order)).alias("model")).distinct()
        summary = named.join(summary, "model", "full").na.fill(0)
        at = F.array_position(label_array(order), F.col("model"))
        place, used = F.when(at == 0, len(order) + 1).otherwise(at), (F.col("n") == 0).cast("int")
    ranking = Window.orderBy(used, F.desc("macro_f1"), place, "model")
    return summary.select(F.row_number().over(ranking).cast("bigint").alias("rank"), "model", "macro_f1", "accuracy", "n")


def all_improvements(comparison: DataFrame, k: int = len(LABELS)) -> DataFrame:
    """(better, worse, better_f1, worse_f1, points, ratio): every model against every model
    ranked below it, and against random guessing, 1/K.

    Input: rows of ``compare_models``, one per model.
    """
    rows = comparison.select("model", "macro_f1", "rank")
    ranked = Window.orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    guess = F.struct(F.lit("random guess").alias("model"), F.lit(1.0 / k).alias("macro_f1"))
    below = F.collect_list(F.struct("model", "macro_f1")).over(ranked)
    pairs = rows.select("model", "macro_f1", below.alias("below"))
    pairs = pairs.select("model", "macro_f1", F.explode(F.concat("below", F.array(guess))).alias("w"))
    return pairs.select(
        F.col("model").alias("better"),
        F.col("w.model").alias("worse"),
        F.col("macro_f1").alias("better_f1"),
        F.col("w.macro_f1").alias("worse_f1"),
        (100.0 * (F.col("macro_f1") - F.col("w.macro_f1"))).alias("points"),
        F.when(F.col("w.macro_f1") > 0, F.col("macro_f1") / F.col("w.macro_f1")).alias("ratio"),
    )


def model_improvement(comparison: DataFrame, candidate: str | None = None, k: int = len(LABELS)) -> DataFrame:
    """The candidate (else the best model) against every other model and against random guessing, 1/K.

    Input: rows of ``compare_models``, one per model. ``points`` is the difference
    of the macro-F1 in percentage points, ``ratio`` their quotient.
    """
    rows = comparison.select("model", "macro_f1", "rank")
    chosen = F.col("model") == candidate if candidate else F.col("rank") == 1
    all_models = Window.partitionBy()
    paired = rows.select(
        F.max(F.when(chosen, F.struct("model", "macro_f1"))).over(all_models).alias("c"),
        chosen.alias("chosen"),
        # the candidate's own row stands for random guessing
        F.when(chosen, F.lit("random guess")).otherwise(F.col("model")).alias("baseline"),
        F.when(chosen, F.lit(1.0 / k)).otherwise(F.col("macro_f1")).alias("baseline_f1"),
    )
    return paired.select(
        F.col("c.model").alias("candidate"),
        "baseline",
        F.col("c.macro_f1").alias("candidate_f1"),
        "baseline_f1",
        (100.0 * (F.col("c.macro_f1") - F.col("baseline_f1"))).alias("points"),
        F.when(F.col("baseline_f1") > 0, F.col("c.macro_f1") / F.col("baseline_f1")).alias("ratio"),
    )


def paired_predictions(predictions: DataFrame, models: Sequence[str], labels: Sequence[str] = LABELS) -> DataFrame:
    """Models side by side on the rows they share, one output row per pair of the listed models.

    Rows are aligned by row_id, which is unique within a model. One aggregation by
    row_id brings all models together (numbers only, so it combines before the
    shuffle), and a second one counts. ``n_a`` and ``n_b`` are the rows each model
    has, ``n_both`` the shared ones; ``agreement`` is the share of these where both
    predict the same listed label.
    """
    pred_id = encode_label(F.col("pred_label"), labels, unknown="null")
    right = F.coalesce(F.col("true_label") == F.col("pred_label"), F.lit(False)).cast("int")
    per_row = (
        predictions.filter(F.col("row_id").isNotNull() & F.col("model").isin(list(models)))
        .select("row_id", "model", pred_id.alias("pred_id"), right.alias("right"))
        .groupBy("row_id")
        .agg(
            *[F.max(F.when(F.col("model") == m, F.col("right"))).alias(f"right_{i}") for i, m in enumerate(models)],
            *[F.max(F.when(F.col("model") == m, F.col("pred_id"))).alias(f"pred_{i}") for i, m in enumerate(models)],
        )
    )

    def count(condition):
        return F.count(F.when(condition, 1))

    pairs = list(combinations(range(len(models)), 2))
    sums = []
    for i in range(len(models)):
        sums.append(F.count(f"right_{i}").alias(f"n_{i}"))
    for i, j in pairs:
        a, b = F.col(f"right_{i}"), F.col(f"right_{j}")
        for name, condition in {
            "both": a.isNotNull() & b.isNotNull(),
            "11": (a == 1) & (b == 1),
            "10": (a == 1) & (b == 0),
            "01": (a == 0) & (b == 1),
            "00": (a == 0) & (b == 0),
            "same": F.col(f"pred_{i}") == F.col(f"pred_{j}"),
        }.items():
            sums.append(count(condition).alias(f"p_{i}_{j}_{name}"))
    totals = per_row.agg(*sums)

    def pair(i, j):
        c = {x: F.col(f"p_{i}_{j}_{x}") for x in ("both", "11", "10", "01", "00", "same")}
        return F.struct(
            F.lit(models[i]).alias("model_a"),
            F.lit(models[j]).alias("model_b"),
            F.col(f"n_{i}").alias("n_a"),
            F.col(f"n_{j}").alias("n_b"),
            c["both"].alias("n_both"),
            c["11"].alias("both_right"),
            c["10"].alias("only_a"),
            c["01"].alias("only_b"),
            c["00"].alias("both_wrong"),
            F.when(c["both"] > 0, c["same"] / c["both"]).alias("agreement"),
        )

    return totals.select(F.inline(F.array(*[pair(i, j) for i, j in pairs])))
