"""Classification metrics.

Everything starts from the confusion table: one aggregation over the predictions
that combines before its shuffle and leaves at most models x labels^2 rows (plus
cells of labels outside the list). All later steps work on that small table.

Input everywhere: predictions with model, true_label, pred_label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.fixed import LABELS
from textbench.functions.labels import label_array
from textbench.functions.text import fixed_decimals


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """(model, true_label, pred_label, n)."""
    return predictions.groupBy("model", "true_label", "pred_label").agg(F.count("*").alias("n"))


def confusion_matrix_wide(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row per (model, true_label), one column ``pred_<label>`` per listed label, the rest in ``pred_other``."""
    listed = F.col("pred_label").isin(list(labels))
    return predictions.groupBy("model", "true_label").agg(
        *[F.count(F.when(F.col("pred_label") == label, 1)).alias(f"pred_{label}") for label in labels],
        F.count(F.when(~F.coalesce(listed, F.lit(False)), 1)).alias("pred_other"),
    )


#: Labels whose figures may stand in columns: seven for each, in one plan.
LABELS_IN_COLUMNS = 200


def model_figures(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """One wide row per model, from which all metrics are read.

    n, the averages, ``outside`` (how many true and predicted labels the list does
    not have), and for the label at place i: precision_i, recall_i, f1_i, support_i.
    The label list is known at plan time, so absent labels need no join, and all
    sums over the labels are plain compiled arithmetic. That is for lists of up to
    LABELS_IN_COLUMNS; vocabularies that only the data know can have thousands of
    labels, and their figures are rows (``observed_metrics``, ``macro_f1_observed``).
    """
    if len(labels) > LABELS_IN_COLUMNS:
        raise ValueError(f"{len(labels)} labels are too many for columns; see observed_metrics")
    places = range(len(labels))

    def over_labels(term: str) -> str:
        return "(" + " + ".join(term.format(i=i) for i in places) + ")"

    def ratio(part: str, whole: str) -> str:
        return f"case when {whole} > 0 then {part} / {whole} else 0.0D end"

    true_at, pred_at = (F.array_position(label_array(labels), F.col(c)) - 1 for c in ("true_label", "pred_label"))
    cells = confusion_matrix(predictions).select(
        "model", "n", true_at.alias("t"), pred_at.alias("p"), F.expr("true_label = pred_label").alias("equal")
    )
    counts = [
        f"coalesce(sum(case when {condition} then n end), 0) as {name}_{i}"
        for i in places
        for name, condition in (("tp", f"t = {i} and p = {i}"), ("predicted", f"p = {i}"), ("support", f"t = {i}"))
    ]
    tallies = cells.groupBy("model").agg(
        F.sum("n").alias("n"), F.expr("coalesce(sum(case when equal then n end), 0) as correct"), *map(F.expr, counts)
    )
    per_label = [
        f"{ratio(*parts)} as {name}_{i}"
        for i in places
        for name, parts in (
            ("precision", (f"tp_{i}", f"predicted_{i}")),
            ("recall", (f"tp_{i}", f"support_{i}")),
            ("f1", (f"(2 * tp_{i})", f"(predicted_{i} + support_{i})")),
        )
    ]
    totals = [f"{over_labels(name + '_{i}')} as {name}" for name in ("tp", "predicted", "support")]
    averages = [f"{over_labels(m + '_{i}')} / {len(labels)}.0D as macro_{m}" for m in ("precision", "recall", "f1")]
    averages += [
        f"{ratio(over_labels(m + '_{i} * support_{i}'), 'support')} as weighted_{m}" for m in ("precision", "recall", "f1")
    ]
    return tallies.selectExpr("*", *totals, *per_label).selectExpr(
        "model",
        "n",
        "support",
        "2 * n - predicted - support as outside",
        f"{ratio('correct', 'n')} as accuracy",
        f"{ratio('tp', 'predicted')} as micro_precision",
        f"{ratio('tp', 'support')} as micro_recall",
        f"{ratio('(2 * tp)', '(predicted + support)')} as micro_f1",
        *averages,
        *[f"{m}_{i}" for i in places for m in ("precision", "recall", "f1", "support")],
    )


def accuracy(predictions: DataFrame) -> DataFrame:
    """Share of rows with equal labels, rows with labels outside the list included."""
    right = F.coalesce(F.col("true_label") == F.col("pred_label"), F.lit(False))
    return predictions.groupBy("model").agg(F.avg(right.cast("double")).alias("accuracy"))


def per_class_metrics(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(model, label_id, label, precision, recall, f1, support) for every listed label; 0/0 is 0."""
    numbered = model_figures(predictions, labels).withColumn("labels", label_array(labels))
    rows = ", ".join(
        f"struct({i}L as label_id, labels[{i}] as label, precision_{i} as precision, recall_{i} as recall, "
        f"f1_{i} as f1, support_{i} as support)"
        for i in range(len(labels))
    )
    return numbered.selectExpr("model", f"inline(array({rows}))")


def metrics_summary(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(model, n, accuracy, macro_f1, micro_f1, weighted_f1), one scan for all."""
    return model_figures(predictions, labels).select("model", "n", "accuracy", "macro_f1", "micro_f1", "weighted_f1")


def macro_f1(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Mean F1 over the listed labels; an absent one counts as 0."""
    return metrics_summary(predictions, labels).select("model", "macro_f1")


def micro_f1(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """2 * sum(tp) / (sum(predicted) + sum(support)) over the listed labels."""
    return metrics_summary(predictions, labels).select("model", "micro_f1")


def weighted_f1(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Mean F1 weighted by support; no support at all gives 0."""
    return metrics_summary(predictions, labels).select("model", "weighted_f1")


def observed_metrics(predictions: DataFrame) -> DataFrame:
    """(model, label, precision, recall, f1, support, predicted) of every label that occurs
    as true or predicted label of the model, however many there are; 0/0 is 0. A missing
    label is one of its own, and never right."""
    sides = confusion_matrix(predictions).selectExpr(
        "model",
        """inline(array(struct(true_label as label, n as support, 0L as predicted, if(true_label = pred_label, n, 0L) as tp),
                        struct(pred_label as label, 0L as support, n as predicted, 0L as tp)))""",
    )
    sums = sides.groupBy("model", "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    ratio = "if({whole} > 0, tp / {whole}, 0.0D) as {name}"
    return sums.selectExpr(
        "model",
        "label",
        ratio.format(whole="predicted", name="precision"),
        ratio.format(whole="support", name="recall"),
        "2 * tp / (support + predicted) as f1",
        "support",
        "predicted",
    )


def macro_f1_observed(predictions: DataFrame) -> DataFrame:
    """Mean F1 over the labels that occur as true or predicted label of the model; needs no label list."""
    per_label = observed_metrics(predictions).groupBy("model")
    return per_label.agg(F.count("*").alias("n_labels"), F.avg("f1").alias("macro_f1_observed"))


def evaluate_predictions(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    return metrics_summary(predictions, labels).select("model", "macro_f1", "accuracy")


def classification_report(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(model, line_no, label, precision, recall, f1, support), two decimals.

    The listed labels, then accuracy (or the micro average, if labels outside the
    list occur), macro and weighted averages.
    """
    k = len(labels)
    accuracy_row = "case when outside = 0 then 'accuracy' else 'micro avg' end"
    unless_accuracy = "case when outside <> 0 then {} end"
    rows = [(f"labels[{i}]", f"precision_{i}", f"recall_{i}", f"f1_{i}", f"support_{i}") for i in range(k)]
    rows += [
        (
            accuracy_row,
            unless_accuracy.format("micro_precision"),
            unless_accuracy.format("micro_recall"),
            "case when outside = 0 then accuracy else micro_f1 end",
            "support",
        ),
        ("'macro avg'", "macro_precision", "macro_recall", "macro_f1", "support"),
        ("'weighted avg'", "weighted_precision", "weighted_recall", "weighted_f1", "support"),
    ]
    lines = ", ".join(
        f"struct({number}L as line_no, {label} as label, {precision} as precision, {recall} as recall, {f1} as f1, "
        f"{support} as support)"
        for number, (label, precision, recall, f1, support) in enumerate(rows)
    )
    report = (
        model_figures(predictions, labels)
        .withColumn("labels", label_array(labels))
        .selectExpr("model", f"inline(array({lines}))")
    )
    return report.withColumns({m: fixed_decimals(F.col(m), 2).cast("double") for m in ("precision", "recall", "f1")})
