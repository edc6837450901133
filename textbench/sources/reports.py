"""Text reports as tables of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.fixed import BAR_WIDTH, LABELS
from textbench.functions.labels import label_array
from textbench.functions.text import fixed_decimals
from textbench.operators.metrics import model_figures


def metrics_report(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(model, line_no, line): four averages, then a block per listed label."""
    # fixed values: titles, rules and field names of the report
    lines = [f"'{'=' * 50}'", "'EVALUATION METRICS'", f"'{'=' * 50}'", "''"]
    for name, field in [("Accuracy", "accuracy"), ("Macro F1", "macro_f1"), ("Micro F1", "micro_f1"), ("Weighted F1", "weighted_f1")]:
        lines.append(f"concat('{name}: ', format_number({field}, 4))")
    lines += ["''", f"'{'-' * 50}'", "'PER-CLASS METRICS'", f"'{'-' * 50}'", "''"]
    for i in range(len(labels)):
        lines.append(f"concat(labels[{i}], ':')")
        for name, field in [("Precision", "precision"), ("Recall", "recall"), ("F1", "f1")]:
            lines.append(f"concat('  {name}: ', format_number({field}_{i}, 4))")
        lines += [f"concat('  Support: ', support_{i})", "''"]
    figures = model_figures(predictions, labels).withColumn("labels", label_array(labels))
    return figures.selectExpr("model", f"posexplode(array({', '.join(lines)})) as (position, line)").selectExpr(
        "model", "cast(position + 1 as bigint) as line_no", "line"
    )


def comparison_line(name: Column, macro_f1: Column) -> Column:
    """Name padded to 20 but never cut, four decimals, a bar of 40 for a macro-F1 of 1."""
    bar = F.repeat(F.lit("█"), F.floor(macro_f1 * BAR_WIDTH).cast("int"))
    return F.format_string("%-20s %s %s", name, fixed_decimals(macro_f1, 4), bar)


def comparison_report(comparison: DataFrame, title: str = "EVALUATION REPORT") -> DataFrame:
    """(line_no, line) from the rows of ``compare_models``; the closing sentence names the actual winner."""
    # fixed values: rules and headings of the report
    head = ["=" * 60, title, "=" * 60, "", "Model Comparison (Macro F1 Score):", "-" * 40]
    everything = Window.partitionBy()  # one row per model
    models = F.count("*").over(everything)
    rows = comparison.select("rank", "model", "macro_f1", models.alias("models"))

    def at(number: Column, line: Column) -> Column:
        return F.struct(number.cast("bigint").alias("line_no"), line.alias("line"))

    ranked = at(F.lit(len(head)) + F.col("rank"), comparison_line(F.col("model"), F.col("macro_f1")))
    end = F.lit(len(head)) + F.col("models")
    first = [at(F.lit(i + 1), F.lit(line)) for i, line in enumerate(head)]
    last = [
        at(end + 1, F.lit("")),
        at(end + 2, F.lit("-" * 40)),
        at(end + 3, F.concat(F.lit("Key Finding: "), F.col("model"), F.lit(" has the best macro F1"))),
        at(end + 4, F.concat(F.lit("of "), F.col("models").cast("string"), F.lit(" compared models."))),
        at(end + 5, F.lit("=" * 60)),
    ]
    # the winner's row carries the lines that occur once
    lines = F.when(F.col("rank") == 1, F.array(*first, ranked, *last)).otherwise(F.array(ranked))
    return rows.select(F.inline(lines))


def write_report(lines: DataFrame, path: str) -> None:
    """One text file: the lines of each model in order, models by name, or a comparison's lines."""
    order = ["model", "line_no"] if "model" in lines.columns else ["line_no"]
    lines.orderBy(*order).coalesce(1).select("line").write.text(path)
