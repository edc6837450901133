"""Compare saved predictions of several models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from textbench.fixed import LABELS
from textbench.operators.compare import compare_models
from textbench.session import materialize
from textbench.sources.reports import comparison_report, write_report
from textbench.sources.tables import read_available_predictions


def compare_saved(
    spark: SparkSession,
    paths: Mapping[str, str],
    report_path: str | None = None,
    fmt: str = "csv",
    labels: Sequence[str] = LABELS,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rank the models whose predictions exist, and report.

    Returns the ranking, the report lines, and the models without predictions.
    The ranking, one row per model, is written once, so the predictions are read once.
    """
    predictions, missing = read_available_predictions(spark, paths, fmt)
    found = [model for model in paths if model not in missing]  # also those whose file has no rows
    ranking = materialize(compare_models(predictions, found, labels))
    lines = comparison_report(ranking)
    if report_path:
        write_report(lines, report_path)
    return ranking, lines, missing
