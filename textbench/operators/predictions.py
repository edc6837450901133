"""Predictions: parsed outputs and untrained baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.fixed import LABELS
from textbench.functions.labels import label_array
from textbench.functions.parsing import labels_found, parse_output
from textbench.functions.text import saved_output, saved_text
from textbench.operators.labels import resolved_label


def parse_outputs(outputs: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Add pred_label and n_found to a table with raw_output."""
    return outputs.withColumn("pred_label", parse_output(F.col("raw_output"), labels)).withColumn(
        "n_found", labels_found(F.col("raw_output"), labels)
    )


def parse_counts(parsed: DataFrame) -> DataFrame:
    """How often each label came from the fallback (0 found), one match or the list order (2 or more)."""
    return parsed.groupBy("model", "pred_label", "n_found").agg(F.count("*").alias("n"))


def truncate_output(predictions: DataFrame) -> DataFrame:
    """Cut text and raw_output (if there) to what a saved file keeps. Parse before, not after."""
    cut = {"text": saved_text(F.col("text"))}
    if "raw_output" in predictions.columns:
        cut["raw_output"] = saved_output(F.col("raw_output"))
    return predictions.withColumns(cut)


def baseline_predictions(
    df: DataFrame, seed: int, labels: Sequence[str] = LABELS, score_split: str = "test", mapping: DataFrame | None = None
) -> DataFrame:
    """Two untrained models on one split: the majority class of train, and a seeded uniform class.

    Labels are encoded as everywhere: by ``mapping`` (such as ``resolve_labels`` gives)
    or else the list, unknown and missing ones as class 0. Equally frequent classes go
    by class id.
    """
    names = label_array(labels)
    listed = df.sparkSession.range(1).select(F.posexplode(names).alias("label_id", "label"))
    mapping = listed if mapping is None else mapping.select("label_id", "label")
    rows = resolved_label(df, mapping)
    counts = rows.filter(F.col("split") == "train").groupBy("label", "label_id").agg(F.count("*").alias("n"))
    majority = counts.agg(F.max_by("label", F.struct("n", -F.col("label_id")))).scalar()
    digest = F.md5(F.concat(F.lit(f"{seed}:uniform:"), F.col("row_id").cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    classes = mapping.agg(F.count("*")).scalar()
    by_id = mapping.select((F.col("label_id")).cast("bigint").alias("u_id"), F.col("label").alias("uniform"))
    scored = rows.filter(F.col("split") == score_split).withColumn("u_id", number % classes)
    models = F.explode(
        F.array(
            F.struct(F.lit("majority").alias("model"), majority.alias("pred_label")),
            F.struct(F.lit("uniform").alias("model"), F.col("uniform").alias("pred_label")),
        )
    )
    return (
        scored.join(by_id, "u_id")
        .select("row_id", F.col("label").alias("true_label"), models.alias("m"))
        .select("m.model", "row_id", "true_label", "m.pred_label")
    )
