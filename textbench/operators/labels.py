"""Label vocabularies as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.fixed import LABELS, MISSING_TEXT, UNKNOWN_CLASS
from textbench.functions.labels import encode_label, is_known_label, label_array
from textbench.operators.rows import sorted_numbers


def labels_frame(spark: SparkSession, labels: Sequence[str] = LABELS) -> DataFrame:
    """(label_id, label), one row per listed label."""
    return spark.range(0, len(labels), 1, 1).select(
        F.col("id").alias("label_id"), F.get(label_array(labels), F.col("id").cast("int")).alias("label")
    )


def label_in_range(df: DataFrame, k: int, id_col: str = "label_id") -> DataFrame:
    return df.filter(F.col(id_col).between(0, k - 1))


def label_union(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Distinct labels over all splits."""
    return df.select(F.coalesce(F.col(label_col), F.lit(MISSING_TEXT)).alias("label")).distinct()


def unseen_labels(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Labels of the data that the list does not have. Empty means every label is known."""
    return label_union(df.filter(~is_known_label(F.col("label"), labels)))


def label_mapping(df: DataFrame) -> DataFrame:
    """Sorted distinct labels with ids from 0, however many and however alike."""
    return sorted_numbers(label_union(df), ["label"], "label_id").select("label_id", "label")


def resolve_labels(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """The listed labels if the data of all splits have no other; else those of the train split, sorted."""
    if unseen_labels(df, labels).isEmpty():
        return labels_frame(df.sparkSession, labels).withColumn("mapping", F.lit("listed"))
    return label_mapping(df.filter(F.col("split") == "train")).withColumn("mapping", F.lit("derived"))


def encode_by_mapping(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``label_id`` from a (label_id, label) table such as ``resolve_labels`` gives, unknown labels as class 0.

    For vocabularies that only the data know, of any size: a plain equi-join, for
    which the adaptive planner picks a broadcast by measured size, or splits skewed
    labels. ``known`` tells which labels the table has.
    """
    by_label = mapping.select(F.col("label").alias("_label"), F.col("label_id").alias("_id"))
    known = F.coalesce(F.col("label"), F.lit(MISSING_TEXT)) == F.col("_label")
    return (
        df.join(by_label, known, "left")
        .withColumn("label_id", F.coalesce("_id", F.lit(UNKNOWN_CLASS)).cast("bigint"))
        .withColumn("known", F.col("_id").isNotNull())
        .drop("_label", "_id")
    )


def resolved_label(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """``label`` as the mapping knows it: an unknown label becomes that of class 0."""
    first = mapping.filter(F.col("label_id") == UNKNOWN_CLASS).select("label").scalar()
    encoded = encode_by_mapping(df, mapping)
    label = F.when(F.col("known"), F.coalesce("label", F.lit(MISSING_TEXT))).otherwise(first)
    return encoded.withColumn("label", label).drop("known")


def encode_table(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Add ``label_id`` and ``known``; an unknown label is class 0 but stays countable."""
    return df.withColumn("label_id", encode_label(F.col("label"), labels)).withColumn(
        "known", is_known_label(F.col("label"), labels)
    )
