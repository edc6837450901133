"""Labelled texts and predictions in CSV or Parquet.

Columns of a CSV are found by the header of each file, whatever its order. Records
with more fields than the header fail, unless they are asked for. A CSV with quoted
newlines can only be read by one task per file: keep such data in many files, say
``multi_line=False`` if it has none, or convert it to Parquet with ``ingest``.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.functions.text import missing_to_nan, null_to_nan
from textbench.operators.predictions import truncate_output

# a quote inside a field is doubled; blanks around a field belong to it
CSV_FORMAT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


SURPLUS = "_surplus_field"


#: Files that are opened at once to read their headers.
OPENED_AT_ONCE = 32


def _first_line(spark: SparkSession, file: str) -> str | None:
    """The first line of a file that is not blank, without what stands behind it."""
    java, settings = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = java.org.apache.hadoop.fs.Path(java.java.net.URI(file))
    stream = path.getFileSystem(settings).open(path)
    try:
        codec = java.org.apache.hadoop.io.compress.CompressionCodecFactory(settings).getCodec(path)
        if codec is not None:
            stream = codec.createInputStream(stream)
        reader = java.java.io.BufferedReader(java.java.io.InputStreamReader(stream, "UTF-8"))
        while (line := reader.readLine()) is not None:
            if line.lstrip("\ufeff").strip():
                return line.lstrip("\ufeff")
        return None
    finally:
        stream.close()


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of each header. Each file that Spark has listed is opened once, many at
    a time, and only its first bytes are read."""
    files = sorted(spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(OPENED_AT_ONCE) as pool:
        lines = list(pool.map(lambda file: _first_line(spark, file), files))
    files_of: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines, strict=True):
        if line is not None:
            files_of.setdefault(tuple(next(csv.reader([line]))), []).append(unquote(file))
    return files_of


def _read_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All columns as strings, and in SURPLUS what stands behind the last named one."""
    parts = []
    for names, files in _headers(spark, path).items():
        kinds = ", ".join(f"`{name}` string" for name in (*names, SURPLUS))
        reader = spark.read.schema(kinds).options(**CSV_FORMAT, multiLine=str(multi_line).lower())
        parts.append(reader.csv(files))
    if not parts:
        return spark.read.options(**CSV_FORMAT).csv(path)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_table(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True, malformed: str = "fail"
) -> DataFrame:
    """All columns of a CSV as strings, or a Parquet table.

    A CSV record with fewer fields than its header has missing values. One with more is
    malformed: ``malformed`` is 'fail' (an error when it is read), 'drop', or 'mark',
    which keeps it and adds a boolean column ``malformed`` to count or filter by.
    """
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    table = _read_csv(spark, path, multi_line)
    if SURPLUS not in table.columns:
        return table
    surplus = F.col(SURPLUS).isNotNull()
    if malformed == "mark":
        return table.withColumn("malformed", surplus).drop(SURPLUS)
    if malformed == "drop":
        return table.filter(~surplus).drop(SURPLUS)
    if malformed != "fail":
        raise ValueError("malformed is 'fail', 'drop' or 'mark'")
    wrong = F.raise_error(F.concat(F.lit("a record has more fields than its header: "), F.col(SURPLUS)))
    names = [c for c in table.columns if c != SURPLUS]
    return table.select(*(F.when(surplus, wrong).otherwise(F.col(f"`{c}`")).alias(c) for c in names))


def ingest(spark: SparkSession, path: str, target: str, multi_line: bool = True, malformed: str = "fail") -> None:
    """A CSV folder as Parquet, which many tasks can read whatever its fields hold."""
    read_table(spark, path, "csv", multi_line, malformed).write.parquet(target)


def read_labelled(
    spark: SparkSession, path: str, fmt: str = "csv", keep: Sequence[str] = (), multi_line: bool = True, malformed: str = "fail"
) -> DataFrame:
    """(*keep, text, label); columns are found by name, missing values become ``nan``.

    In a CSV so do the strings that its readers take for missing; in a typed source
    such as Parquet they are texts like others.
    """
    table = read_table(spark, path, fmt, multi_line, malformed)
    marked = ["malformed"] if fmt == "csv" and malformed == "mark" else []
    known = missing_to_nan if fmt == "csv" else null_to_nan
    return table.select(
        *keep,
        known(F.col("text").cast("string")).alias("text"),
        known(F.col("label").cast("string")).alias("label"),
        *marked,
    )


def read_splits(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv", keep: Sequence[str] = ()) -> DataFrame:
    """One table per split, together in one frame with a ``split`` column."""
    parts = [read_labelled(spark, path, fmt, keep).withColumn("split", F.lit(split)) for split, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet, one folder per split, so that reading one split skips the others."""
    df.write.partitionBy("split").parquet(path)


def number_rows(table: DataFrame) -> DataFrame:
    """Add ``row_id``, the position 0, 1, 2, ... in the file, to a table read from a single CSV file.

    Such a file is read by one task, whose rows Spark numbers in order. For saved
    predictions that have no key, so that models can be paired by position. Tables of
    many files need a key, or Parquet and ``row_ordinal``.
    """
    files = table.inputFiles()
    if len(files) != 1:
        raise ValueError(f"positions need a single file, not {len(files)}")
    return table.withColumn("row_id", F.monotonically_increasing_id())


def read_predictions(
    spark: SparkSession, path: str, model: str, fmt: str = "csv", keep: Sequence[str] = (), number: bool = False
) -> DataFrame:
    """(model, *keep, true_label, pred_label), with ``number`` also the row_id by position in a single CSV file."""
    table = read_table(spark, path, fmt)
    if number:
        table, keep = number_rows(table), [*keep, "row_id"]
    return table.select(F.lit(model).alias("model"), *keep, "true_label", "pred_label")


def read_available_predictions(
    spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv", keep: Sequence[str] = (), number: bool = False
) -> tuple[DataFrame, list[str]]:
    """Predictions of all models whose path exists, and the names of the models left out."""
    found, missing = [], []
    for model, path in paths.items():
        try:
            found.append(read_predictions(spark, path, model, fmt, keep, number))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(model)
    if not found:
        raise FileNotFoundError(f"no predictions for {missing}")
    return reduce(DataFrame.unionByName, found), missing


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", keep: Sequence[str] = ()) -> None:
    """text, true_label, pred_label and, if there, raw_output, cut to the saved lengths."""
    columns = [*keep, "text", "true_label", "pred_label"] + (["raw_output"] if "raw_output" in df.columns else [])
    saved = truncate_output(df.select(*columns))
    if fmt == "csv":
        saved.write.options(**CSV_FORMAT, emptyValue="").csv(path)
    else:
        saved.write.format(fmt).save(path)


def write_labelled(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The whole table as it is, in the CSV format that the readers expect, or as Parquet."""
    if fmt == "csv":
        df.write.options(**CSV_FORMAT, emptyValue="").csv(path)
    else:
        df.write.format(fmt).save(path)
