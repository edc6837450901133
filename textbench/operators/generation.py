"""Text generation by a function of the caller."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textbench.fixed import FALLBACK_LABEL
from textbench.session import materialize

STORED = "prompt_hash string, output string"


def generate(
    df: DataFrame,
    fn: Callable[[pd.Series], pd.Series],
    prompt_col: str = "prompt",
    output_col: str = "raw_output",
    failed: str | None = FALLBACK_LABEL,
) -> DataFrame:
    """Add ``output_col``: ``fn`` of a batch of prompts.

    A batch that fails is repeated prompt by prompt, so only the failing prompts
    become ``failed``; given None, a column ``answered`` tells them apart. The batch size
    is spark.sql.execution.arrow.maxRecordsPerBatch. Python sees every column that is
    passed in: select and limit before. See ``generate_stored`` for outputs that outlive the run.
    """
    marked = failed is None
    fields = [*df.schema.fields, T.StructField(output_col, T.StringType())]
    schema = T.StructType([*fields, T.StructField("answered", T.BooleanType())] if marked else fields)

    def one(prompt):
        try:
            return fn(pd.Series([prompt])).iloc[0], True
        except Exception:
            return failed, False

    def run(batches):
        for batch in batches:
            prompts = batch[prompt_col]
            try:
                outputs = [(output, True) for output in fn(prompts)]
            except Exception:
                outputs = [one(p) for p in prompts]
            batch[output_col] = pd.Series([output for output, _ in outputs], index=batch.index, dtype=object)
            if marked:
                batch["answered"] = [answered for _, answered in outputs]
            yield batch

    return df.mapInPandas(run, schema)


def stored_outputs(spark: SparkSession, store: str) -> DataFrame:
    """(prompt_hash, output) of a store, each prompt once; none if there is no store yet."""
    try:
        rows = spark.read.schema(STORED).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORED)
    return rows.groupBy("prompt_hash").agg(F.first("output").alias("output"))


def generate_stored(
    df: DataFrame,
    fn: Callable[[pd.Series], pd.Series],
    store: str,
    prompt_col: str = "prompt",
    output_col: str = "raw_output",
    failed: str = FALLBACK_LABEL,
    prompts_per_task: int = 100,
    tasks: int = 10_000,
) -> DataFrame:
    """Add ``output_col``, asking ``fn`` only for prompts that ``store`` does not have.

    ``store`` is a folder that all executors share, one for each generator; it holds an
    output for each hash of a prompt, and grows. Equal prompts are asked once. A task gets
    about ``prompts_per_task`` prompts, more where that would make more than ``tasks`` tasks.
    The outputs of a task are in the store as soon as it ends: if an executor or the whole
    run is lost, the next one asks what is missing. Prompts that ``fn`` fails for become
    ``failed`` and are not stored, so a later run asks them again. ``df`` is read twice, to
    ask and to answer; materialize it first if that is dear.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_hash", F.sha2(F.coalesce(prompt_col, F.lit("")), 256))
    asked = keyed.groupBy("_hash").agg(F.first(prompt_col).alias("prompt"))
    known = stored_outputs(spark, store).select(F.col("prompt_hash").alias("_hash"))
    missing = materialize(asked.join(known, "_hash", "left_anti"))
    n = missing.count()
    if n:
        spread = missing.repartition(min(tasks, -(-n // prompts_per_task)), "_hash")
        answered = generate(spread, fn, failed=None).filter("answered")
        rows = answered.select(F.col("_hash").alias("prompt_hash"), F.col("raw_output").alias("output"))
        # this committer moves the files of a task when it ends; they stay if the job fails later
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(store)
    found = stored_outputs(spark, store).select(F.col("prompt_hash").alias("_hash"), F.struct("output").alias("_found"))
    joined = keyed.join(found, "_hash", "left")
    output = F.when(F.col("_found").isNull(), F.lit(failed)).otherwise(F.col("_found.output"))
    return joined.select(*[F.col(c) for c in df.columns], output.alias(output_col))
