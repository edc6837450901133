"""Frames derived from the test tables; every row of a table is used.

The test tables hold no emotion labels and no model output, so both are derived
from ids. ``catalog.oracles`` states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.operators.rows import ordinal_within

MODELS = ["tuned", "few", "zero"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LABEL = """case when doc_id % 100 < 39 then 'neutral' when doc_id % 100 < 62 then 'joy'
     when doc_id % 100 < 79 then 'love' when doc_id % 100 < 93 then 'anger'
     when doc_id % 100 < 99 then 'sadness' else 'fear' end"""
_SPLIT = """case when (cast(floor(doc_id / 100) as bigint) * 37 + doc_id) % 20 < 14 then 'train'
     when (cast(floor(doc_id / 100) as bigint) * 37 + doc_id) % 20 < 17 then 'val' else 'test' end"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, label, split): labels skewed 39/23/17/14/6/1 %, splits 70/15/15 %."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id as row_id", "text", f"{_LABEL} as label", f"{_SPLIT} as split")


def labelled_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labelled`` with an unknown label and missing texts."""
    return labelled(spark, sf_dir).selectExpr(
        "row_id",
        "case when row_id % 50 = 9 then null else text end as text",
        "case when row_id % 50 = 7 then 'surprise' else label end as label",
        "split",
    )


def trainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, label, split) with the language as a label that can be learnt from the text."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id as row_id", "text", "lang as label", f"{_SPLIT} as split")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, row_id, text, true_label, pred_label): three models of falling quality over the same rows."""
    models = """array(named_struct('model', 'tuned', 'k', 0, 'good', 6),
        named_struct('model', 'few', 'k', 1, 'good', 2), named_struct('model', 'zero', 'k', 2, 'good', 0))"""
    return labelled(spark, sf_dir).selectExpr("*", f"inline({models})").selectExpr(
        "model",
        "row_id",
        "text",
        "label as true_label",
        """case when (row_id * 13 + k) % 10 < good then label
           else case (row_id * 7 + k) % 6 when 0 then 'joy' when 1 then 'sadness' when 2 then 'anger'
                when 3 then 'fear' when 4 then 'love' else 'neutral' end end as pred_label""",
    )


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predictions`` with a generated text in place of the label: multi-line, ambiguous, empty of labels or missing."""
    return predictions(spark, sf_dir).selectExpr(
        "model",
        "row_id",
        "text",
        "true_label",
        """case when row_id % 33 = 0 then concat('pain', char(10), char(10), 'Explanation:')
           when row_id % 11 = 0 then concat('Not SADNESS but ', pred_label)
           when row_id % 17 = 0 then concat('x Emotion: anger Emotion: ', char(10), upper(pred_label), ' ')
           when row_id % 19 = 0 then null
           else concat(pred_label, char(10), char(10), 'Explanation: The given "text" expresses') end as raw_output""",
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, z, y) with six class scores: component i of the vector counts for class i mod 6."""
    fold = """transform(sequence(0, 5), k -> aggregate(
        filter(transform(embedding, (x, i) -> if(i % 6 = k, cast(x as double), null)), x -> x is not null),
        0.0D, (a, x) -> a + x)) as z"""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as row_id", fold, "cast(label % 6 as bigint) as y")


def _event_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), "value")
    return ordinal_within(events, "event_id", ["run_id"], "position")


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, epoch, val_f1): every event of a user is an epoch of the user's run."""
    return _event_ordinals(spark, sf_dir).selectExpr(
        "run_id", "position + 1 as epoch", "cast((event_id * 37) % 1000 as double) / 1000.0D as val_f1"
    )


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, epoch, batch, loss): five events make an epoch."""
    return _event_ordinals(spark, sf_dir).selectExpr(
        "run_id", "cast(floor(position / 5) as bigint) + 1 as epoch", "position % 5 as batch", "value as loss"
    )
