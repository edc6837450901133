"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.language import held_out, thinned
from textbench.session import materialize


#: Bytes of the sampled texts of a class.
BYTES_PER_CLASS = 48 * 2**20
#: Bytes that a row of labels takes in a task's lookup, and of those that are sent to every task.
LABEL_BYTES, BROADCAST_BYTES = 200, 128 * 2**20


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the classes 0 and 1, of rows that are not held out, each once."""
    rows = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.select("doc_id", F.col(label).cast("int").alias("label")).distinct().filter("label in (0, 1)")


def with_labels(documents: DataFrame, usable: DataFrame) -> DataFrame:
    """(doc_id, label, text) of all labelled rows. The labels are sent to the tasks that
    read documents if they were counted to be few bytes; else both are shuffled."""
    usable = materialize(usable)
    few = usable.count() * LABEL_BYTES <= BROADCAST_BYTES
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(usable) if few else usable, "doc_id").select("doc_id", "label", "text")


def sample(
    documents: DataFrame, labels: DataFrame, label: str, per_class: int, bytes_per_class: int = BYTES_PER_CLASS
) -> DataFrame:
    """(label, text, weight) of at most ``per_class`` labelled documents of each class 0 and
    1, and ``bytes_per_class`` of their texts, whole ones.

    ``weight`` is how many labelled rows of its class a sampled row stands for.

    Chosen by a hash of the id from the rows that are not held out; labels of NULL or
    other values, and ids without a document, are passed over. Rows of one id and text
    count once, and different texts of an id are ranked like other documents, so that
    both bounds hold whatever the ids are. What is sent to the tasks that read documents
    is bounded by ``per_class``.
    """
    usable = usable_labels(labels, label)
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    near = thinned(usable, "label", totals, per_class, F.xxhash64("doc_id")) if totals else usable.withColumn("draw", F.lit(0.0))

    def first(rows: DataFrame, *order: str) -> DataFrame:
        parts = [rows.filter(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
        return materialize(parts[0].unionByName(parts[1]))

    chosen = first(near, "draw", "doc_id")
    text = F.coalesce("text", F.lit(""))
    texts = documents.select("doc_id", F.xxhash64(text).alias("hash"), F.octet_length(text).cast("bigint").alias("bytes"), text.alias("text"))
    found = texts.select("doc_id", "hash", "bytes").join(F.broadcast(chosen), "doc_id").distinct()
    chosen = first(found, "draw", "doc_id", "hash")
    upto = F.sum("bytes").over(Window.partitionBy("label").orderBy("draw", "doc_id", "hash"))
    chosen = materialize(chosen.withColumn("upto", upto).filter(F.col("upto") - F.col("bytes") <= bytes_per_class))
    sampled = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    weights = [F.when(F.col("label") == c, totals[c] / n) for c, n in sampled.items()]
    chosen = chosen.select("doc_id", "hash", "label")
    joined = texts.join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash", "label"])
    return materialize(joined.select("doc_id", "label", "text", F.coalesce(*weights, F.lit(1.0)).alias("weight")))
