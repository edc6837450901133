"""Vocabulary, token ids and telling tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textbench.functions.text import tokens

PADDING_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2
#: Parts in which the tokens of a label are ranked before the last ranking.
RANKING_PARTS = 64


def token_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def token_vocabulary(df: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent tokens, equal ones in token order, with ids from 2.

    How many tokens share a count tells the least count that can get in; only
    tokens with that count or more go to the top-n, instead of ``size`` tokens of
    every task.
    """
    counts = token_counts(df)
    by_count = counts.groupBy("n").agg(F.count("*").alias("tokens"))
    from_the_top = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = by_count.select("n", F.sum("tokens").over(from_the_top).alias("upto")).filter(F.col("upto") >= size)
    least = enough.agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(size)
    by_rank = Window.orderBy(F.desc("n"), "token")
    return top.select("token", (F.row_number().over(by_rank) - 1 + FIRST_ID).cast("bigint").alias("token_id"), "n")


def encode_tokens(
    df: DataFrame, vocabulary: DataFrame, max_length: int, key: str = "row_id", columns: Sequence[str] = ()
) -> DataFrame:
    """(key, *columns, input_ids, attention_mask), ids cut and right-padded to ``max_length``.

    ``key`` is unique and not NULL. The first ``max_length`` tokens of each row are
    joined with the vocabulary, whose size the caller chose: the adaptive planner
    broadcasts it if it is small and splits frequent tokens if not. The ids are then
    gathered by row, at most ``max_length`` of them, with the token's place; a row without
    tokens has one place without. Texts are read and not moved; ``columns``, small ones
    such as a label's id, travel with the first place.
    """
    parts = F.posexplode_outer(F.slice(tokens(F.col("text")), 1, max_length)).alias("_place", "token")
    first = df.select(key, *columns, parts)
    leading = F.coalesce("_place", F.lit(0)) == 0
    first = first.select(key, "_place", "token", *[F.when(leading, F.col(c)).alias(c) for c in columns])
    known = vocabulary.select("token", F.col("token_id").cast("int").alias("_id"))
    placed = F.when(F.col("_place").isNotNull(), F.struct("_place", F.coalesce("_id", F.lit(UNKNOWN_ID)).alias("_id")))
    encoded = first.join(known, "token", "left").groupBy(key).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in columns], F.sort_array(F.collect_list(placed))["_id"].alias("_ids")
    )
    pad = F.lit(max_length) - F.size("_ids")
    return encoded.select(
        key,
        *columns,
        F.concat("_ids", F.array_repeat(F.lit(PADDING_ID), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
    )


def key_tokens(df: DataFrame, labels: Sequence[str] | None, top: int) -> DataFrame:
    """The ``top`` most telling tokens of each listed label, or of each label there is.

    Score: log of the odds of the token inside the label over those outside, each
    count plus one. Rounded before ranking, so that equal scores are equal on any
    engine; ties go in token order. Counts are rows (label, token), so plans are the same
    for six labels and for thousands. They are shuffled by token once, whose rows, one per
    label, give its total; scores are ranked in parts of a label first, so that no task
    sees all tokens of a label, whatever ``top`` is.
    """
    rows = df if labels is None else df.filter(F.col("label").isin(list(labels)))
    cells = rows.filter("label is not null").select("label", F.explode(tokens(F.col("text"))).alias("token"))
    cells = cells.groupBy("label", "token").agg(F.count("*").alias("n"))
    counted = cells.withColumn("n_all", F.sum("n").over(Window.partitionBy("token")))
    label_totals = cells.groupBy("label").agg(F.sum("n").alias("label_total"))
    total = label_totals.agg(F.sum("label_total").alias("n")).scalar()
    scored = counted.join(label_totals, "label").withColumn("all_total", total)
    scored = scored.selectExpr(
        "label",
        "token",
        "n",
        """round(ln((n + 1.0D) / (label_total - n + 1.0D))
           - ln((n_all - n + 1.0D) / (all_total - label_total - (n_all - n) + 1.0D)), 6) as score""",
    )
    best = Window.partitionBy("label").orderBy(F.desc("score"), "token")
    part = F.pmod(F.xxhash64("token"), F.lit(RANKING_PARTS))
    best_of_part = Window.partitionBy("label", part).orderBy(F.desc("score"), "token")
    return (
        scored.withColumn("rank", F.row_number().over(best_of_part))
        .filter(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(best).cast("bigint"))
        .filter(F.col("rank") <= top)
        .select("label", "rank", "token", "n", "score")
    )
