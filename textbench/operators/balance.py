"""Class counts, class weights, sampling weights and the balanced sample."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from textbench.fixed import COUNT_SMOOTHING, LABELS
from textbench.operators.labels import label_in_range, labels_frame
from textbench.operators.rows import ordinal_within


def _all_classes() -> WindowSpec:
    """Used on the K rows of a class table only."""
    return Window.partitionBy()


def zero_filled_counts(counts: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(label_id, label, n) with every listed class. ``counts`` has at most one row per class id."""
    k = len(labels)
    known = label_in_range(counts, k).select("label_id", "n")
    return (
        labels_frame(counts.sparkSession, labels)
        .join(known, "label_id", "left")
        .select("label_id", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def class_counts(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Rows per class id, 0..K-1."""
    counts = label_in_range(df, len(labels)).groupBy("label_id").agg(F.count("*").alias("n"))
    return zero_filled_counts(counts, labels)


def class_distribution(df: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Per label: rows in each split and their share of the split in percent, rows in all and their share."""
    parts = [F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}") for s in splits]
    counts = df.groupBy("label").agg(*parts, F.count("*").alias("n_all"))
    shares = [
        F.round(100.0 * F.col(f"n_{s}") / F.nullif(F.sum(f"n_{s}").over(_all_classes()), F.lit(0)), 4).alias(f"pct_{s}")
        for s in [*splits, "all"]
    ]
    return counts.select("*", *shares)


def class_weights(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """n_total / (K * n_class), 0 for a class without rows; K counts all listed classes."""
    counts = class_counts(df, labels)
    total = F.sum("n").over(_all_classes())
    return counts.withColumn(
        "weight", F.when(F.col("n") > 0, total / (F.lit(float(len(labels))) * F.col("n"))).otherwise(F.lit(0.0))
    )


def sampling_weights(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """1 / (n_class + 1e-6) per class."""
    return class_counts(df, labels).withColumn("weight", 1.0 / (F.col("n") + F.lit(COUNT_SMOOTHING)))


def attach_class_weight(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight of the row's class, from ``weights`` with one row per class."""
    return df.join(weights.select("label_id", "weight"), "label_id", "left")


# -- balanced sample ---------------------------------------------------------

BUCKET_HEX_DIGITS = 4  # 65,536 buckets per class
COPIES_PER_KEY = 1000
UNIFORM_HEX_DIGITS = 13  # 52 bits, exact in a double


def _hex_number(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def _uniform(text: Column, start: int) -> Column:
    return _hex_number(text, start, UNIFORM_HEX_DIGITS) / F.lit(float(16**UNIFORM_HEX_DIGITS))


def weighted_sample(
    df: DataFrame,
    seed: int,
    labels: Sequence[str] = LABELS,
    num_samples: int | None = None,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Draws with replacement, a row's chance being 1 / (rows of its class + 1e-6).

    Input: row_id (unique integer), label_id, and ``columns`` to carry along.
    Output: draw_id, label_id, row_id, columns; as many draws as there are input
    rows unless ``num_samples`` is given.

    A draw picks a class by the classes' total chances, then a position inside the
    class; both come from one md5 of seed and draw id, so a sample is reproducible
    on any number of partitions. Positions are counted in hash buckets of the row
    id, so no task holds a class. A row of a rare class is drawn very often, so
    its join key is salted: the expected number of copies per key stays below
    COPIES_PER_KEY however rare the class is. All of this moves keys only; ``columns``
    are joined to the drawn ids at the end. Counting the classes is a job of its own,
    run when the sample is defined.
    """
    k = len(labels)
    listed = label_in_range(df, k)
    rows = listed.select("row_id", "label_id")
    if num_samples is None:
        draw_ids = rows.select(F.col("row_id").alias("draw_id"))
    else:
        draw_ids = df.sparkSession.range(num_samples).select(F.col("id").alias("draw_id"))
    # K numbers: with them as literals the choice of a class is compiled arithmetic
    counts = rows.agg(*[F.expr(f"count_if(label_id = {i}) as n_{i}") for i in range(k)]).first()
    chances = [n / (n + COUNT_SMOOTHING) for n in counts]
    upto = list(accumulate(chances))
    n_draws = sum(counts) if num_samples is None else num_samples
    present = [i for i in range(k) if counts[i]]
    salts = {i: -(-n_draws // (len(present) * counts[i] * COPIES_PER_KEY)) for i in present}

    def of_class(values) -> str:
        return "case label_id " + " ".join(f"when {i} then {values[i]}L" for i in present) + " end" if present else "0L"

    # u_class is below 1, so u_class * total is below the last running chance
    picks = " ".join(f"when u_class * {upto[-1]!r}D < {upto[i]!r}D then {i}L" for i in present)
    draws = (
        draw_ids.select("draw_id", F.md5(F.concat(F.lit(f"{seed}:draw:"), F.col("draw_id").cast("string"))).alias("_digest"))
        .select(
            "draw_id",
            _uniform(F.col("_digest"), 1).alias("u_class"),
            _uniform(F.col("_digest"), 1 + UNIFORM_HEX_DIGITS).alias("u_row"),
            _hex_number(F.col("_digest"), 1 + 2 * UNIFORM_HEX_DIGITS, 6).alias("u_salt"),
        )
        .selectExpr("draw_id", "u_row", "u_salt", f"case {picks} end as label_id" if present else "0L as label_id")
        .selectExpr(
            "draw_id",
            "label_id",
            f"least(floor(u_row * {of_class(counts)}), {of_class(counts)} - 1) as _position",
            f"u_salt % {of_class(salts)} as _salt" if present else "0L as _salt",
        )
    )

    bucket = _hex_number(F.md5(F.concat(F.lit(f"{seed}:row:"), F.col("row_id").cast("string"))), 1, BUCKET_HEX_DIGITS)
    positioned = ordinal_within(rows, "row_id", ["label_id"], "_position", bucket).withColumn(
        "_salt", F.explode(F.expr(f"sequence(0L, {of_class(salts)} - 1)"))
    )
    # every draw has its row; an inner join would add null checks that compute the draw many times over
    drawn = draws.join(positioned, ["label_id", "_position", "_salt"], "left").select("draw_id", "label_id", "row_id", "_salt")
    if not columns:
        return drawn.drop("_salt")
    # only keys were sampled; what is carried along is moved once, rows of rare classes in as many copies as they have salts
    salts_of = F.explode(F.expr(f"sequence(0L, {of_class(salts)} - 1)")).alias("_salt")
    carried = listed.select("label_id", "row_id", *columns).select("row_id", *columns, salts_of)
    return drawn.join(carried, ["row_id", "_salt"], "left").select("draw_id", "label_id", "row_id", *columns)
