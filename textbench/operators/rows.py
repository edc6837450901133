"""Row positions, limits, order, and running totals that no single key can overload.

A running total over one key is a window that puts all rows of the key into one
task. ``running_totals`` cuts the rows of a key into blocks: a total per block is
a small pre-aggregated table, its running sums are the offsets, and the row window
covers one block at a time. The result is exact whatever share of the rows one
key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.session import materialize

BLOCK_ROWS = 65536
#: Ranges that one step of ``nth_value`` counts, and so the rows that the driver gets.
RANGES = 4096


def block_of(order: str) -> Column:
    """Blocks of consecutive integers."""
    return F.floor(F.col(order) / BLOCK_ROWS)


def running_totals(
    df: DataFrame, keys: list[str], order: str, totals: dict[str, tuple[Column, str]], block: Column | None = None
) -> DataFrame:
    """Add running totals within ``keys`` up to and with the row, by ``order``, unique within the keys.

    ``totals`` maps a new column to (expression, 'sum' or 'max'). ``block`` cuts the
    order into parts; it must not decrease along it, unless any fixed order will do
    (then it may be a hash, and the order is by block first). Keys must not be NULL.
    Without it, the order column should be dense over long stretches, as row numbers
    and partition-wise ids are: ids strewn over the whole number range would make
    almost as many blocks as rows (``sorted_numbers`` makes them dense).

    The input is evaluated once: rows with the totals inside their blocks are written to
    the shared folder, and the last row of a block has the total of the block. Offsets
    are a row per block, which adaptive planning broadcasts by their measured size.
    """
    functions = {"sum": F.sum, "max": F.max}
    block = block_of(order) if block is None else block
    for key in keys:
        block = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is NULL"))).otherwise(block)
    blocked = df.withColumn("_block", block)

    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = materialize(
        blocked.select("*", *[functions[how](expr).over(inside).alias(f"_in_{name}") for name, (expr, how) in totals.items()])
    )
    per_block = rows.groupBy(*keys, "_block").agg(*[F.max_by(f"_in_{name}", order).alias(f"_before_{name}") for name in totals])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys,
        "_block",
        *[functions[how](f"_before_{name}").over(earlier).alias(f"_before_{name}") for name, (_, how) in totals.items()],
    )
    joined = rows.join(offsets, [*keys, "_block"], "left")  # an inner join would filter the NULL keys away first

    def combined(name: str, how: str) -> Column:
        before, within = F.col(f"_before_{name}"), F.col(f"_in_{name}")
        if how == "max":
            return F.greatest(before, within)
        return F.coalesce(before + within, before, within)

    return joined.select(*[F.col(c) for c in df.columns], *[combined(name, how).alias(name) for name, (_, how) in totals.items()])


def ordinal_within(
    df: DataFrame, order: str, keys: list[str] | None = None, name: str = "ordinal", block: Column | None = None
) -> DataFrame:
    """Position 0, 1, 2, ... of a row among the rows of its keys, by a unique integer column.

    The order may be strewn over the whole number range. Keys must not be NULL. Given
    ``block``, any fixed order will do; see ``running_totals``.
    """
    if block is not None:
        one = F.lit(1).cast("bigint")
        counted = running_totals(df, keys or [], order, {name: (one, "sum")}, block)
        return counted.withColumn(name, F.col(name) - 1)
    if not keys:
        return sorted_numbers(df, [order], name)
    for key in keys:
        known = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is NULL"))).otherwise(F.col(key))
        df = df.withColumn(key, known)
    numbered = sorted_numbers(df, [*keys, order], "_number")
    first = numbered.groupBy(*keys).agg(F.min("_number").alias("_first"))
    joined = numbered.join(first, keys)
    return joined.select(*[F.col(c) for c in df.columns], (F.col("_number") - F.col("_first")).alias(name))


def sorted_numbers(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """Position 0, 1, 2, ... of a row in the given order of the whole frame, whatever its values.

    Sampled splitters cut the order into ranges of about equal size, so that many rows
    of one value of the first columns are many ranges too; only rows equal in all of them
    stay together, and those stand in no particular order. A range numbers its rows as
    they come, and a count per range, of which there are as many as partitions, gives the
    offsets. The sorted rows are written once to the shared folder.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits of this id are the partition's number, the lower ones count its rows
    placed = materialize(ranges.withColumn("_at", F.monotonically_increasing_id()))
    of_range = F.shiftright("_at", 33)
    sizes = placed.groupBy(of_range.alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_range", of_range).join(offsets, "_range")
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select(*[F.col(c) for c in df.columns], (F.col("_offset") + at).alias(name))


#: Bytes of a file's offset, and of all offsets that may be sent to every executor.
OFFSET_BYTES, BROADCAST_BYTES = 64, 512 * 2**20


def at_offsets(placed: DataFrame, offsets: DataFrame) -> DataFrame:
    """``placed`` with the offset of its file, from ``offsets`` (_path, _offset), a materialized frame.

    Their bytes follow from their number, which is known before the plan is made: up to
    BROADCAST_BYTES, eight million files, they are sent to the executors and no row is moved.
    """
    small = offsets.count() * OFFSET_BYTES <= BROADCAST_BYTES
    return placed.join(F.broadcast(offsets) if small else offsets, "_path")


def row_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Position of a row in the files of a Parquet source, files in path order.

    Takes a frame straight from ``spark.read.parquet``. The reader knows the position
    inside the file, so only one row count per file has to be summed up (the window sees
    one row per file). Files are joined by a hash of their path; see ``at_offsets``.
    """
    path = F.xxhash64(F.col("_metadata.file_path"))
    placed = df.select("*", path.alias("_path"), F.col("_metadata.row_index").alias("_index"))
    per_file = df.select(F.col("_metadata.file_path").alias("_path")).groupBy("_path").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select(
        F.xxhash64("_path").alias("_path"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    numbered = at_offsets(placed, materialize(offsets)).withColumn(name, F.col("_offset") + F.col("_index"))
    return numbered.drop("_path", "_index", "_offset")


def nth_value(df: DataFrame, n: int, order: str) -> int | None:
    """The n-th smallest value of an integer column, None if fewer are known.

    Each step counts the rows in at most RANGES + 1 equal ranges and goes on in the one
    that holds the n-th, until that has at most BLOCK_ROWS rows. No task sees more,
    however the values are strewn, and the driver gets one count per range.
    """
    values = df.select(F.col(order).alias("v")).filter("v is not null")
    low, high, rows = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if rows < n:
        return None
    before = 0
    while rows > BLOCK_ROWS and high > low:
        width = max(2, (high - low) // RANGES + 1)
        inside = values.filter(F.col("v").between(low, high))
        start = F.try_subtract("v", F.pmod("v", F.lit(width)))  # NULL below the least number, which comes first
        counts = inside.groupBy(start.alias("start")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in counts.orderBy("low").collect():
            if before + row["n"] >= n:
                low, high, rows = row["low"], row["high"], row["n"]
                break
            before += row["n"]
    least = values.filter(F.col("v").between(low, high)).orderBy("v").limit(n - before)
    return least.agg(F.max("v")).first()[0]


def first_n(df: DataFrame, n: int | None, order: str = "row_id") -> DataFrame:
    """The first ``n`` rows by ``order``, a unique integer column; None and 0 mean all rows.

    One filter by the n-th value, for every n: it reaches the Parquet scan, and no row
    is sorted or moved. So the rows come in no particular order, for any n. Rows whose
    ``order`` is NULL are not counted, unless all rows are asked for. The n-th value is
    looked up when the frame is made, in a few passes over the one column.
    """
    if not n:
        return df
    last = nth_value(df, n, order)
    known = F.col(order).isNotNull()
    return df.filter(known if last is None else F.col(order) <= last)


def shuffle_rows(df: DataFrame, seed: int, key: str = "row_id") -> DataFrame:
    """Seeded random order: a parallel range sort by a hash of seed and key, which stays in ``sort_key``."""
    return df.withColumn("sort_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("sort_key", key)
