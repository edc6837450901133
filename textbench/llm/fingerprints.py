"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint is the sorted array of the ``K`` smallest distinct 64-bit hashes of a
text's shingles (five words; a shorter text is one shingle; an empty one has none).
Sketches of parts merge into the sketch of the whole, and estimate resemblance,
containment and the number of distinct shingles. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.words import let, spaced_words

K = 128
SHINGLE = 5
#: Bytes of text in a range of ids, about; there are as many ranges as that makes.
RANGE_BYTES = 256 * 2**20


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Bottom-k sketch of one text. NULL and texts without words give an empty array."""
    return sketch_of_words(spaced_words(text), k, shingle)


def sketch_of_words(words: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - shingle + 1, F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, shingle)))
        found = F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)
        return F.when(F.size(words) > 0, found).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def merge_pair(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge(df: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One row per key: the sketch of all its parts together.

    Ranks distinct hashes per (key, salt) first, so that a key which holds a large
    part of all rows is spread, and then ranks at most k hashes per salt. NULL keys
    form one group; NULL sketches count as empty.
    """
    hashes = df.select(*keys, F.explode_outer(column).alias("hash"))
    salted = hashes.groupBy(*keys, "hash", F.pmod("hash", F.lit(64)).alias("salt")).agg(F.lit(1).alias("one"))
    local = Window.partitionBy(*keys, "salt").orderBy("hash")
    final = Window.partitionBy(*keys).orderBy("hash")
    kept = salted.withColumn("place", F.row_number().over(local)).filter(F.col("place") <= k)
    kept = kept.withColumn("place", F.row_number().over(final)).filter(F.col("place") <= k + 1)
    gathered = kept.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(column))
    return gathered.withColumn(column, F.slice(column, 1, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; two empty sketches resemble each other fully."""
    union = merge_pair(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    largest = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / largest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_shingles(merge_pair(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    """A sketch as text: its hashes as 16 hexadecimal digits each, packed in base 64."""
    digits = F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0"))
    return F.base64(F.unhex(F.array_join(digits, "")))


def ranges_for(documents: DataFrame, least: int) -> int:
    """How many ranges of RANGE_BYTES the texts make, ``least`` at least."""
    total = documents.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    return max(least, -(-total // RANGE_BYTES))


def splits(documents: DataFrame, blocks: int) -> tuple[list[int], int | None]:
    """Ids that cut the documents into about ``blocks`` even ranges, and the id that
    comes first. The driver gets a number for each range, that is for RANGE_BYTES of text."""
    shares = [i / blocks for i in range(1, blocks)] or [0.0]
    row = documents.agg(
        F.percentile_approx("doc_id", shares, max(10_000, 20 * blocks)).alias("at"),
        F.min("doc_id").alias("first"),
        F.count_if(F.col("doc_id").isNull()).alias("unknown"),
    ).first()
    return sorted({x for x in row["at"] or [] if x > row["first"]}), None if row["unknown"] else row["first"]


def block_of(doc_id: Column, at: list[int]) -> Column:
    """How many of the sorted ids ``at`` are not above ``doc_id``, in two steps of
    about the square root of their number; NULL ids come first."""
    if not at:
        return F.lit(0)
    width = max(1, round(len(at) ** 0.5))
    tops = F.lit(at[::width])
    groups = F.array(*(F.lit(at[i : i + width]) for i in range(0, len(at), width)))
    group = F.size(F.filter(tops, lambda x: x <= doc_id))
    inside = F.size(F.filter(F.get(groups, group - 1), lambda x: x <= doc_id))
    return F.when(doc_id.isNull() | (group == 0), F.lit(0)).otherwise((group - 1) * width + inside)


def edit_and_compare(documents: DataFrame, k: int = K, blocks: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    ``documents`` (doc_id, text, ...): the edited text has the last floor(n/4) code
    points replaced by the first as many (or all) of the next document, by ascending
    doc_id; after the last comes the first. Rows of equal id follow each other by
    text; rows without an id come first; a NULL text counts as ''. A single row is
    its own next. Other columns are ignored; an empty table gives no rows.

    Texts are shuffled once, into ranges of ids. The first row of each range is also
    sent to the range before, so no step needs all rows in order in one task.
    """
    spark = documents.sparkSession
    blocks = blocks or ranges_for(documents, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    at, first = splits(documents.select("doc_id"), blocks)
    block = block_of(F.col("doc_id"), at)
    # (range, turn): what stands first in a range also follows the last row of the range
    # before, and the first row of all follows the last
    nowhere = F.array().cast("array<struct<block:int,turn:int>>")
    to = lambda block, turn: F.array(F.struct(block.alias("block"), F.lit(turn).alias("turn")))
    places = F.concat(
        to(block, 0),
        F.when(F.col("doc_id").isin(at), to(block - 1, 1)).otherwise(nowhere) if at else nowhere,
        F.when(F.col("doc_id").eqNullSafe(F.lit(first).cast("bigint")), to(F.lit(len(at)), 2)).otherwise(nowhere),
    )
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.inline(places))
    order = Window.partitionBy("block").orderBy("turn", F.col("doc_id").asc_nulls_first(), "text")
    n = F.length("text")
    kept = n - F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.substring("next", F.lit(1), n - kept))
    placed = (
        rows
        .withColumn("next", F.lead("text").over(order))
        .withColumn("next", F.coalesce("next", F.lit("")))
        .select("doc_id", "text", "block", "turn", edited.alias("edited"))
        .withColumn("fingerprint", sketch(F.col("text"), k))
        .withColumn("next_fingerprint", F.lead("fingerprint").over(order))
        .filter("turn = 0")
    )
    return placed.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "fingerprint",
        sketch(F.col("edited"), k).alias("edited_fingerprint"),
        "next_fingerprint",
    )


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = edit_and_compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    a, b, c = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(a).alias("fingerprint"),
        printed(b).alias("edited_fingerprint"),
        resemblance(a, b).alias("near_edited"),
        resemblance(a, c).alias("near_next"),
        containment(a, b).alias("contained_in_edited"),
        distinct_shingles(a).alias("n_shingles"),
    )
