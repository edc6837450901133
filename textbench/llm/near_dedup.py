"""Near-duplicate groups by ProbMinHash signatures, banding and verification.

Every shingle of a text sends points of a Poisson process, at a rate that is its
weight, to random slots; a slot keeps the shingle that came first, and a text is done
when no later point can win a slot. Two texts agree in a slot with a probability that
is the probability Jaccard similarity of their weighted shingles. Slots are cut into
bands; texts that share a band meet in its bucket. First each member is compared with
the bucket's pivots, its best and its least connected members, which joins most groups.
The members of buckets that are then still in several groups are joined on their rarest
shingles, of which any two texts of the similarity share one, so that no link between
texts that share a bucket is lost and rows follow real candidates, not pairs of members.
Pairs are verified on the exact shingle sets, and verified pairs are joined into groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.words import IS_SPACE, mix, spans, window_hashes, word_hashes
from textbench.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
SLOTS = BANDS * ROWS
MARKED = "id bigint, copy string, size int, bands array<bigint>"
#: Texts whose shingles are held at once.
ROWS_AT_ONCE = 1000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``width`` words, repeats included, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return window_hashes(word_hashes(data, *spans(~IS_SPACE[data])), width)


def signature(elements: np.ndarray, weights: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The element that comes first in each slot.

    All elements take their next arrivals together, and drop out once their latest one
    comes after the last slot was filled for good.
    """
    best, winner = np.full(slots, np.inf), np.zeros(slots, dtype=np.uint64)
    when, step = np.zeros(len(elements)), 0
    rate = weights.astype(np.float64)
    while len(elements):
        n = min(64, -(-slots // len(elements)))
        turns = (np.arange(step, step + n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * _STEP
        random = mix(elements[:, None] + turns)
        gaps = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        arrivals = when[:, None] + np.cumsum(gaps, axis=1)
        slot = (random & np.uint64(2047)).astype(np.int64).ravel() % slots
        order = np.argsort(-arrivals, axis=None, kind="stable")
        first, who = np.full(slots, np.inf), np.zeros(slots, dtype=np.uint64)
        first[slot[order]] = arrivals.ravel()[order]  # the earliest is written last
        who[slot[order]] = np.repeat(elements, n)[order]
        sooner = first < best
        best[sooner], winner[sooner] = first[sooner], who[sooner]
        active = arrivals[:, -1] <= best.max()
        elements, rate, when = elements[active], rate[active], arrivals[active, -1]
        step += n
    return winner


def bands_of(text: str) -> tuple[int, np.ndarray]:
    """The number of different shingles, and one hash per band; none for a text without words."""
    found, counts = np.unique(shingles(text), return_counts=True)
    if not len(found):
        return 0, np.zeros(0, dtype=np.int64)
    slots = signature(found, 1 + np.log(counts)).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out * _STEP + slots[:, i])
    return len(found), out.view(np.int64)


def row_id(doc_id: Column, text: Column) -> Column:
    """The id; rows without one get a negative number that follows from their text."""
    own = -F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2) - 1
    return F.coalesce(doc_id.cast("bigint"), own)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that less of what is made of them is held at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(first, ROWS_AT_ONCE)


def _mark(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [bands_of(text.as_py()) for text in batch.column("text")]
            size = pa.array([n for n, _ in found], pa.int32())
            bands = pa.array([hashes for _, hashes in found], pa.list_(pa.int64()))
            columns = [batch.column("id"), batch.column("copy"), size, bands]
            yield pa.RecordBatch.from_arrays(columns, ["id", "copy", "size", "bands"])

    text = F.coalesce("text", F.lit(""))
    rows = documents.select(row_id(F.col("doc_id"), F.col("text")).alias("id"), F.md5(text).alias("copy"), text.alias("text"))
    return rows.mapInArrow(run, MARKED)


def buckets(members: DataFrame) -> DataFrame:
    """(id, size, bucket, wide, n) of buckets with n > 1 members, of ``members`` (id, size, bands).

    Buckets are those of single bands and, ``wide``, of pairs of neighbouring bands, which
    hold closer texts.
    """
    both = F.concat(
        F.transform("bands", lambda h, i: F.struct(F.xxhash64(i, h).alias("bucket"), F.lit(False).alias("wide"))),
        F.transform(
            "bands",
            lambda h, i: F.struct(
                F.xxhash64(i + BANDS, h, F.get(F.col("bands"), (i + 1) % BANDS)).alias("bucket"), F.lit(True).alias("wide")
            ),
        ),
    )
    keys = members.select("id", "size", F.explode(both).alias("key")).select("id", "size", "key.*")
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keys.join(sizes, "bucket").select("id", "size", "bucket", "wide", "n")


def pivot_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each member of ``shared`` (see ``buckets``) with the pivots of its buckets.

    A bucket has two pivots: the member with the most company over all its buckets, as
    an original has more than its edited copies, and the one with the least, so that a
    text at the edge of a group meets all that share its bucket. Rows are in proportion
    to the members, whatever the size of a bucket.
    """
    company = shared.groupBy("id").agg(F.sum("n").alias("company"))
    shared = shared.select("id", "bucket").join(company, "id")
    ends = shared.groupBy("bucket").agg(
        F.max(F.struct("company", (-F.col("id")).alias("id"))).alias("most"), F.min(F.struct("company", "id")).alias("least")
    )
    ends = ends.select("bucket", F.array(-F.col("most.id"), F.col("least.id")).alias("pivots"))
    pairs = shared.join(ends, "bucket").select("id", F.explode("pivots").alias("pivot")).filter("id != pivot")
    return pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def texts_of(documents: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, text) of ``copies`` (id, copy), each text once."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.md5(text).alias("copy"), text.alias("text"))
    # the copies grow with the input, so the same shuffle serves every size
    rows = rows.join(copies.select("copy", "id").hint("merge"), "copy")
    return rows.groupBy("id").agg(F.first("text").alias("text"))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles) of (id, text): the hashes of each text's shingles, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [np.unique(shingles(text.as_py())) for text in batch.column("text")]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            columns = [batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, shingles array<bigint>")


def _shared_at_least(similarity: float, total: Column) -> Column:
    """Shingles that two texts with ``total`` in all must share."""
    return F.ceil(total * (similarity / (1 + similarity)) - 1e-9)


def rarest(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, group, size, token, place) of ``sets`` (id, group, shingles): so many of the rarest
    shingles of each that another set of the similarity must hold one of them. Those that
    no other set has are left out; ``place`` counts them."""
    tokens = sets.select("id", F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    order = F.sort_array(F.collect_list(F.struct("n", "token"))).alias("order")
    ordered = tokens.join(counts, "token").groupBy("id").agg(order)
    size = F.size("order")
    first = F.slice("order", 1, size - F.ceil(size * similarity - 1e-9).cast("int") + 1)
    prefixes = ordered.select("id", size.alias("size"), F.posexplode(first).alias("place", "token"))
    prefixes = prefixes.filter("token.n > 1").select("id", "size", F.col("token.token").alias("token"), "place")
    return prefixes.join(sets.select("id", "group"), "id")


def prefix_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): all pairs of different groups among ``sets`` (id, group, shingles) that can have
    the similarity: they share one of their rarest shingles, and neither their sizes nor
    what stands behind that shingle rules it out.

    Of each shingle's members those of its largest group meet only the others.
    """
    rows = materialize(rarest(sets, similarity))
    per_group = rows.groupBy("token", "group").agg(F.count(F.lit(1)).alias("n"))
    largest = per_group.groupBy("token").agg(
        F.max(F.struct("n", "group"))["group"].alias("largest"), F.count(F.lit(1)).alias("groups")
    )
    rows = rows.join(largest.filter("groups > 1").select("token", "largest"), "token")
    own = ["token", "id", "group", "size", "place"]
    a = rows.filter("group != largest").select(*own).toDF("token", "a", "a_group", "a_size", "a_place")
    b = rows.select(*own, (F.col("group") == F.col("largest")).alias("of_largest"))
    b = b.toDF("token", "b", "b_group", "b_size", "b_place", "of_largest")
    left = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    needed = _shared_at_least(similarity, F.col("a_size") + F.col("b_size"))
    sizes = F.least("a_size", "b_size") >= F.ceil(F.greatest("a_size", "b_size") * similarity - 1e-9)
    near = (a["token"] == b["token"]) & (F.col("a_group") != F.col("b_group")) & (F.col("of_largest") | (F.col("a") < F.col("b")))
    met = a.join(b, near & sizes & (left >= needed))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_sets(shared: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, group, shingles) of members of buckets that hold more than one group.

    Texts of a wide bucket share a single one as well, and both members of a pair that is
    alone in its bucket are pivots.
    """
    rows = shared.filter("not wide and n > 2").select("id", "bucket").join(groups, "id", "left")
    rows = materialize(rows.select("id", "bucket", F.coalesce("group", "id").alias("group")))
    still = rows.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high")
    members = rows.join(still.select("bucket"), "bucket", "left_semi").select("id", "group").distinct()
    return sets.join(members, "id")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets have at least that exact similarity."""
    a, b = sets.select("id", "shingles").toDF("a", "x"), sets.select("id", "shingles").toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    near = both / (F.size("x") + F.size("y") - both) >= similarity
    return pairs.join(a, "a").join(b, "b").filter(near).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, group): the smallest id that each linked id can reach.

    Every round takes the smallest label among the neighbours and then that label's own
    label, so the rounds grow with the logarithm of the longest chain. Each round is
    written to the shared folder; only a count reaches the driver.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("group")))
    while True:
        near = edges.join(labels.toDF("b", "other"), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        nearer = labels.join(near, "id").select("id", "group", F.least("group", "other").alias("via"))
        jump = labels.toDF("via", "end")
        moved = materialize(nearer.join(jump, "via").select("id", "group", F.least("via", "end").alias("next")))
        changed = moved.filter("next != group").limit(1).count()
        labels = moved.select("id", F.col("next").alias("group"))
        if not changed:
            return labels


def linked(shared: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, group) of the members of buckets that have a link; see the module.

    The second round finds every link between members of a bucket that the first left in
    different groups, so no third can add one.
    """
    pairs = materialize(pivot_pairs(shared))
    groups = components(materialize(verified(pairs, sets, similarity)))
    rest = materialize(prefix_pairs(materialize(open_sets(shared, groups, sets)), similarity))
    links = verified(rest.join(pairs, ["a", "b"], "left_anti"), sets, similarity)
    for end in ("a", "b"):
        links = links.join(groups.toDF(end, "group"), end, "left").withColumn(end, F.coalesce("group", end)).select("a", "b")
    merged = components(materialize(links))
    met = groups.unionByName(merged.select("id", F.col("id").alias("group"))).groupBy("id").agg(F.min("group").alias("group"))
    return met.join(merged.toDF("group", "least"), "group", "left").select("id", F.coalesce("least", "group").alias("group"))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``documents``: id, group, keep, copy (a hash of the text).

    ``id`` is doc_id (see ``row_id`` for rows without one) and ``group`` the smallest
    id of its group. Equal texts are one text from the start, NULL counts as ''. Texts
    without words are near only to equal texts; fewer than five words are one shingle.
    Rows of one id with different texts are different documents. ``keep`` holds for one
    text and id of each group: the smallest id's, of several texts that with the least
    hash; rows equal in both are all marked. Very long texts cost their shingles. Other
    columns are ignored; an empty table gives no rows.
    """
    marked = materialize(_mark(documents))
    copies = marked.groupBy("copy").agg(F.min("id").alias("first"), F.min("size").alias("size"), F.min("bands").alias("bands"))
    # the numbers hold because they are written once
    copies = materialize(copies.withColumn("id", F.monotonically_increasing_id()))
    shared = materialize(buckets(copies.filter(F.size("bands") > 0).select("id", "size", "bands")))
    asked = copies.select("id", "copy").join(shared.select("id").distinct(), "id", "left_semi")
    sets = materialize(shingle_sets(texts_of(documents, asked)))
    groups = linked(shared, sets, similarity)
    named = copies.select("copy", "first", "id").join(groups, "id", "left")
    named = materialize(named.select("copy", "first", F.coalesce("group", "id").alias("number")))
    kept = named.groupBy("number").agg(F.min(F.struct("first", "copy")).alias("kept"))
    named = named.join(kept, "number").select(
        "copy", F.col("kept.first").alias("group"), (F.col("copy") == F.col("kept.copy")).alias("kept")
    )
    out = marked.select("id", "copy").join(named, "copy")
    return out.select("id", "group", (F.col("kept") & (F.col("id") == F.col("group"))).alias("keep"), "copy")


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` without all but one document of each group, columns unchanged.

    Of rows equal in id and text the one whose columns have the least hash stays.
    """
    kept = near_duplicates(documents, similarity).filter("keep").select("id", "copy").distinct()
    row = F.struct(*(documents[c] for c in documents.columns))
    rows = documents.select(
        row_id(documents["doc_id"], documents["text"]).alias("id"),
        F.md5(F.coalesce(documents["text"], F.lit(""))).alias("copy"),
        row.alias("row"),
        F.xxhash64(F.to_json(row)).alias("order"),
    )
    rows = rows.join(kept, ["id", "copy"], "left_semi").groupBy("id", "copy").agg(F.min_by("row", "order").alias("row"))
    return rows.select(*(F.col("row")[c].alias(c) for c in documents.columns))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.col("group").alias("class_id"), "keep")
