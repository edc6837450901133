"""Links and groups of near-equal vectors by collision-counting projections.

Vectors are projected on many random lines. In each table the vectors that stand on the
same side of the table's few random planes are sorted along its line, and a vector
collides with those in a window centred on its own place. The collisions of a pair are
counted over all tables; only pairs with enough of them are verified by their cosine in
double precision. For a pair at the threshold itself the chance of a collision follows
from the normal distribution, so the number of tables is the least at which such a pair
misses the count with a probability of ``MISSED`` at most; closer pairs miss it less.

Projections are sums of whole numbers, which floating point adds exactly in any order:
every task that meets a pair counts the same collisions. So the first table in which a
pair collides is the one that counts it, no pair is ever sent anywhere, and a task
returns as many rows as it has vectors: how many others each is linked to, and one link
for each that ties it to its group. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.near_dedup import components
from textbench.llm.streams import groups
from textbench.session import materialize

SIMILARITY = 0.95
#: Collisions that a pair needs to be verified.
COLLISIONS = 2
#: Probability that a pair just at the threshold has fewer.
MISSED = 1e-6
#: Share of such pairs that a window holds along its line.
WITHIN = 0.9
#: Vectors that stand on one side of all planes of a table, about.
SIDE = 256
#: Vectors of one side that meet in one task, and pairs whose collisions are counted at once.
BLOCK = 1000
PAIRS = 20_000
#: Groups whose links are returned together.
GROUPS = 200
#: Columns that vectors that meet in a task share: length, table, side of its planes, blocks.
MEETING = ["d", "table", "side", "x", "y"]
_SEED = 20240612
#: Whole numbers to a unit of a line's normal variable and of a component, and to one step of a place.
_LINE, _UNIT, _GRID = 2.0**10, 2.0**20, 2.0**8


def chance(planes: int, similarity: float = SIMILARITY) -> float:
    """Probability that a pair of that cosine collides in a table."""
    return (1 - math.acos(similarity) / math.pi) ** planes * WITHIN


def tables_needed(p: float, collisions: int = COLLISIONS, missed: float = MISSED) -> int:
    """The fewest tables in which a pair that collides with probability ``p`` in each has
    fewer than ``collisions`` with a probability of ``missed`` at most."""
    tables = collisions
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(collisions)) > missed:
        tables += 1
    return tables


class Projections:
    """The lines and planes of all tables, for vectors of any length."""

    def __init__(self, vectors: int, similarity: float = SIMILARITY):
        self.planes = max(0, math.ceil(math.log2(max(vectors, 1) / SIDE)))
        self.tables = tables_needed(chance(self.planes, similarity))
        # nine tenths of a normal variable lie within 1.645 of its deviations
        self.width = math.ceil(1.6448536 * math.sqrt(2 - 2 * similarity) * _LINE * _UNIT / _GRID) + 1
        self.drawn: dict[int, np.ndarray] = {}

    def _random(self, d: int) -> np.ndarray:
        if d not in self.drawn:
            r = np.random.default_rng((_SEED, d))
            self.drawn[d] = np.rint(r.standard_normal((d, self.tables * (1 + self.planes))) * _LINE)
        return self.drawn[d]

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(side, place) of unit vectors in each table."""
        at = (np.rint(units * _UNIT) @ self._random(units.shape[1])).reshape(len(units), self.tables, -1)
        sides = (at[:, :, 1:] >= 0) @ (np.int64(1) << np.arange(self.planes, dtype=np.int64))
        return sides.astype(np.int32 if self.planes < 31 else np.int64), np.floor(at[:, :, 0] / _GRID).astype(np.int32)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows in length one; scaled by their largest component first, so that none overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def windows(places: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), some at a time, whose places differ by ``width`` at most."""
    order = np.argsort(places, kind="stable")
    line = places[order]
    n = np.searchsorted(line, line + width, side="right") - np.arange(len(line)) - 1
    for first, end in _parts(n, PAIRS):
        i = np.repeat(np.arange(first, end), n[first:end])
        starts = np.cumsum(n[first:end]) - n[first:end]
        j = i + 1 + np.arange(len(i)) - np.repeat(starts, n[first:end])
        yield order[i], order[j]


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items with about ``most`` in all, one item at least."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, end
        first = end


def linked_pairs(
    vectors: np.ndarray, block: np.ndarray | None, table: int, lines: Projections, similarity: float = SIMILARITY
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that first collide in ``table`` and are linked; given ``block``,
    only those of different blocks."""
    units = unit(vectors)
    sides, places = lines.of(units)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in windows(places[:, table], lines.width):
        if block is not None:
            apart = block[i] != block[j]
            i, j = i[apart], j[apart]
        met = sides[i] == sides[j]
        enough = met.sum(axis=1) >= COLLISIONS
        i, j, met = i[enough], j[enough], met[enough]
        met &= np.abs(places[i] - places[j]) <= lines.width
        own = (met.sum(axis=1) >= COLLISIONS) & (met.argmax(axis=1) == table)
        i, j = i[own], j[own]
        near = np.einsum("ij,ij->i", units[i], units[j]) >= similarity
        found.append((i[near], j[near]))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate([f[0] for f in found] or [none]), np.concatenate([f[1] for f in found] or [none]))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n items the least one that it can reach over the pairs (i, j)."""
    top = np.arange(n)
    while True:
        low = np.minimum(top[i], top[j])
        new = top.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, top[i], low)
        np.minimum.at(new, top[j], low)
        new = new[new]
        if (new == top).all():
            return top
        top = new


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The arrays of a list column."""
    values, ends = column.values.to_numpy(zero_copy_only=False).astype("f8", copy=False), column.offsets.to_numpy()
    return [values[ends[k] : ends[k + 1]] for k in range(len(column))]


def _sides(lines: Projections):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _lists(batch.column("v"))
            sides = np.zeros((len(vectors), lines.tables), dtype=np.int64)
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                sides[rows] = lines.of(unit(np.stack([vectors[k] for k in rows])))[0]
            ends = pa.array(np.arange(len(vectors) + 1) * lines.tables, pa.int32())
            out = [batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(sides.ravel()))]
            yield pa.RecordBatch.from_arrays(out, ["id", "sides"])

    return run


def _links(lines: Projections, similarity: float):
    names = ["id", "other", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        for rows in groups(batches, MEETING):
            table, x, y = (rows.column(c)[0].as_py() for c in ("table", "x", "y"))
            block = None if x == y else rows.column("block").to_numpy()
            i, j = linked_pairs(np.stack(_lists(rows.column("v"))), block, table, lines, similarity)
            if not len(i):
                continue
            weight, n = rows.column("weight").to_numpy(), np.zeros(rows.num_rows, dtype=np.int64)
            np.add.at(n, i, weight[j])
            np.add.at(n, j, weight[i])
            some, ids = np.flatnonzero(n), rows.column("id").to_numpy()
            found.append([ids[some], ids[forest(rows.num_rows, i, j)[some]], n[some]])
            if len(found) == GROUPS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names)

    return run


def links(distinct: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, other, n): of linked ones among ``distinct`` (id, weight, v): how many rows each
    is linked to, added up over the rows of an id, and links that tie the groups together."""
    lines = Projections(distinct.count(), similarity)
    sides = distinct.select("id", "v").mapInArrow(_sides(lines), "id bigint, sides array<bigint>")
    sides = materialize(distinct.select("id", F.size("v").alias("d")).join(sides, "id"))
    places = sides.select("id", "d", F.posexplode("sides").alias("table", "side"))
    met = places.groupBy("d", "table", "side").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    places = places.join(met, ["d", "table", "side"]).withColumn("blocks", blocks)
    places = places.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # a block meets itself and each other one
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    places = places.select("id", "d", "table", "side", "block", other)
    places = places.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    rows = places.join(distinct, "id").repartition(*MEETING).sortWithinPartitions(*MEETING)
    return rows.select(*MEETING, "block", "id", "weight", "v").mapInArrow(
        _links(lines, similarity), "id bigint, other bigint, n bigint"
    )


def _coded(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, code): ``code`` is equal for equal vectors, and NULL for those that link with nothing."""
    v = F.col("v")
    # NaN - NaN and inf - inf are NaN; NULL components make the test NULL, which is not true either
    finite = F.forall(v, lambda x: x - x == 0) & F.exists(v, lambda x: x != 0)
    code = F.sha2(F.array_join(F.transform(v, lambda x: x.cast("string")), ","), 256)
    rows = embeddings.select(embeddings["vec_id"].cast("bigint").alias("vec_id"), embeddings["embedding"].alias("v"))
    return rows.withColumn("code", F.when(F.coalesce(finite, F.lit(False)), code))


def near_vectors(embeddings: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows whose vector has a cosine of ``similarity`` or more
    with this one; ``component_id`` is the least vec_id that links lead to, the row's own
    included, and ``kept`` holds for the row of that id. Every row is a vector of its own,
    also repeated ones, which are linked to each other, and those that share an id. Vectors
    that are NULL, empty, zero or hold NULL, NaN or infinite components link with nothing;
    neither do vectors of different lengths. A row without an id counts as a link, is not
    kept and has a component_id only from others. Other columns are ignored; an empty
    table gives no rows. Long vectors only cost more; a tie with the threshold is a link.
    """
    coded = materialize(_coded(embeddings))
    distinct = coded.filter("code is not null").groupBy("code").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.first("v").alias("v")
    )
    # the numbers hold because they are written once
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()))
    found = materialize(links(distinct.select("id", "weight", "v"), similarity))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups_of = components(found.filter("id != other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = distinct.select("id", "code", "weight", "least").join(counts, "id", "left")
    named = named.join(groups_of.toDF("id", "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))
    named = materialize(named.withColumn("n", F.coalesce("n", F.lit(0)) + F.col("weight") - 1))
    lowest = named.groupBy("group").agg(F.min("least").alias("component"))
    named = named.filter("n > 0").join(lowest, "group").select("code", "n", "component")
    rows = coded.select("vec_id", "code").join(named, "code", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op12_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_USABLE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0"
OP12_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e, {_USABLE} AS usable FROM embeddings),
link AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r != b.r AND a.usable AND b.usable AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {SIMILARITY}
),
reach AS (SELECT r, r AS t FROM v UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.t = link.a),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN least USING (r) LEFT JOIN n USING (r)
"""
