"""Removal of passages that occur more than once, by prefix-partitioned suffix groups.

Suffixes begin at words and are cut at ``WINDOW`` words, the depth from which a node
of the suffix tree counts as a repeat; a node of that depth with two leaves is a
window that starts in two places. Suffixes are partitioned by a prefix they all share,
the anchor: the run of ``ANCHOR`` words in the window whose hash is least. Consecutive
suffixes mostly share an anchor and travel together, and an anchor that occurs once
needs no group at all. In each group the suffixes are sorted by what identifies their
node, and nodes with several leaves give the words to remove.

Prefixes have variable lengths: the groups of anchors are counted, and where one would
not fit into memory its suffixes are partitioned by all their words instead, and travel
one by one. Sorted, equal ones are neighbours, and no more than one is held at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.packing import chunks
from textbench.llm.words import IS_SPACE, known_id, mix, spans, window_hashes, with_missing_ids, word_hashes
from textbench.session import materialize

WINDOW = 35
ANCHOR = 12
#: UTF-8 bytes of texts that a worker looks at together.
CHUNK_BYTES = 300_000
#: Suffixes of a group that one worker holds.
GROUP_SUFFIXES = 500_000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in chunks of about CHUNK_BYTES of text, one row at least."""
    for batch in batches:
        for a, b in chunks(pc.binary_length(batch.column("text")).to_pylist(), CHUNK_BYTES):
            yield batch.slice(a, b - a)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return part.column("text").cast(pa.binary()).to_pylist()


def _split(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text's words begin (with the end)."""
    joined = np.frombuffer(b"\n".join(data), dtype=np.uint8)
    starts, ends = spans(~IS_SPACE[joined])
    at = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])))
    return word_hashes(joined, starts, ends), np.searchsorted(starts, at)


class Suffixes:
    """The windows of some texts: text number, start, hash, and hash of the anchor."""

    def __init__(self, texts: list[bytes], window: int, anchor: int):
        words, first = _split(texts)
        self.first = first
        if len(words) < window:
            empty = np.zeros(0, dtype=np.int64)
            self.text, self.start, self.place, self.window, self.anchor = (empty,) * 5
            return
        whole = window_hashes(words, window)
        grams = window_hashes(words, anchor)
        starts = np.arange(len(whole))
        text = np.searchsorted(first, starts, side="right") - 1
        inside = starts + window <= first[text + 1]
        best = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1).argmin(axis=1)
        place = starts + best
        self.text, self.place = text[inside], place[inside]
        self.start = starts[inside] - first[self.text]
        self.window, self.anchor = whole[inside].view(np.int64), grams[self.place].view(np.int64)


def _apart(anchor: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A group of its own for an anchor of one text, to spread what needs no counting."""
    return mix(anchor.view(np.uint64) ^ mix(key.view(np.uint64))).view(np.int64)


def _anchors(window: int, anchor: int):
    """Per chunk: (group, key, n) for each anchor of each text.

    An anchor seen twice in the chunk is known to repeat: it is announced once, and
    the texts that have it get rows of their own, so a passage that a third of all
    texts share adds one row per chunk to its group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            key = part.column("key").to_numpy()
            s = Suffixes(_texts(part), window, anchor)
            if not len(s.text):
                continue
            places, at = np.unique(s.place, return_index=True)
            values, inverse, counts = np.unique(s.anchor[at], return_inverse=True, return_counts=True)
            keys = key[s.text[at]]
            twice = counts[inverse] > 1
            known = np.unique(_apart(s.anchor[at][twice], keys[twice]), return_index=True)
            told = values[counts > 1]
            groups = [s.anchor[at][~twice], known[0], told]
            owners = [keys[~twice], keys[twice][known[1]], np.zeros(len(told), dtype=np.int64)]
            ns = [np.repeat(np.int32(n), len(g)) for n, g in zip((1, 2, 3), groups, strict=True)]
            columns = (np.concatenate(groups), np.concatenate(owners), np.concatenate(ns))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["group", "key", "n"])

    return run


def _runs(window: int, anchor: int):
    """Per chunk: the windows at anchors that repeat, as (anchor, key, start, end, windows).

    Rows with windows ask whether those repeat, or (start -1) announce that they do;
    rows without tell a range of words that is known to repeat within the chunk.
    """

    kinds = pa.schema(
        [("anchor", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("windows", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            key = part.column("key").to_numpy()
            s = Suffixes(_texts(part), window, anchor)
            repeated = np.zeros(len(s.text), dtype=bool)
            edges = np.searchsorted(s.text, np.arange(len(part) + 1))
            for i, groups in enumerate(part.column("groups")):
                own = s.anchor[edges[i] : edges[i + 1]]
                wanted = groups.values.to_numpy()
                apart = _apart(own, np.repeat(key[i], len(own)))
                repeated[edges[i] : edges[i + 1]] = np.isin(own, wanted) | np.isin(apart, wanted)
            text, start, place = s.text[repeated], s.start[repeated], s.place[repeated]
            hashes, anchors = s.window[repeated], s.anchor[repeated]
            if not len(text):
                continue
            _, index, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            twice = counts[inverse] > 1
            rows = []
            once, known = np.flatnonzero(~twice), np.flatnonzero(twice)
            for lo, hi in _consecutive(text[once], start[once], place[once]):
                at = once[lo]
                rows.append((anchors[at], key[text[at]], start[at], -1, hashes[once[lo:hi]]))
            for lo, hi in _consecutive(text[known], start[known]):
                at, last = known[lo], known[hi - 1]
                own = _apart(anchors[at : at + 1], key[text[at : at + 1]])[0]
                rows.append((own, key[text[at]], start[at], start[last] + window, None))
            told = index[counts > 1]
            told = told[np.argsort(anchors[told], kind="stable")]
            for lo, hi in _consecutive(anchors[told]):
                rows.append((anchors[told[lo]], 0, -1, -1, hashes[told[lo:hi]]))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return run


def _consecutive(same: np.ndarray, counting: np.ndarray | None = None, also: np.ndarray | None = None) -> zip:
    """Ranges of neighbours with equal ``same`` (and ``also``) whose ``counting`` grows by one."""
    if not len(same):
        return zip((), (), strict=True)
    new = same[1:] != same[:-1]
    if counting is not None:
        new |= counting[1:] != counting[:-1] + 1
    if also is not None:
        new |= also[1:] != also[:-1]
    edges = np.concatenate(([0], np.flatnonzero(new) + 1, [len(same)]))
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _repeats(window: int):
    """Over rows sorted by anchor: ranges (key, start, end) of words that repeat."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        told = rows[rows["windows"].isna()]
        out = [told[["key", "start", "end"]]]
        rows = rows[rows["windows"].notna()]
        if len(rows):
            sizes = rows["windows"].str.len().to_numpy()
            hashes = np.concatenate(rows["windows"].to_list())
            owner = np.repeat(np.arange(len(rows)), sizes)
            inside = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            start = rows["start"].to_numpy()[owner]
            n = np.where(start < 0, 2, 1)
            node = np.stack((rows["anchor"].to_numpy()[owner], hashes), axis=1)
            order = np.lexsort((node[:, 1], node[:, 0]))
            new = np.concatenate(([True], (node[order][1:] != node[order][:-1]).any(axis=1)))
            number = np.cumsum(new) - 1
            leaves = np.bincount(number, weights=n[order])
            repeated = np.zeros(len(hashes), dtype=bool)
            repeated[order] = leaves[number] > 1
            repeated &= start >= 0
            owner, at = owner[repeated], (start + inside)[repeated]
            keys = rows["key"].to_numpy()
            found = [(keys[owner[lo]], at[lo], at[hi - 1] + window) for lo, hi in _consecutive(owner, at)]
            out.append(pd.DataFrame(found, columns=["key", "start", "end"]))
        return pd.concat(out).astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["anchor"].iloc[-1]
            if open_group and open_group[0]["anchor"].iloc[0] == batch["anchor"].iloc[0] == last:
                open_group.append(batch)
                continue
            ends = batch["anchor"] == last
            yield answer(pd.concat([*open_group, batch[~ends]]))
            open_group = [batch[ends]]
        if open_group:
            yield answer(pd.concat(open_group))

    return run


def _neighbours(window: int):
    """Over rows (anchor, suffix, key, start) sorted by the first two: ranges (key, start,
    end) of suffixes that have an equal neighbour. A start of -1 says that there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), dtype=np.int64)  # the last row, and whether an equal one was before it
        before = False
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "suffix", "key", "start")], axis=1)
            rows = np.concatenate((held, new))
            equal = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
            told = rows[:, 3] < 0  # equal ones follow those, as -1 is the least start
            repeated = np.concatenate(([before], equal)) | np.append(equal, False) | told
            yield ranges(rows[:-1][repeated[:-1]])
            held, before = rows[-1:], bool(repeated[-1])
        if before:
            yield ranges(held)

    def ranges(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[rows[:, 3] >= 0]
        columns = [pa.array(rows[:, 2]), pa.array(rows[:, 3], pa.int32()), pa.array(rows[:, 3] + window, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["key", "start", "end"])

    return run


def repeated_ranges(runs: DataFrame, window: int) -> DataFrame:
    """(key, start, end) of the words that repeat, from ``runs`` (see ``_runs``), materialized."""
    sizes = runs.groupBy("anchor").agg(F.sum(F.size("windows")).alias("n"))
    large = sizes.filter(F.col("n") > GROUP_SUFFIXES).select("anchor")
    small = runs.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    ranges = small.mapInPandas(_repeats(window), "key bigint, start int, end int")
    asked = runs.filter("windows is not null").join(large, "anchor").select("anchor", "key", "start", F.posexplode("windows").alias("at", "suffix"))
    asked = asked.withColumn("start", F.when(F.col("start") < 0, -1).otherwise(F.col("start") + F.col("at")))
    alone = asked.repartition("anchor", "suffix").sortWithinPartitions("anchor", "suffix", "start")
    found = alone.select("anchor", "suffix", "key", "start").mapInArrow(_neighbours(window), "key bigint, start int, end int")
    known = runs.filter("windows is null").join(large, "anchor").select("key", "start", "end")
    return ranges.unionByName(found).unionByName(known)


def _kept(part: pa.RecordBatch) -> tuple[list[int], list[int], list[bytes]]:
    """Of each text: its words, those removed, and what is kept."""
    n_words, n_removed, kept = [], [], []
    for text, starts, ends in zip(_texts(part), part.column("starts"), part.column("ends"), strict=True):
        words = left = text.split()
        if starts.is_valid:
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(gone, starts.values.to_numpy(), 1)
            np.add.at(gone, ends.values.to_numpy(), -1)
            left = list(compress(words, (np.cumsum(gone[:-1]) == 0).tolist()))
        n_words.append(len(words))
        n_removed.append(len(words) - len(left))
        kept.append(b" ".join(left))
    return n_words, n_removed, kept


def _without_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        n_words, n_removed, kept = _kept(part)
        columns = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        n_words, n_removed, kept = _kept(part)
        digests = [hashlib.sha256(text).hexdigest() for text in kept]
        columns = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _marked(documents: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, text, starts, ends): each row's text with its ranges to remove."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(known_id(F.col("doc_id")), F.xxhash64(text, F.length(text)).alias("key"), text.alias("text"))
    found = rows.select("key", "text").mapInArrow(_anchors(window, anchor), "group bigint, key bigint, n int")
    total = F.sum("n").over(Window.partitionBy("group"))
    found = found.withColumn("total", total).filter("total > 1 and n < 3")
    groups = found.groupBy("key").agg(F.collect_set("group").alias("groups"))
    asked = rows.join(groups, "key").select("doc_id", "key", "text", "groups")
    runs = asked.mapInArrow(
        _runs(window, anchor), "anchor bigint, key bigint, start int, end int, windows array<bigint>"
    )
    ranges = repeated_ranges(materialize(runs), window).distinct().groupBy("key")
    ranges = ranges.agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return rows.join(ranges, "key", "left").select("doc_id", "text", "starts", "ends")


def remove_repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the kept words, joined by blanks.

    Removes each word covered by a window of ``window`` words that starts anywhere
    else too, in the same document or another, its equal copies included. Windows are
    judged on the input. NULL and empty texts have no words; texts shorter than a
    window keep all; repeated rows are copies of each other and lose all windows; very
    long texts are one chunk of their own. Other columns are ignored; an empty table gives no rows.
    """
    rows = _marked(documents, window, anchor)
    return with_missing_ids(rows.mapInArrow(_without_ranges, "doc_id bigint, n_words bigint, n_removed bigint, kept string"))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    rows = _marked(spark.read.parquet(f"{sf_dir}/documents.parquet"), WINDOW, ANCHOR)
    return with_missing_ids(rows.mapInArrow(_digests, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"))


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
win AS (
  SELECT r, s, hash(array_to_string(w[s : s + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - {WINDOW} + 1)) AS s FROM d WHERE len(w) >= {WINDOW})
),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(generate_series(s, s + {WINDOW - 1})) AS p FROM win JOIN twice USING (h))
),
word AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM word ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
