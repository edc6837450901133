"""Packing documents into token sequences by harmonic classes.

A length r belongs to the reciprocal-capacity class k = floor(capacity / r): k pieces
of a class fill one sequence. A document is cut so that every piece nearly fills its
share of a sequence of its class. Workers number the pieces of each class on their own;
counts per worker and class then give each piece its sequence, and no task needs more
than one sequence. What a class has left over after its full sequences (fewer than k
pieces) is packed together, longest first.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.words import known_id, per_process, with_missing_ids
from textbench.session import materialize

CAPACITY = 2048
#: Tokens of a sequence's share that a piece may leave empty before it is cut.
SLACK = 8
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces of words whose ids a worker keeps, more only cost time, and bytes of texts that are encoded together.
CACHED_PIECES = 500_000
CHUNK_CHARS = 4_000_000

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "class int, worker int, place bigint"
)
PLACED = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def cut(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces of ``n`` tokens: whole sequences first, then shares
    1/k of a sequence, each the largest that fits, until the rest nearly fills its own."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity // k - rest <= slack:
            pieces.append((rest, k))
            break
        pieces.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return pieces


class Runs:
    """Numbered runs of ids, one after the other."""

    def __init__(self, ids: list[int], count: list[int]):
        self.ids, self.count = np.array(ids, dtype="<u4"), np.array(count, dtype=np.int32)
        self.first = np.cumsum(self.count, dtype=np.int32) - self.count

    def add(self, ids: np.ndarray, count) -> None:
        count = np.asarray(count, dtype=np.int32)
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(count, dtype=np.int32) - count))
        self.count = np.concatenate((self.count, count))
        self.ids = np.concatenate((self.ids, ids))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of those runs, and where each run ends among them."""
        count = self.count[numbers]
        upto = np.cumsum(count, dtype=np.int32)  # a chunk of text is far below 2^31 ids
        at = np.repeat(self.first[numbers] - (upto - count), count)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], upto


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space and case, piece by piece.

    Words between ASCII white space don't depend on each other, and plain words consist
    of pieces that don't: runs of letters, single digits, runs of punctuation. Arrow cuts
    texts into pieces and numbers the different ones; only pieces not seen yet are encoded,
    many together, and the ids of all are gathered by number. Words that are not plain
    are pieces as they are. Equals the tokenizer's ``encode(text, add_special_tokens=False)``.
    """

    # plain words hold no apostrophe, whose contractions the tokenizer keeps together, and
    # no letters whose lower case depends on others
    PLAIN = r"A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~"
    # pieces other than runs of letters
    BREAKS = r"([0-9]|[!-/:-@\[-`{-~]+)"
    #: Stands before a word that is a piece as it is; plain words cannot hold it.
    WHOLE = "\x00"

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """No piece known, but number 0, the end of a document, and the empty one."""
        self.numbers: dict[str, int] = {"": 1}
        self.runs = Runs([END_ID], [1, 0])

    def release(self) -> None:
        """Give back the memory of what was learned. Workers outlive tasks and the stages
        that need it."""
        self._forget()
        pa.default_memory_pool().release_unused()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, pieces: list[str]) -> None:
        """Number ``pieces``, none of which is known. Plain ones end with a token that says
        so, and are encoded many at once."""
        whole = [p for p in pieces if p[0] == self.WHOLE]
        plain = [p for p in pieces if p[0] != self.WHOLE]
        found, counts = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(plain), 512):
            some = plain[i : i + 512]
            ids = self._ids(" ".join(some))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                each = [self._ids(w) for w in some]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            found.append(ids)
            counts.append(np.diff(ends, prepend=0))
        for word in whole:
            found.append(self._ids(word[1:]))
            counts.append(np.array([len(found[-1])]))
        first = len(self.runs.count)
        self.numbers.update(zip([*plain, *whole], range(first, first + len(pieces)), strict=True))
        self.runs.add(np.concatenate(found), np.concatenate(counts))

    def _spaced(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of texts without words that are not plain."""
        return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), self.BREAKS, r" \1 "))

    def _is_plain(self, texts: pa.Array, also: str = "") -> pa.Array:
        return pc.and_(pc.match_substring_regex(texts, f"^[{self.PLAIN}{also}]*$"), pc.invert(pc.match_substring(texts, "<|")))

    def _pieces(self, texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and where each text ends among them."""
        if pc.all(self._is_plain(texts, r"\x09-\x0D\x20")).as_py():
            lists = self._spaced(texts)
            return lists.flatten(), np.diff(lists.offsets.to_numpy()).cumsum()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten()
        plain = self._is_plain(words)
        whole = pc.binary_join_element_wise(self.WHOLE, words, "")
        lists = pc.ascii_split_whitespace(
            pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(words), self.BREAKS, r" \1 "), whole)
        )
        upto = np.concatenate(([0], np.diff(lists.offsets.to_numpy()).cumsum()))
        return lists.flatten(), upto[np.diff(split.offsets.to_numpy()).cumsum()]

    def encoded(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with its end id, one after the other, and where each ends."""
        if len(self.numbers) > CACHED_PIECES:
            self._forget()
        pieces, ends = self._pieces(texts)
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_pylist()
        self._learn([p for p in different if p not in self.numbers])
        numbers = np.fromiter(map(self.numbers.__getitem__, different), np.int32, len(different))[coded.indices.to_numpy()]
        ids, upto = self.runs.take(np.insert(numbers, ends, 0))
        return ids, upto[ends + np.arange(len(ends))].astype(np.int64)

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        ids, ends = self.encoded(pa.array(texts, pa.string()))
        for first, end in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            yield ids[first : end - 1].tobytes()


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``most`` in all, one item at least."""
    first = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def word_ids(name: str) -> WordIds:
    """The tokenizer of a file, one per worker process."""
    return per_process(f"word_ids:{name}", lambda: WordIds(name))


def cuts(lengths: list[int], capacity: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, length, class) of the pieces of documents of those lengths."""
    found = [cut(n, capacity, slack) for n in lengths]
    owner = np.repeat(np.arange(len(found)), [len(p) for p in found])
    flat = np.array([piece for p in found for piece in p], dtype=np.int64).reshape(-1, 2)
    return owner, flat[:, 0], flat[:, 1]


def pieces(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """The pieces of all documents with their class, and their place among the pieces
    of the class that the same task made."""
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "worker", "place"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        worker, placed = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            for a, b in chunks(sizes, CHUNK_CHARS):
                part = batch.slice(a, b - a)
                ids, ends = words.encoded(part.column("text"))
                tokens = np.diff(ends, prepend=0)
                owner, length, kind = cuts(tokens.tolist(), capacity, slack)
                upto = np.cumsum(length)  # the pieces follow each other as the ids do
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (end - n) : 4 * end]) for n, end in zip(length.tolist(), upto.tolist(), strict=True)]
                place = []
                for k in kind.tolist():
                    place.append(placed[k])
                    placed[k] += 1
                start = upto - length - (ends - tokens)[owner]
                columns = [part.column("doc_id").to_numpy()[owner], start, length, crc, tokens[owner], kind, np.full(len(owner), worker), place]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        words.release()

    rows = documents.select(known_id(F.col("doc_id")), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(make, PIECES)


def longest_first(rest: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Each piece goes into the first open sequence with room, longest piece first."""
    rest = rest.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
    used = np.zeros(len(rest), dtype=np.int64)
    at, offsets = [], []
    for length in rest["length"]:
        i = int(np.argmax(used + length <= capacity))
        at.append(i)
        offsets.append(int(used[i]))
        used[i] += length
    return rest.assign(sequence_id=[-1 - i for i in at], offset=offsets)


def pack(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A NULL or empty text is its end id alone; equal rows are packed each on their own;
    an empty table gives no rows; other columns are ignored. A long text is cut into
    whole sequences. Sequences of classes have ids from 0 up, those of left-over
    pieces from -1 down; each is filled without gaps from 0.

    The one task that packs left-over pieces gets fewer than k of each class k, which
    the capacity bounds however many documents there are.
    """
    made = materialize(pieces(documents, tokenizer, capacity, slack))
    by_class = Window.partitionBy("class")
    counts = made.groupBy("class", "worker").agg(F.count(F.lit(1)).alias("n"))
    before = by_class.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "class",
        "worker",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(by_class).alias("total"),
    )
    numbered = made.join(counts, ["class", "worker"]).withColumn("place", F.col("place") + F.col("before"))
    sequence = F.floor(F.col("place") / F.col("class"))
    numbered = numbered.withColumn("sequence", sequence).withColumn(
        "full", F.col("sequence") < F.floor(F.col("total") / F.col("class"))
    )
    inside = Window.partitionBy("class", "sequence").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = numbered.filter("full").select(
        *own,
        (F.col("sequence") * (capacity + 1) + F.col("class")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"),
    )
    rest = numbered.filter("not full").select(*own, F.lit(0).alias("one"))
    rest = rest.groupBy("one").applyInPandas(lambda x: longest_first(x, capacity).drop(columns="one"), PLACED)
    return with_missing_ids(full.unionByName(rest))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
