"""Words of texts, as column expressions and as numpy arrays."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACES = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and all other letters unchanged; NULL gives ''."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.length(whole) == F.octet_length(whole)
    return F.when(plain, F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """Lower-case words: runs of characters other than ASCII non-alphanumerics."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS, -1), "")


def spaced_words(text: Column) -> Column:
    """Words as they are written, cut at ASCII white space; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def per_process(name: str, make: Callable[[], object]):
    """What ``make`` returns, made once in each worker process.

    Functions travel to the workers with copies of the modules they belong to, so what
    all tasks of a process share is kept in a module of its own.
    """
    kept = sys.modules.setdefault("textbench_worker", ModuleType("textbench_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: the optimizer would otherwise
    put its expression inside the lambdas that use it, once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def document_key() -> list[Column]:
    """Columns that tell rows apart wherever their results can differ: the id and a
    hash of the text. Equal rows share a key and a result."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")]


#: Stands for a missing id where rows are in pandas, which would make all ids of the batch inexact.
NO_ID = -(2**63)


def known_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(NO_ID)).alias("doc_id")


def with_missing_ids(df: DataFrame) -> DataFrame:
    """``df`` with NULL for the ids that ``known_id`` filled in."""
    return df.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def table(bytes_in: bytes) -> np.ndarray:
    """A lookup over byte values: True for those in ``bytes_in``."""
    found = np.zeros(256, dtype=bool)
    found[np.frombuffer(bytes_in, dtype=np.uint8)] = True
    return found


IS_SPACE = table(b" \t\n\x0b\x0c\r")
_word = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
IS_WORD = table(_word)
TO_LOWER = np.arange(256, dtype=np.uint8)  # A-Z to a-z
TO_LOWER[0x41:0x5B] += 32


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0])).astype(np.int8)))
    return edges[::2], edges[1::2]


_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its bytes' values times powers of the place."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    inside = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    index = np.arange(int(lengths.sum())) - np.repeat(inside, lengths)
    chars = data[index + np.repeat(starts, lengths)]
    weighted = _BYTE_VALUE[chars] * powers(_BASE, int(lengths.max()))[index]
    return mix(np.add.reduceat(weighted, inside) + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive words, by their hashes.

    Fewer words than ``width``, but some, count as one run of all of them.
    """
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + words[k : n - width + 1 + k]
    return mix(out + np.uint64(width))
