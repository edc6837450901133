"""Sorted rows in Python workers: groups of equal keys, and digests of ordered parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a row's keys, which are not NULL, differ from those of the row before."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for key in keys:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal ``keys``, over the ends of batches too."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [0, *_starts(batch, keys).tolist(), batch.num_rows]
        first = batch.slice(0, 1)
        if held and any(held[0].column(k)[0] != first.column(k)[0] for k in keys):
            yield _one(held)
            held = []
        for i in range(len(ends) - 1):
            if i:
                yield _one(held)
                held = []
            held.append(batch.slice(ends[i], ends[i + 1] - ends[i]))
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def digests(parts: DataFrame, key: str, place: str, part: str, separator: str) -> DataFrame:
    """(key, sha256): of each key's parts in the order of ``place``, joined by ``separator``.

    A digest reads its parts one after the other, so those of a key pass one task; it
    holds a batch of them at a time, however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, digest = None, hashlib.sha256()
        for batch in batches:
            keys, out, values = batch.column(0).to_pylist(), [], batch.column(1).to_pylist()
            for k, text in zip(keys, values, strict=True):
                if k != open_key:
                    if open_key is not None:
                        out.append((open_key, digest.hexdigest()))
                    open_key, digest = k, hashlib.sha256()
                else:
                    digest.update(separator.encode())
                digest.update(text.encode("utf-8", "surrogatepass"))
            yield _rows(out)
        if open_key is not None:
            yield _rows([(open_key, digest.hexdigest())])

    def _rows(out: list) -> pa.RecordBatch:
        columns = [pa.array([k for k, _ in out], kind), pa.array([v for _, v in out], pa.string())]
        return pa.RecordBatch.from_arrays(columns, [key, "sha256"])

    type_name = parts.schema[key].dataType.simpleString()
    kind = {"bigint": pa.int64(), "string": pa.string()}[type_name]
    rows = parts.repartition(key).sortWithinPartitions(key, place).select(key, part)
    return rows.mapInArrow(run, f"`{key}` {type_name}, sha256 string")
