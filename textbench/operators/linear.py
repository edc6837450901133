"""Softmax regression on hashed terms, with one pass over the data per step.

Training holds nothing but the weights: a pass sends them to all tasks, each task adds
up the loss and the gradient of its rows, and the sums are added block by block, so that
the driver gets one gradient, ``features`` times labels numbers, whatever the rows are.
A step by the limited-memory BFGS rule makes the next weights, and what has been learned
of the curvature is carried on from pass to pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.functions.text import tokens

#: Features whose gradients are added in one task.
BLOCK = 1024
#: Length of the first step, steps remembered, least share of the expected gain.
FIRST_STEP, MEMORY, ENOUGH = 10.0, 10, 1e-4


def terms(text: Column, features: int) -> Column:
    """Hashed tokens of a text, repeats included."""
    return F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def document_frequencies(rows: DataFrame, features: int) -> tuple[np.ndarray, int]:
    """In how many rows of ``rows`` (terms) a feature occurs, and the rows: at most ``features`` numbers."""
    found = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counts = np.zeros(features)
    for row in found.collect():
        counts[row["term"]] = row["n"]
    return counts, rows.count()


def inverse_frequencies(counts: np.ndarray, rows: int) -> np.ndarray:
    return np.log((rows + 1.0) / (counts + 1.0))


def _offsets(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each."""
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[ends[0] : ends[-1]]
    return values, np.repeat(np.arange(len(lists)), np.diff(ends))


def vectors(lists: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of term counts times inverse frequencies, each row in length one."""
    values, rows = _offsets(lists)
    cells, counts = np.unique(rows * len(idf) + values, return_counts=True)
    row, feature = cells // len(idf), cells % len(idf)
    value = counts * idf[feature]
    length = np.sqrt(np.bincount(row, value * value, minlength=len(lists)))
    return row, feature, value / np.maximum(length, 1e-300)[row]


def scores(lists: pa.ListArray, idf: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of each class, rows x labels, and the rows' vectors. The last weights are the constants."""
    row, feature, value = found = vectors(lists, idf)
    out = np.empty((len(lists), weights.shape[1]))
    for k in range(weights.shape[1]):
        out[:, k] = weights[-1, k] + np.bincount(row, value * weights[feature, k], minlength=len(lists))
    return out, found


def loss_and_gradient(
    lists: pa.ListArray, label: np.ndarray, weight: np.ndarray, idf: np.ndarray, weights: np.ndarray
) -> tuple[float, np.ndarray]:
    """Sums over some rows, without the penalty."""
    score, (row, feature, value) = scores(lists, idf, weights)
    score -= score.max(axis=1, keepdims=True)
    total = np.log(np.exp(score).sum(axis=1))
    at = np.arange(len(label))
    loss = float((weight * (total - score[at, label])).sum())
    error = np.exp(score - total[:, None])
    error[at, label] -= 1
    error *= weight[:, None]
    gradient = np.empty_like(weights)
    for k in range(weights.shape[1]):
        gradient[:-1, k] = np.bincount(feature, value * error[row, k], minlength=len(idf))
    gradient[-1] = error.sum(axis=0)
    return loss, gradient


def _partial_sums(idf: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, total, gradient = 0.0, 0.0, np.zeros_like(weights)
        for batch in batches:
            label, weight = (batch.column(c).to_numpy() for c in ("label_id", "weight"))
            some, part = loss_and_gradient(batch.column("terms"), label, weight, idf, weights)
            loss, total, gradient = loss + some, total + float(weight.sum()), gradient + part
        parts = [gradient[i : i + BLOCK].tobytes() for i in range(0, len(gradient), BLOCK)]
        parts.append(np.array([loss, total]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block, the sum of its rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
            part = np.frombuffer(part.as_buffer(), dtype=np.float64)
            sums[block] = sums[block] + part if block in sums else part.copy()
    parts = [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(parts, ["block", "sums"])


def one_pass(rows: DataFrame, idf: np.ndarray, weights: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Mean loss and its gradient over ``rows`` (terms, label_id, weight), in one pass."""
    kinds = "block int, sums binary"
    parts = rows.select("terms", F.col("label_id").cast("int").alias("label_id"), "weight").mapInArrow(_partial_sums(idf, weights), kinds)
    blocks = -(-len(weights) // BLOCK) + 1
    added = {r["block"]: np.frombuffer(r["sums"]) for r in parts.repartition(blocks, "block").mapInArrow(_add, kinds).collect()}
    if not added or not added[blocks - 1][1]:
        raise ValueError("no rows to learn from")
    loss, total = added[blocks - 1]
    gradient = np.concatenate([added[i] for i in range(blocks - 1)]).reshape(weights.shape) / total
    held = weights.copy()
    held[-1] = 0  # constants are free
    return float(loss / total + penalty / 2 * (held * held).sum()), gradient + penalty * held


@dataclass
class Steps:
    """Limited-memory BFGS, told one loss and gradient at a time.

    A step that raises the loss is taken back by half: that costs a pass as well, so
    passes and answers are one to one.
    """

    kept: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    at: tuple[np.ndarray, float, np.ndarray] | None = None
    way: np.ndarray | None = None
    size: float = 1.0

    def _direction(self, gradient: np.ndarray) -> np.ndarray:
        q, shares = gradient.copy(), []
        for s, y in reversed(self.kept):
            shares.append((s * q).sum() / (s * y).sum())
            q -= shares[-1] * y
        s, y = self.kept[-1]
        q *= (s * y).sum() / (y * y).sum()
        for (s, y), share in zip(self.kept, reversed(shares), strict=True):
            q += s * (share - (y * q).sum() / (s * y).sum())
        return -q

    def next(self, weights: np.ndarray, loss: float, gradient: np.ndarray) -> np.ndarray:
        """The weights of the next pass, given what this one found at ``weights``."""
        if self.at is not None:
            before, least, slope = self.at
            if loss > least + ENOUGH * self.size * (self.way * slope).sum():
                self.size /= 2
                return before + self.size * self.way
            s, y = weights - before, gradient - slope
            if (s * y).sum() > 1e-12 * (y * y).sum():
                self.kept = [*self.kept, (s, y)][-MEMORY:]
        self.at = (weights, loss, gradient)
        self.way, self.size = (self._direction(gradient), 1.0) if self.kept else (-gradient, FIRST_STEP)
        return weights + self.size * self.way


@dataclass(frozen=True)
class SoftmaxModel:
    """A trained classifier: its labels in order, and a row of weights per feature."""

    labels: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray

    def scored(self, lists: Column) -> Column:
        """The class with the highest score, the lowest id of equal ones."""
        idf, weights = self.idf, self.weights

        @F.arrow_udf("int")
        def best(column: pa.Array) -> pa.Array:
            return pa.array(scores(column, idf, weights)[0].argmax(axis=1), pa.int32())

        return best(lists)

    def predicted(self, text: Column) -> Column:
        """The label of a text."""
        label = self.scored(terms(text, len(self.idf)))
        return F.get(F.array(*[F.lit(name) for name in self.labels]), label)

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables: labels, and features with their weights."""
        names = pa.table({"label_id": pa.array(range(len(self.labels)), pa.int32()), "label": list(self.labels)})
        spark.createDataFrame(names).write.mode("overwrite").parquet(f"{path}/labels")
        idf = pa.array([*self.idf.tolist(), None], pa.float64())  # the last weights are constants
        table = pa.table({"feature": pa.array(range(len(idf)), pa.int32()), "idf": idf, "weights": self.weights.tolist()})
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/weights")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SoftmaxModel:
        labels = tuple(r["label"] for r in spark.read.parquet(f"{path}/labels").orderBy("label_id").collect())
        rows = spark.read.parquet(f"{path}/weights").orderBy("feature").collect()
        return SoftmaxModel(labels, np.array([r["idf"] for r in rows[:-1]]), np.array([r["weights"] for r in rows]))
