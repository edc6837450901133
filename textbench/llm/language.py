"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties, and
calibrated by a temperature.

N-grams (one to three characters of lower-cased letters, other characters being one
blank) are hashed to ``DIMENSIONS`` features. Document frequencies come from all rows
that may be learned from; weights are fitted on a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.words import known_id, mix, per_process, with_missing_ids
from textbench.session import materialize

DIMENSIONS = 2**15
LONGEST = 3
#: Rows of each language that weights are fitted on, and of those the share for calibration.
SAMPLE_PER_LANGUAGE = 400
CALIBRATION_SHARE = 0.25
#: Languages that a model learns, those with the most rows.
LANGUAGES = 500
UNKNOWN = "und"
#: A document is rejected when its language is unknown or its score lower.
ACCEPTED_SCORE = 0.5


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; rows without an id are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def thinned(rows: DataFrame, column: str, totals: dict, wanted: int, hashed: Column) -> DataFrame:
    """About four times ``wanted`` rows of each value of ``column``, all where there are fewer.

    A row stays if its ``draw``, a number from 0 to 1 that follows from ``hashed``, is
    below its value's share; so few rows are ranked afterwards, however many there are.
    """
    draw = F.shiftrightunsigned(hashed, 11) / F.lit(2.0**53)
    share = F.create_map(*(F.lit(x) for value, n in totals.items() for x in (value, min(1.0, 4.0 * wanted / n))))
    return rows.withColumn("draw", draw).filter(F.col("draw") <= F.element_at(share, F.col(column)))


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def letters() -> np.ndarray:
    """Which code points are letters; kept by the worker process."""
    return per_process("letters", letter_table)


def features(text: str | None) -> np.ndarray | None:
    """The feature of every n-gram occurrence; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    known = letters()[points]
    if not known.any():
        return None
    points = np.where(known, points, np.uint32(32)).astype(np.uint64)
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    blank = points == 32
    points = points[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
    out, gram = [], points
    for n in range(1, LONGEST + 1):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x110000) + points[n - 1 :]
        out.append(mix(gram + np.uint64(n)) % np.uint64(DIMENSIONS))
    return np.concatenate(out).astype(np.int64)


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Indices and values of a text's TF-IDF vector of length one."""
    found = features(text)
    if found is None:
        return None
    counts = np.bincount(found, minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    values = counts[at] * idf[at]
    return at, values / (np.sqrt(values @ values) or 1.0)


@dataclass
class Ftrl:
    """Multinomial logistic regression by the proximal form of follow-the-regularised-leader."""

    labels: list[str]
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.01
    temperature: float = 1.0
    weights: np.ndarray = field(init=False)

    def fit(self, vectors: list, targets: np.ndarray, passes: int = 5, seed: int = 7) -> None:
        n = np.zeros((DIMENSIONS, len(self.labels)))
        z = np.zeros_like(n)
        order, random = np.arange(len(vectors)), np.random.default_rng(seed)
        for _ in range(passes):
            random.shuffle(order)
            for i in order:
                at, values = vectors[i]
                w = self._weights(z[at], n[at])
                error = _softmax(values @ w)
                error[targets[i]] -= 1.0
                gradient = values[:, None] * error
                squared = gradient**2
                z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / self.alpha * w
                n[at] += squared
        self.weights = self._weights(z, n).astype(np.float64)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def calibrate(self, vectors: list, targets: np.ndarray) -> None:
        """The temperature of least log loss on rows that weights were not fitted on."""
        if not len(targets):
            return
        logits = np.array([v @ self.weights[at] for at, v in vectors])
        rows = np.arange(len(targets))

        def loss(t: float) -> float:
            x = logits / t
            top = x.max(axis=1)
            return float(np.mean(top + np.log(np.exp(x - top[:, None]).sum(axis=1)) - x[rows, targets]))

        self.temperature = min(np.geomspace(0.02, 5.0, 200), key=loss)

    def predict(self, at: np.ndarray, values: np.ndarray) -> tuple[str, float]:
        p = _softmax(values @ self.weights[at] / self.temperature)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(feature, n): in how many texts each feature occurs; -1 counts all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                found = features(text)
                if found is not None:
                    counts[np.unique(found)] += 1
                    n += 1
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"feature": np.append(at, -1), "n": np.append(counts[at], n)})

    found = rows.select("text").mapInPandas(run, "feature bigint, n bigint")
    return found.groupBy("feature").agg(F.sum("n").alias("n"))


def train(
    documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, languages: int = LANGUAGES
) -> tuple[Ftrl, np.ndarray] | None:
    """A model and its inverse document frequencies; None if nothing can be learned.

    Learns from text and lang of rows that are not held out, have a language and a
    letter. Of more than ``languages`` values of lang the most frequent are learned, ties
    in their order: rare ones are hardly languages. The driver receives ``DIMENSIONS``
    counts at most and, per language, ``per_language`` texts.
    """
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not totals:
        return None
    learned = rows.filter(F.col("lang").isin([r["lang"] for r in totals]))
    near = thinned(learned, "lang", {r["lang"]: r["n"] for r in totals}, per_language, F.xxhash64("text", "doc_id"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    sample = near.select("lang", "text", "draw").withColumn("place", place).filter(F.col("place") <= per_language)
    sample = materialize(sample)
    counts = document_frequencies(rows).toPandas().set_index("feature")["n"]
    total = int(counts.get(-1, 0))
    if not total:
        return None
    df = np.zeros(DIMENSIONS)
    kept = counts[counts.index >= 0]
    df[kept.index.to_numpy()] = kept.to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1.0
    fitted, told = [], []
    for r in sample.orderBy("lang", "place").collect():
        if (v := vector(r["text"], idf)) is not None:
            fitted.append(v)
            told.append(r["lang"])
    labels = sorted(set(told))
    targets = np.array([labels.index(t) for t in told])
    last = np.arange(len(targets)) % round(1 / CALIBRATION_SHARE) == 1
    model = Ftrl(labels)
    model.fit([v for v, x in zip(fitted, last, strict=True) if not x], targets[~last])
    model.calibrate([v for v, x in zip(fitted, last, strict=True) if x], targets[last])
    return model, idf


def identify(documents: DataFrame, trained: tuple[Ftrl, np.ndarray] | None = None) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, text_hash, lang_pred, score.

    Texts that are NULL or have no letter get ``und`` and score 0, as do all texts when
    there is nothing to learn from. Of equal scores the language that sorts first is told.
    Repeated rows stay; whole texts are read; other columns are ignored; an empty table
    gives no rows.
    """
    model = trained or train(documents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                v = vector(text, model[1]) if model else None
                found.append((UNKNOWN, 0.0) if v is None else model[0].predict(*v))
            out = batch.drop(columns="text")
            out["lang_pred"] = [x for x, _ in found]
            out["score"] = [x for _, x in found]
            yield out

    rows = documents.select(
        known_id(F.col("doc_id")),
        held_out(F.col("doc_id")).alias("held_out"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        "text",
    )
    kinds = "doc_id bigint, held_out boolean, text_hash bigint, lang_pred string, score double"
    return with_missing_ids(rows.mapInPandas(run, kinds))


def keep_accepted(documents: DataFrame, accepted: float = ACCEPTED_SCORE) -> DataFrame:
    """``documents`` without those of unknown language or a score below ``accepted``.

    With no language to learn from, none is judged, and only texts without a letter go.
    Columns and rows stay as they are; an empty table stays empty.
    """
    model = train(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                if model is None:
                    keep.append(features(text.as_py()) is not None)
                    continue
                v = vector(text.as_py(), model[1])
                keep.append(v is not None and model[0].predict(*v)[1] >= accepted)
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op10_language(spark, sf_dir: str) -> DataFrame:
    out = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "held_out", "lang_pred", "score")
