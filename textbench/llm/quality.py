"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over them, and each filter's largest answer
is taken in overlapping chunks that cover the whole text. The largest, mean and least
answers over the chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.labelled import sample
from textbench.llm.language import held_out
from textbench.llm.words import known_id, with_missing_ids

#: Labelled documents of each class that the network is fitted on.
SAMPLE_PER_CLASS = 800
FILTERS = 12
WIDTH = 6
EMBEDDED = 4
#: A chunk is four blocks of bytes; the next begins three blocks later.
BLOCK = 64
PASSES = 8
#: Chunks whose answers are held at once, however long a text is.
CHUNKS_AT_ONCE = 4096
GOOD_FROM = 0.7


def as_bytes(text: str) -> np.ndarray:
    """The text's bytes with blanks behind, to fill a filter's width."""
    return np.frombuffer(text.encode("utf-8", "surrogatepass") + b" " * WIDTH, dtype=np.uint8)


@dataclass
class Network:
    embedding: np.ndarray  # byte, dimension
    filters: np.ndarray  # place, dimension, filter
    bias: np.ndarray
    weights: np.ndarray
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    head: np.ndarray | None = None

    @staticmethod
    def random(seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        return Network(
            r.normal(0, 1, (256, EMBEDDED)),
            r.normal(0, (WIDTH * EMBEDDED) ** -0.5, (WIDTH, EMBEDDED, FILTERS)),
            np.zeros(FILTERS),
            np.zeros(3 * FILTERS + 1),
        )

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter's answer at each place."""
        return np.einsum("be,pef->pbf", self.embedding, self.filters).astype(np.float32)

    def answers(self, data: np.ndarray, tables: np.ndarray) -> np.ndarray:
        n = len(data) - WIDTH + 1
        out = tables[0][data[:n]]
        for place in range(1, WIDTH):
            out += tables[place][data[place : place + n]]
        return out

    def chunks(self, data: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The largest answer of each filter in each chunk."""
        step, n = CHUNKS_AT_ONCE * BLOCK, len(data) - WIDTH + 1
        parts = []
        for begin in range(0, n, step):
            out = self.answers(data[begin : min(begin + step, n) + WIDTH - 1], tables)
            parts.append(np.maximum.reduceat(out, np.arange(0, len(out), BLOCK), axis=0))
        blocks = np.concatenate(parts)
        if len(blocks) <= 4:
            return blocks.max(axis=0)[None] + self.bias
        starts = np.append(np.arange(0, len(blocks) - 4, 3), len(blocks) - 4)
        return np.maximum.reduce([blocks[starts + i] for i in range(4)]) + self.bias

    def pooled(self, data: np.ndarray, tables: np.ndarray) -> np.ndarray:
        c = np.maximum(self.chunks(data, tables), 0)
        return np.concatenate((c.max(axis=0), c.mean(axis=0), c.min(axis=0), [np.log1p(len(data)) / 10]))

    def probability(self, data: np.ndarray, tables: np.ndarray) -> float:
        x = (self.pooled(data, tables) - self.mean) / self.spread
        z = float(np.clip(x @ self.head[:-1] + self.head[-1], -30, 30))
        return 1 / (1 + np.exp(-z))

    def _peaks(self, data: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each filter answers most in each chunk, and its answers there."""
        n, size = len(data) - WIDTH + 1, 4 * BLOCK
        starts = np.arange(0, max(1, n - size + 1), 3 * BLOCK)
        if starts[-1] + size < n:
            starts = np.append(starts, n - size)
        at, most = [], []
        for i in range(0, len(starts), CHUNKS_AT_ONCE):
            some = starts[i : i + CHUNKS_AT_ONCE]
            out = self.answers(data[some[0] : min(some[-1] + size, n) + WIDTH - 1], tables)
            first = some - some[0]
            where = np.stack([s + out[s : s + size].argmax(axis=0) for s in first])
            at.append(where + some[0])
            most.append(np.take_along_axis(out, where, axis=0))
        return np.concatenate(at), np.concatenate(most)

    def step(self, data: np.ndarray, label: float, weight: float, tables: np.ndarray | None = None) -> list[np.ndarray]:
        """Gradients of the log loss by all parameters, for one whole text."""
        at, c = self._peaks(data, self.tables() if tables is None else tables)  # chunk, filter
        c = c + self.bias
        on = c > 0
        c = np.maximum(c, 0)
        x = np.concatenate((c.max(axis=0), c.mean(axis=0), c.min(axis=0), [1.0]))
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
        error = weight * (p - label)
        back = error * self.weights[:-1].reshape(3, FILTERS)
        gc = np.tile(back[1] / len(c), (len(c), 1))
        every = np.arange(FILTERS)
        gc[c.argmax(axis=0), every] += back[0]
        gc[c.argmin(axis=0), every] += back[2]
        gc *= on
        patch = data[at[:, :, None] + np.arange(WIDTH)]  # chunk, filter, place
        embedded = self.embedding[patch]
        g_filters = np.einsum("cf,cfpe->pef", gc, embedded)
        g_embedding = np.zeros_like(self.embedding)
        np.add.at(g_embedding, patch, np.einsum("cf,pef->cfpe", gc, self.filters))
        return [g_embedding, g_filters, gc.sum(axis=0), error * x]


def fit(texts: list[str], labels: np.ndarray, seed: int = 11) -> Network:
    """Filters by stochastic gradient steps, then the final weights, both on whole texts."""
    r = np.random.default_rng(seed)
    net = Network.random(seed)
    data = [as_bytes(t) for t in texts]
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
    names = ("embedding", "filters", "bias", "weights")
    first = [np.zeros_like(getattr(net, n)) for n in names]
    second = [np.zeros_like(getattr(net, n)) for n in names]
    t = 0
    for _ in range(PASSES):
        order = r.permutation(len(data))
        for group in np.array_split(order, max(1, len(order) // 8)):
            total, tables = [np.zeros_like(f) for f in first], net.tables()
            for i in group:
                found = net.step(data[i], labels[i], 0.5 / share[labels[i]], tables)
                for a, b in zip(total, found, strict=True):
                    a += b / len(group)
            t += 1
            for j, name in enumerate(names):  # steps of Adam
                first[j] = 0.9 * first[j] + 0.1 * total[j]
                second[j] = 0.99 * second[j] + 0.01 * total[j] ** 2
                move = first[j] / (1 - 0.9**t) / (np.sqrt(second[j] / (1 - 0.99**t)) + 1e-8)
                setattr(net, name, getattr(net, name) - 0.01 * move)
    tables = net.tables()
    x = np.array([net.pooled(d, tables) for d in data])
    net.mean, net.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.hstack(((x - net.mean) / net.spread, np.ones((len(x), 1))))
    weight = 0.5 / share[labels]
    net.head = np.zeros(x.shape[1])
    penalty = np.diag(np.append(np.full(x.shape[1] - 1, 0.5), 0.0))
    for _ in range(40):  # Newton steps of a logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ net.head, -30, 30)))
        gradient = x.T @ (weight * (p - labels)) + penalty @ net.head
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(x.shape[1])
        net.head -= np.linalg.solve(hessian, gradient)
    return net


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Network | None:
    """A network from labels.quality of rows that are not held out; None without both
    classes. The driver receives at most twice ``per_class`` texts, and bounded bytes of
    them; see ``sample``."""
    rows = sample(documents, labels, "quality", per_class).orderBy("doc_id", "label", "text").collect()
    told = np.array([r["label"] for r in rows], dtype=int)
    if len(set(told)) < 2:
        return None
    return fit([r["text"] for r in rows], told)


def score(documents: DataFrame, labels: DataFrame, network: Network | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score. NULL counts as an empty text, which is scored as
    blanks are; with nothing to learn from every score is 0.5. Repeated rows stay, and equal
    texts score equal; whole texts are read, long ones in parts; other columns are
    ignored; an empty table gives no rows."""
    network = network or train(documents, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = network.tables() if network else None
        for batch in batches:
            scores = [network.probability(as_bytes(t), tables) if network else 0.5 for t in batch["text"]]
            yield batch[["doc_id", "held_out"]].assign(score=scores)

    rows = documents.select(
        known_id(F.col("doc_id")), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")
    )
    return with_missing_ids(rows.mapInPandas(run, "doc_id bigint, held_out boolean, score double"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    tables = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    out = score(*tables)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
