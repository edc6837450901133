"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are scored by the log of their odds in toxic against other texts, both with a
Dirichlet prior in proportion to how often the token occurs at all. A scan in linear
time finds every maximal segment of a text; how likely a segment of that score is in
other texts of that length follows an extreme-value law, and the significant segments
of a text give one probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.labelled import sample, usable_labels, with_labels
from textbench.llm.language import held_out
from textbench.llm.words import IS_WORD, TO_LOWER, known_id, with_missing_ids
from textbench.session import materialize

#: Labelled documents of each class that the law of other texts and the calibration are fitted on.
SAMPLE_PER_CLASS = 3000
#: Tokens of a model, those with the surest log-odds, of four times as many most frequent ones.
VOCABULARY = 50_000
#: Different tokens that a task counts before it hands their counts on.
TOKENS_AT_ONCE = 400_000
#: The prior weighs as much as this share of all counted tokens.
PRIOR_SHARE = 0.05
#: Standard errors from 0 from which on a token's log-odds count.
LEAST_Z = 1.9
#: What a token costs a segment besides its log-odds.
DRIFT = 0.3
LEAST_COUNT = 3
STEM = 5
#: Expected number of segments in other texts up to which a segment is significant.
SIGNIFICANT = 0.1
TOXIC_FROM = 0.3

_TABLE = bytes(int(TO_LOWER[i]) if IS_WORD[i] else 0x20 for i in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-case words in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, score), disjoint, each of positive score, in order.

    One pass; a segment list is merged from its end, so the work is linear.
    """
    found: list[list[float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= total:
                found.append([start, i + 1, left, total, j])
                break
            start, left = int(found[j][0]), found[j][2]
            del found[j:]
    return [(int(a), int(b), after - before) for a, b, before, after, _ in found]


@dataclass
class Model:
    """Token scores, the extreme-value law of other texts, and the calibration."""

    words: dict[bytes, float]
    stems: dict[bytes, float]
    rate: float = 1.0
    scale: float = 1.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)

    def score_of(self, word: bytes) -> float:
        s = self.words.get(word)
        if s is None:
            s = self.stems.get(word[:STEM], 0.0)
        return s - DRIFT

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and the segments; none if no word scores above zero."""
        found = tokens(text)
        scored = {w: self.score_of(w) for w in set(found)}
        if not scored or max(scored.values()) <= 0:
            return len(found), []
        return len(found), segments([scored[w] for w in found])

    def expected(self, n: int, score: float) -> float:
        """Segments of at least this score that other texts of n words have on average."""
        return self.scale * max(n, 1) * math.exp(-self.rate * score)

    def features(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
        logs = [-math.log(e) for _, _, s in found if (e := max(self.expected(n, s), 1e-30)) < SIGNIFICANT]
        return 1.0, math.sqrt(max(logs, default=0.0)), math.log1p(sum(logs))

    def probability(self, n: int, found: list[tuple[int, int, float]]) -> float:
        x = sum(a * b for a, b in zip(self.weights, self.features(n, found), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def _kinds(text: str) -> set[bytes]:
    """The different words of a text, and the stems of longer words."""
    words = set(tokens(text))
    return words | {w[:STEM] + b"*" for w in words if len(w) > STEM}


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, n0, n1): in how many texts of each class each word, and each stem of longer
    words, occurs. A text counts once, so that no text that repeats a word decides."""

    def told(counts: dict[int, Counter]) -> pd.DataFrame:
        names = [*(counts[0].keys() | counts[1].keys())]
        return pd.DataFrame({"token": names, "n0": [counts[0][w] for w in names], "n1": [counts[1][w] for w in names]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"], strict=True):
                counts[label].update(_kinds(text))
                if len(counts[0]) + len(counts[1]) > TOKENS_AT_ONCE:
                    yield told(counts)
                    counts = {0: Counter(), 1: Counter()}
        yield told(counts)

    found = rows.select("label", "text").mapInPandas(run, "token binary, n0 bigint, n1 bigint")
    return found.groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def occurrences(documents: DataFrame, asked: list[bytes]) -> dict[bytes, int]:
    """In how many of all texts each of the tokens ``asked`` occurs, and b"" any token at all,
    counted as often as it occurs in a text's set. A vocabulary's number of counts is sent
    to the tasks and by each of them."""
    known = frozenset(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                found = _kinds(text)
                counts.update(found & known)
                counts[b""] += len(found)
        yield pd.DataFrame({"token": [*counts], "n": [*counts.values()]})

    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    found = texts.mapInPandas(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    return dict(zip(map(bytes, found["token"]), found["n"].tolist(), strict=True))


def log_odds(counts: pd.DataFrame) -> pd.DataFrame:
    """``counts`` (token, n0, n1, n) with delta, z, p0: log-odds in class 1 against 0 under the
    Dirichlet prior, which follows from ``n``, how often a token occurs in all documents."""
    n = counts["n0"].sum(), counts["n1"].sum()
    weight = PRIOR_SHARE * max(1, n[0] + n[1])
    prior = weight * counts["n"] / counts["n"].sum()
    a = counts["n1"] + prior
    b = counts["n0"] + prior
    delta = np.log(a / (n[1] + weight - a)) - np.log(b / (n[0] + weight - b))
    return counts.assign(delta=delta, z=delta / np.sqrt(1 / a + 1 / b), p0=b / (n[0] + weight))


def train(
    documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, vocabulary: int = VOCABULARY
) -> Model | None:
    """A model from labels.toxic of rows that are not held out; None without both classes.

    Tokens are counted in all labelled rows, and how often they occur at all, the prior, in
    all documents; ``per_class`` bounds the rows for the law of other texts and the
    calibration, ``vocabulary`` the tokens that the driver gets.
    """
    rows = sample(documents, labels, "toxic", per_class)
    weights = {r["label"]: r["weight"] for r in rows.groupBy("label").agg(F.first("weight").alias("weight")).collect()}
    if len(weights) < 2:
        return None
    counts = materialize(token_counts(with_labels(documents, usable_labels(labels, "toxic"))))
    totals = counts.agg(F.sum("n0"), F.sum("n1")).first()
    counts = counts.filter(F.col("n0") + F.col("n1") >= LEAST_COUNT)
    frame = counts.orderBy((F.col("n0") + F.col("n1")).desc(), "token").limit(4 * vocabulary).toPandas()
    frame["token"] = [bytes(t) for t in frame["token"]]
    anywhere = occurrences(documents, frame["token"].tolist())
    frame["n"] = [anywhere.get(t, 0) for t in frame["token"]]
    # all other tokens are one
    left = {"n0": int(totals[0]) - frame["n0"].sum(), "n1": int(totals[1]) - frame["n1"].sum(), "n": anywhere.get(b"", 0) - frame["n"].sum()}
    rest = pd.DataFrame({"token": [b""], **{c: [max(1, n)] for c, n in left.items()}})
    frame = log_odds(pd.concat([frame, rest], ignore_index=True))
    # a score is what the log-odds are at least, within one standard error
    frame["delta"] -= frame["delta"] / frame["z"].abs().clip(lower=1.0)
    frame = frame[frame["z"].abs() > LEAST_Z].sort_values("z", key=abs, ascending=False, kind="stable").head(vocabulary)
    is_stem = [token.endswith(b"*") for token in frame["token"]]
    pairs = zip(frame["token"], frame["delta"], is_stem, strict=True)
    words, stems = {}, {}
    for token, delta, stem in pairs:
        if stem and delta > 0:
            stems[token[:-1]] = float(delta)
        elif not stem:
            words[token] = float(delta)
    model = Model(words, stems)
    model.rate = _rate(frame["p0"].to_numpy(), frame["delta"].to_numpy())
    _fit(model, rows, weights)
    return model


def _rate(p: np.ndarray, delta: np.ndarray) -> float:
    """The positive root of sum p exp(rate (score - drift)) = 1 in other texts."""
    other = max(0.0, 1.0 - p.sum())

    def excess(x: float) -> float:
        return float((p * np.exp(x * (delta - DRIFT))).sum() + other * math.exp(-x * DRIFT) - 1.0)

    low, high = 0.2, 0.4
    while excess(high) < 0 and high < 8:
        high *= 1.3
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return (low + high) / 2


def _fit(model: Model, rows: DataFrame, weights_of: dict[int, float]) -> None:
    """The scale of the extreme-value law by maximum likelihood, then the calibration.

    Rows count by the weight of their class, so that the calibration keeps the classes'
    shares in all labelled rows; the law is one of class 0 alone, where all weigh the same.
    The driver receives a few numbers per sampled document.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for label, text in zip(batch["label"], batch["text"], strict=True):
                n, found = model.passages(text)
                scores = sorted((s for _, _, s in found), reverse=True)
                out.append((label, n, scores))
            yield pd.DataFrame(out, columns=["label", "n", "scores"])

    found = rows.select("label", "text").mapInPandas(run, "label int, n bigint, scores array<double>").toPandas()
    other = found[found["label"] == 0]
    tops = np.array([s[0] if len(s) else 0.0 for s in other["scores"]])
    expected = np.maximum(other["n"].to_numpy(), 1) * np.exp(-model.rate * tops)
    model.scale = float(len(other) / expected.sum())
    x = np.array([model.features(n, [(0, 0, s) for s in scores]) for n, scores in zip(found["n"], found["scores"], strict=True)])
    y = found["label"].to_numpy(dtype=float)
    share = found["label"].map(weights_of).to_numpy(dtype=float)
    weights = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of a logistic regression with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (share * (p - y)) + 0.1 * weights
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(weights))
        weights -= np.linalg.solve(hessian, gradient)
    model.weights = tuple(float(w) for w in weights)


def score(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, passages (start, end in words, expected number).

    NULL and empty texts have no passages and the score of a text without any. With
    nothing to learn from all scores are 0. Repeated rows stay, and equal texts score equal;
    of tokens that are equally sure the more frequent are learned, then those that sort first. Whole texts are
    read, in linear time; other columns are ignored; an empty table gives no rows.
    """
    model = model or train(documents, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, passages = [], []
            for text in batch["text"]:
                n, found = model.passages(text) if model else (0, [])
                scores.append(model.probability(n, found) if model else 0.0)
                told = [(a, b, model.expected(n, s)) for a, b, s in found]
                passages.append([{"start": a, "end": b, "expected": e} for a, b, e in told if e < SIGNIFICANT])
            yield batch[["doc_id", "held_out"]].assign(score=scores, passages=passages)

    rows = documents.select(
        known_id(F.col("doc_id")), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")
    )
    kinds = "doc_id bigint, held_out boolean, score double, passages array<struct<start:int,end:int,expected:double>>"
    return with_missing_ids(rows.mapInPandas(run, kinds))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    tables = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    out = score(*tables)
    return out.select(
        "doc_id",
        "held_out",
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
