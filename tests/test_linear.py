import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textbench.operators import linear as L
from textbench.operators import metrics as M
from textbench.plans import training as TR

SETTINGS = TR.Settings(features=64, passes=(6,), patience=0, regularization=0.01)
LABELS = ["a", "b", "c"]


def fixture(n, seed=1):
    r = random.Random(seed)
    words = {"a": "alpha beta", "b": "gamma delta", "c": "epsilon zeta"}
    rows = []
    for i in range(n):
        label = r.choice("aaabbc")
        own = words[label].split() + ["the", "of"]
        rows.append((i, " ".join(r.choice(own) for _ in range(r.randrange(1, 9))), label))
    return [*rows, (n, None, "a"), (n + 1, "", "b"), (n + 2, "12 !", None), (n + 3, "alpha " * 5000, "a")]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(fixture(200), "row_id bigint, text string, label string").repartition(5)


@pytest.fixture(scope="module")
def val(spark):
    return spark.createDataFrame(fixture(80, 2), "row_id bigint, text string, label string").repartition(3)


def plain_loop(spark, train, passes):
    """The same training over dense arrays in one process: losses and last weights."""
    rows = train.select("row_id", F.coalesce("text", F.lit("nan")).alias("text"), "label").collect()
    words = sorted({w for r in rows for w in re.findall("[a-z]+", r["text"])})
    hashes = spark.createDataFrame([(w,) for w in words], "text string").select("text", L.terms(F.col("text"), 64)[0].alias("h"))
    at = {r["text"]: r["h"] for r in hashes.collect()}
    tf = np.zeros((len(rows), 64))
    for i, r in enumerate(rows):
        for w in re.findall("[a-z]+", r["text"]):
            tf[i, at[w]] += 1
    x = tf * np.log((len(rows) + 1) / ((tf > 0).sum(axis=0) + 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    x = np.hstack([x, np.ones((len(rows), 1))])
    y = np.array([LABELS.index(r["label"]) if r["label"] in LABELS else 0 for r in rows])
    counts = np.bincount(y, minlength=3)
    weight = (len(y) / (3 * counts))[y]
    w, steps, losses = np.zeros((65, 3)), L.Steps(), []
    for _ in range(passes):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        held = w.copy()
        held[-1] = 0
        loss = -(weight * np.log(p[np.arange(len(y)), y])).sum() / weight.sum() + 0.01 / 2 * (held**2).sum()
        error = (p - np.eye(3)[y]) * weight[:, None]
        losses.append(loss)
        w = steps.next(w, loss, x.T @ error / weight.sum() + 0.01 * held)
    return losses, w


def test_passes_equal_a_plain_loop(spark, train, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 20)  # several blocks of gradient
    got = []
    for loss, model in TR.epochs(train, LABELS, SETTINGS):
        got.append(loss)
        if len(got) == 6:
            break
    losses, weights = plain_loop(spark, train, 6)
    assert got == pytest.approx(losses, rel=1e-9)
    assert model.weights == pytest.approx(weights, rel=1e-6, abs=1e-9)
    assert got[-1] < got[0] / 2


def test_the_gradient_is_that_of_the_loss(spark, train):
    rows = TR._terms(TR._training_rows(train, LABELS, SETTINGS), SETTINGS, "label_id", "weight")
    idf = L.inverse_frequencies(*L.document_frequencies(rows, 64))
    w = np.random.default_rng(3).standard_normal((65, 3))
    _, gradient = L.one_pass(rows, idf, w, 0.01)
    for cell in [(int(np.argmax(np.abs(gradient[:-1]).max(axis=1))), 1), (64, 0)]:
        up, down = w.copy(), w.copy()
        up[cell] += 1e-5
        down[cell] -= 1e-5
        slope = (L.one_pass(rows, idf, up, 0.01)[0] - L.one_pass(rows, idf, down, 0.01)[0]) / 2e-5
        assert slope == pytest.approx(gradient[cell], rel=1e-4)


def test_an_epoch_is_one_pass_and_one_row_of_the_log(train, val, monkeypatch):
    passes = []
    one = TR.one_pass
    monkeypatch.setattr(TR, "one_pass", lambda *args: passes.append(args) or one(*args))
    model, log = TR.select_by_validation(train, val, LABELS, SETTINGS)
    entries = log.orderBy("epoch").collect()
    assert len(passes) == len(entries) == 6
    assert [r["epoch"] for r in entries] == [1, 2, 3, 4, 5, 6]
    best = M.macro_f1_observed(TR.predict_table(model, val)).first()["macro_f1_observed"]
    assert best == pytest.approx(max(r["val_f1"] for r in entries))


def test_patience_ends_the_training(train, val, monkeypatch):
    settings = TR.Settings(features=64, passes=(50,), patience=2, regularization=0.01)
    passes = []
    one = TR.one_pass
    monkeypatch.setattr(TR, "one_pass", lambda *args: passes.append(args) or one(*args))
    _, log = TR.select_by_validation(train, val, LABELS, settings)
    scores = [r["val_f1"] for r in log.orderBy("epoch").collect()]
    assert len(passes) == len(scores) < 50
    assert max(scores[-2:]) <= max(scores[:-2])


def test_results_of_a_trained_model_by_hand(train, val):
    """Confusion, report and predictions agree with a recount in Python."""
    model = TR.train_classifier(train, LABELS, SETTINGS)
    pairs = [(r["true_label"], r["pred_label"]) for r in TR.predict_table(model, val).collect()]
    assert {p for _, p in pairs} <= set(LABELS) and len(pairs) == val.count()
    cells = {(r["true_label"], r["pred_label"]): r["n"] for r in M.confusion_matrix(TR.predict_table(model, val)).collect()}
    assert cells == {c: pairs.count(c) for c in set(pairs)}
    score, report = TR.evaluate_split(model, val)
    f1s = []
    for label in LABELS:
        tp = sum(t == p == label for t, p in pairs)
        f1s.append(2 * tp / max(1, sum(t == label for t, _ in pairs) + sum(p == label for _, p in pairs)))
        line = report.filter(F.col("label") == label).first()
        assert line["f1"] == round(f1s[-1], 2) and line["support"] == sum(t == label for t, _ in pairs)
    assert score.first()["macro_f1_observed"] == pytest.approx(sum(f1s) / 3)
    assert sum(t == p for t, p in pairs) / len(pairs) > 0.8


def test_too_many_labels_are_an_error(spark):
    rows = spark.range(30).selectExpr("id as row_id", "'x' as text", "concat('l', id) as label", "'train' as split")
    with pytest.raises(ValueError, match="more than 20 labels"):
        TR.label_list(rows, most=20)
    assert len(TR.label_list(rows, most=30)) == 30


def test_no_rows_to_learn_from(train):
    with pytest.raises(ValueError, match="no rows"):
        TR.train_classifier(train.limit(0), LABELS, SETTINGS)
