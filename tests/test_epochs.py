import random

import pytest

from textbench.operators import epochs as E
from textbench.operators import rows as R


def by_hand(scores, patience):
    best, best_at, waited = 0.0, None, 0
    for epoch, score in enumerate(scores, 1):
        if score > best:
            best, best_at, waited = score, epoch, 0
            continue
        waited += 1
        if patience and waited >= patience:
            return epoch, best_at, best, True
    return len(scores), best_at, best, False


def log(spark, runs):
    data = [(run, e, s) for run, scores in runs.items() for e, s in enumerate(scores, 1)]
    return spark.createDataFrame(data, "run_id bigint, epoch bigint, val_f1 double").repartition(4)


@pytest.mark.parametrize("block", [65536, 3])
@pytest.mark.parametrize("patience", [0, 1, 2, 3])
def test_early_stop_against_a_loop(spark, monkeypatch, patience, block):
    monkeypatch.setattr(R, "BLOCK_ROWS", block)
    rnd = random.Random(patience)
    runs = {r: [rnd.choice([0.0, -0.5, 0.1, 0.2, 0.3, 0.4, float("nan")]) for _ in range(rnd.randint(1, 12))] for r in range(60)}
    runs |= {100: [0.1, 0.3, 0.3, 0.2, 0.4, 0.5], 101: [0.0] * 5}
    got = {r["run_id"]: (r["stop_epoch"], r["best_epoch"], r["best_f1"], r["stopped_early"]) for r in E.early_stop(log(spark, runs), patience).collect()}
    assert got == {r: by_hand(s, patience) for r, s in runs.items()}


def test_stated_cases(spark):
    runs = {1: [0.1, 0.3, 0.3, 0.2, 0.4, 0.5]}
    row = E.early_stop(log(spark, runs), 2).first()
    assert (row["stop_epoch"], row["best_epoch"], row["stopped_early"]) == (4, 2, True)
    row = E.early_stop(log(spark, runs), 0).first()
    assert (row["stop_epoch"], row["best_epoch"], row["stopped_early"]) == (6, 6, False)


def test_best_epoch(spark):
    runs = {1: [0.0, 0.0], 2: [0.2, 0.5, 0.5], 3: [-1.0], 4: [float("nan"), 0.1]}
    got = {r["run_id"]: (r["n_epochs"], r["best_epoch"], r["best_f1"]) for r in E.best_epoch(log(spark, runs)).collect()}
    assert got == {1: (2, None, None), 2: (3, 2, 0.5), 3: (1, None, None), 4: (2, 2, 0.1)}


def test_losses(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 4)
    rnd = random.Random(9)
    data = [(1, e, b, rnd.random()) for e in (1, 2) for b in range(15)]
    df = spark.createDataFrame(data, "run_id bigint, epoch bigint, batch bigint, loss double").repartition(3)
    for r in E.running_epoch_loss(df).collect():
        seen = [x for _, e, b, x in data if e == r["epoch"] and b <= r["batch"]]
        assert r["running_loss"] == pytest.approx(sum(seen) / len(seen))
    for r in E.epoch_loss(df).collect():
        seen = [x for _, e, _, x in data if e == r["epoch"]]
        assert (r["n_batches"], r["mean_loss"]) == (15, pytest.approx(sum(seen) / 15))
