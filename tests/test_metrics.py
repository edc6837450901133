import random

import pytest

from golden import FEW_SHOT, SCORES, ZERO_SHOT, pairs
from textbench.fixed import LABELS
from textbench.operators import metrics as M


def brute(data, labels):
    """Per label (precision, recall, f1, support) by counting pairs."""
    out = {}
    for label in labels:
        tp = sum(t == p == label for t, p in data)
        predicted = sum(p == label for _, p in data)
        support = sum(t == label for t, _ in data)
        precision = tp / predicted if predicted else 0.0
        recall = tp / support if support else 0.0
        f1 = 2 * tp / (predicted + support) if predicted + support else 0.0
        out[label] = (precision, recall, f1, support)
    return out


@pytest.mark.parametrize("name, cells", [("zero", ZERO_SHOT), ("few", FEW_SHOT)])
def test_golden_scores(frame, name, cells):
    row = M.metrics_summary(frame(pairs(cells), name)).first()
    assert row["n"] == 100
    for metric, value in SCORES[name].items():
        assert row[metric] == pytest.approx(value, abs=1e-6)


def test_golden_per_class(frame):
    got = {r["label"]: r for r in M.per_class_metrics(frame(pairs(FEW_SHOT))).collect()}
    assert [round(got["joy"][m], 4) for m in ("precision", "recall", "f1")] == [0.2278, 0.9474, 0.3673]
    assert [round(got["anger"][m], 4) for m in ("precision", "recall", "f1")] == [0.5, 0.0714, 0.125]
    assert [round(got["neutral"][m], 4) for m in ("precision", "recall", "f1")] == [0.4545, 0.1111, 0.1786]
    assert all(got[x]["f1"] == 0 for x in ("sadness", "fear", "love"))
    assert {x: got[x]["support"] for x in LABELS} == dict(zip(LABELS, (19, 5, 14, 1, 16, 45)))


@pytest.mark.parametrize("seed", range(3))
def test_against_counting(frame, seed):
    rnd = random.Random(seed)
    pool = LABELS + ["other", "it's", None]
    data = [(rnd.choice(pool), rnd.choice(pool)) for _ in range(200)]
    want = brute(data, LABELS)
    df = frame(data)
    for r in M.per_class_metrics(df).collect():
        assert (r["precision"], r["recall"], r["f1"], r["support"]) == pytest.approx(want[r["label"]])
    summary = M.metrics_summary(df).first()
    f1 = {label: w[2] for label, w in want.items()}
    support = {label: w[3] for label, w in want.items()}
    assert summary["macro_f1"] == pytest.approx(sum(f1.values()) / 6)
    assert summary["weighted_f1"] == pytest.approx(sum(f1[x] * support[x] for x in LABELS) / sum(support.values()))
    right = sum(t == p and t is not None for t, p in data)
    assert summary["accuracy"] == pytest.approx(right / 200)
    assert M.accuracy(df).first()["accuracy"] == pytest.approx(right / 200)
    listed = [(t in LABELS, p in LABELS, t == p) for t, p in data]
    micro = 2 * sum(t and e for t, _, e in listed) / (sum(t for t, _, _ in listed) + sum(p for _, p, _ in listed))
    assert summary["micro_f1"] == pytest.approx(micro)


def test_macro_over_list_and_over_observed(frame):
    df = frame([("joy", "joy")] * 3)
    assert M.macro_f1(df).first()["macro_f1"] == pytest.approx(1 / 6)
    row = M.macro_f1_observed(df).first()
    assert (row["n_labels"], row["macro_f1_observed"]) == (1, 1.0)


def test_observed_counts_labels_outside_the_list(frame):
    row = M.macro_f1_observed(frame([("joy", "joy"), ("odd", "odd"), ("odd", "joy")])).first()
    assert row["n_labels"] == 2
    assert row["macro_f1_observed"] == pytest.approx((2 / 3 + 2 / 3) / 2)


def test_micro_differs_from_accuracy_outside_the_list(frame):
    row = M.metrics_summary(frame([("odd", "odd"), ("joy", "joy"), ("joy", "love")])).first()
    assert row["accuracy"] == pytest.approx(2 / 3)
    assert row["micro_f1"] == pytest.approx(2 / 4)


def test_nothing_listed_gives_zeros(frame):
    row = M.metrics_summary(frame([("odd", "odd")])).first()
    assert (row["accuracy"], row["macro_f1"], row["micro_f1"], row["weighted_f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_models_are_kept_apart(frame):
    df = frame(pairs(ZERO_SHOT), "zero").union(frame(pairs(FEW_SHOT), "few"))
    got = {r["model"]: round(r["macro_f1"], 6) for r in M.macro_f1(df).collect()}
    assert got == {"zero": 0.053221, "few": 0.111820}


def test_report_lines(frame):
    report = M.classification_report(frame(pairs(FEW_SHOT))).orderBy("line_no").collect()
    assert [r["label"] for r in report] == [*LABELS, "accuracy", "macro avg", "weighted avg"]
    assert (report[0]["precision"], report[0]["recall"], report[0]["f1"], report[0]["support"]) == (0.23, 0.95, 0.37, 19)
    # 0.125 is a tie: the even digit wins, as in C and Python
    assert report[2]["f1"] == float(f"{0.125:.2f}") == 0.12
    assert (report[6]["precision"], report[6]["f1"], report[6]["support"]) == (None, 0.24, 100)


def test_report_has_micro_average_with_a_partial_list(frame):
    report = M.classification_report(frame(pairs(FEW_SHOT)), LABELS[:-1]).orderBy("line_no").collect()
    assert report[5]["label"] == "micro avg"
    want = brute(pairs(FEW_SHOT), LABELS[:-1])
    assert report[5]["support"] == sum(w[3] for w in want.values())
    assert report[5]["precision"] == round(19 / 89, 2)


def test_wide_confusion(frame):
    wide = {r["true_label"]: r for r in M.confusion_matrix_wide(frame(pairs(FEW_SHOT) + [("joy", "odd"), ("joy", None)])).collect()}
    assert wide["joy"]["pred_joy"] == 18 and wide["joy"]["pred_other"] == 2
    assert wide["neutral"]["pred_neutral"] == 5 and wide["love"]["pred_love"] == 0


def test_figures_of_thousands_of_labels(spark):
    df = spark.range(40_000).selectExpr(
        "'m' as model", "id as row_id", "concat('l', id % 4000) as true_label", "concat('l', (id + id div 20000) % 4000) as pred_label"
    )
    got = {r["label"]: r for r in M.observed_metrics(df).collect()}
    assert len(got) == 4000 and all(r["precision"] == r["recall"] == r["f1"] == 0.5 and r["support"] == 10 for r in got.values())
    row = M.macro_f1_observed(df).first()
    assert (row["n_labels"], row["macro_f1_observed"]) == (4000, 0.5)
    with pytest.raises(ValueError, match="too many"):
        M.per_class_metrics(df, [f"l{i}" for i in range(4000)])
