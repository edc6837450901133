import pytest
from pyspark.sql import functions as F

from textbench import fixtures as X
from textbench.operators import metrics as M
from textbench.operators.epochs import early_stop
from textbench.operators.predictions import baseline_predictions
from textbench.plans import training as TR
from textbench.session import work_dir
from textbench.sources.tables import read_predictions

SF = "/root/testdata/sf0.001"
SETTINGS = TR.Settings(features=2**12, passes=(1, 3), patience=1)


@pytest.fixture(scope="module")
def data(spark):
    rows = X.trainable(spark, SF)
    train, val, test = (rows.filter(F.col("split") == s) for s in ("train", "val", "test"))
    return train, val, test, TR.label_list(rows)


@pytest.fixture(scope="module")
def model(data):
    train, _, _, labels = data
    return TR.train_classifier(train, labels, SETTINGS)


def test_every_row_is_predicted_once(model, data):
    _, _, test, labels = data
    got = TR.predict_table(model, test)
    assert sorted(r["row_id"] for r in got.collect()) == sorted(r["row_id"] for r in test.collect())
    assert {r["pred_label"] for r in got.collect()} <= set(labels)


def test_better_than_the_baselines(spark, model, data):
    labels = data[3]
    rows = X.trainable(spark, SF)
    trained = M.macro_f1(TR.predict_table(model, data[2]), labels).first()["macro_f1"]
    untrained = M.macro_f1(baseline_predictions(rows, 1, labels), labels).collect()
    assert all(trained > r["macro_f1"] for r in untrained)


def test_evaluation_agrees_with_the_predictions(model, data):
    _, _, test, labels = data
    f1, report = TR.evaluate_split(model, test)
    want = M.macro_f1_observed(TR.predict_table(model, test)).first()["macro_f1_observed"]
    assert f1.first()["macro_f1_observed"] == pytest.approx(want)
    assert report.count() == len(labels) + 3


def test_saved_model_predicts_the_same(spark, model, data, rows):
    path = work_dir(spark)
    TR.save_model(model, path)
    again = TR.load_model(path)
    assert rows(TR.predict_table(again, data[2])) == rows(TR.predict_table(model, data[2]))


def test_unknown_true_label_is_the_first_class(spark, model, data):
    df = spark.createDataFrame([(1, "la la", "klingon"), (2, None, None)], "row_id bigint, text string, label string")
    got = TR.predict_table(model, df).orderBy("row_id").collect()
    assert [(r["true_label"], r["text"]) for r in got] == [(data[3][0], "la la"), (data[3][0], "nan")]


def test_selection(data):
    train, val, _, labels = data
    model, log = TR.select_by_validation(train, val, labels, SETTINGS)
    entries = log.orderBy("epoch").collect()
    stop = early_stop(log, SETTINGS.patience).first()
    assert stop["stop_epoch"] == len(entries)
    best = M.macro_f1_observed(TR.predict_table(model, val)).first()["macro_f1_observed"]
    assert best == pytest.approx(stop["best_f1"])


def test_weighted_sampling(data):
    train, _, test, labels = data
    sampled = TR.train_classifier(train, labels, TR.Settings(features=2**10, passes=(2,), use_weighted_sampling=True))
    assert TR.predict_table(sampled, test).count() == test.count()


def test_whole_run(spark, data, monkeypatch):
    path = work_dir(spark)
    scored, score = [], TR.scored_split
    monkeypatch.setattr(TR, "scored_split", lambda *args: scored.append(args) or score(*args))
    saved = {"predictions_path": f"{path}/predictions", "report_path": f"{path}/report"}
    log, f1, report = TR.train_and_evaluate(X.trainable(spark, SF), SETTINGS, path, **saved)
    assert len(scored) == 1
    kept = read_predictions(spark, saved["predictions_path"], "classifier", keep=["row_id"])
    assert kept.count() == data[2].count()
    assert M.macro_f1_observed(kept).first()["macro_f1_observed"] == pytest.approx(f1.first()["macro_f1_observed"])
    lines = [r["value"] for r in spark.read.text(saved["report_path"]).collect()]
    assert lines[1] == "EVALUATION METRICS" and len(lines) > 10
    ranking = TR.against_untrained(kept.withColumn("row_id", F.col("row_id").cast("bigint")), X.trainable(spark, SF), 1, data[3])
    assert [r["model"] for r in ranking.orderBy("rank").collect()][0] == "classifier" and ranking.count() == 3
    assert log.count() >= 1 and report.count() == len(data[3]) + 3
    want = M.macro_f1_observed(TR.predict_table(TR.load_model(path), data[2])).first()["macro_f1_observed"]
    assert f1.first()["macro_f1_observed"] == pytest.approx(want)


def test_label_list_prefers_the_listed_labels(spark, data):
    assert data[3] == ["de", "en", "es", "fr"]
    assert TR.label_list(X.labelled(spark, SF)) == ["joy", "sadness", "anger", "fear", "love", "neutral"]
