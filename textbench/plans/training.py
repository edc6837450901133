"""Train, select, score, save and load a text classifier."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.fixed import LABELS, MISSING_TEXT
from textbench.functions.labels import decode_label, encode_label
from textbench.operators.balance import attach_class_weight, class_weights, weighted_sample
from textbench.operators.compare import compare_models
from textbench.operators.labels import resolve_labels
from textbench.operators.linear import SoftmaxModel, Steps, document_frequencies, inverse_frequencies, one_pass, terms
from textbench.operators.metrics import LABELS_IN_COLUMNS, classification_report, macro_f1_observed
from textbench.operators.predictions import baseline_predictions, truncate_output
from textbench.session import materialize
from textbench.sources.reports import metrics_report, write_report
from textbench.sources.tables import write_predictions


@dataclass(frozen=True)
class Settings:
    """What training can be told. The last of ``passes`` is how many passes over the
    training rows it makes at most; each gives weights that can be validated."""

    features: int = 2**14
    passes: tuple[int, ...] = (10,)
    patience: int = 2
    regularization: float = 1e-4
    use_class_weights: bool = True
    use_weighted_sampling: bool = False
    seed: int = 42


def label_list(df: DataFrame, listed: Sequence[str] = LABELS, most: int = LABELS_IN_COLUMNS) -> list[str]:
    """The labels that ``resolve_labels`` settles on, as a plan-time list; one value per class,
    never per row. More than ``most`` are an error: they are hardly classes, and a model
    has a column of weights and reports have columns for each."""
    found = resolve_labels(df, listed).filter(F.col("label_id") <= most).orderBy("label_id").collect()
    if len(found) > most:
        raise ValueError(f"more than {most} labels")
    return [row["label"] for row in found]


def _encoded(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.select(
        "row_id", F.coalesce("text", F.lit(MISSING_TEXT)).alias("text"), encode_label(F.col("label"), labels).alias("label_id")
    )


def _training_rows(train: DataFrame, labels: Sequence[str], settings: Settings) -> DataFrame:
    """Encoded rows with their class weight; with weighted sampling the weights come from the drawn rows."""
    rows = _encoded(train, labels)
    if settings.use_weighted_sampling:
        rows = materialize(weighted_sample(rows, settings.seed, labels, columns=["text"]))
    if settings.use_class_weights:
        return attach_class_weight(rows, class_weights(rows, labels))
    return rows.withColumn("weight", F.lit(1.0))


def _terms(df: DataFrame, settings: Settings, *columns: str) -> DataFrame:
    """Hashed terms, written once: the passes that follow read numbers and not texts."""
    return materialize(df.select(*columns, terms(F.col("text"), settings.features).alias("terms")))


def epochs(
    train: DataFrame, labels: Sequence[str] = LABELS, settings: Settings = Settings()
) -> Iterator[tuple[float, SoftmaxModel]]:
    """After each pass over (row_id, text, label): the mean loss that it found, penalty
    included, and the model that it leaves. Class weights are on by default."""
    rows = _terms(_training_rows(train, labels, settings), settings, "label_id", "weight")
    idf = inverse_frequencies(*document_frequencies(rows, settings.features))
    weights, steps = np.zeros((settings.features + 1, len(labels))), Steps()
    while True:
        loss, gradient = one_pass(rows, idf, weights, settings.regularization)
        weights = steps.next(weights, loss, gradient)
        yield loss, SoftmaxModel(tuple(labels), idf, weights)


def train_classifier(
    train: DataFrame, labels: Sequence[str] = LABELS, settings: Settings = Settings(), passes: int | None = None
) -> SoftmaxModel:
    """Fit on (row_id, text, label) in so many passes, without validation."""
    *_, (_, model) = islice(epochs(train, labels, settings), passes or settings.passes[-1])
    return model


def predict_table(model: SoftmaxModel, df: DataFrame, name: str = "classifier") -> DataFrame:
    """(model, row_id, text, true_label, pred_label), one row per input row.

    The label list belongs to the model; a true label outside it counts as class 0, as
    everywhere. Only hashed terms go to Python, and class numbers come back.
    """
    rows = _encoded(df, model.labels)
    return rows.select(
        F.lit(name).alias("model"),
        "row_id",
        "text",
        decode_label(F.col("label_id"), model.labels).alias("true_label"),
        model.predicted(F.col("text")).alias("pred_label"),
    )


def scored_split(model: SoftmaxModel, df: DataFrame, name: str = "classifier") -> DataFrame:
    """Predictions as they are saved, texts cut, scored and written to the shared folder once."""
    return materialize(truncate_output(predict_table(model, df, name)))


def evaluate_split(
    model: SoftmaxModel,
    df: DataFrame,
    name: str = "classifier",
    predictions_path: str | None = None,
    report_path: str | None = None,
    fmt: str = "csv",
) -> tuple[DataFrame, DataFrame]:
    """Macro-F1 over the observed labels, and the report.

    The split is scored once, and what is asked for is made of that: the saved
    predictions (row_id, text, true_label, pred_label) and the metrics report.
    """
    labels = model.labels
    predictions = scored_split(model, df, name)
    if predictions_path:
        write_predictions(predictions, predictions_path, fmt, keep=["row_id"])
    if report_path:
        write_report(metrics_report(predictions, labels), report_path)
    return macro_f1_observed(predictions), classification_report(predictions, labels)


def against_untrained(predictions: DataFrame, df: DataFrame, seed: int, labels: Sequence[str], score_split: str = "test") -> DataFrame:
    """The ranking of ``compare_models`` with both untrained models on the same split of (row_id, label, split)."""
    columns = ["model", "row_id", "true_label", "pred_label"]
    untrained = baseline_predictions(df, seed, labels, score_split)
    return compare_models(predictions.select(*columns).unionByName(untrained.select(*columns)), labels=labels)


def train_and_evaluate(
    df: DataFrame,
    settings: Settings = Settings(),
    path: str | None = None,
    listed: Sequence[str] = LABELS,
    predictions_path: str | None = None,
    report_path: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole run over (row_id, text, label, split): resolve the labels, select by validation, save, score test.

    Returns the log, the macro-F1 on the test split and its report; saves the model, the
    predictions and the metrics report where a path is given, all from one scoring.
    """
    labels = label_list(df, listed)
    train, val, test = (df.filter(F.col("split") == s) for s in ("train", "val", "test"))
    model, log = select_by_validation(train, val, labels, settings)
    if model is None:
        model = train_classifier(train, labels, settings)
    if path:
        save_model(model, path)
    return log, *evaluate_split(model, test, predictions_path=predictions_path, report_path=report_path)


def select_by_validation(
    train: DataFrame, val: DataFrame, labels: Sequence[str] = LABELS, settings: Settings = Settings()
) -> tuple[SoftmaxModel | None, DataFrame]:
    """Train pass by pass, validate after each, keep the best, stop when patience runs out.

    Returns the best model (None if none scores above 0) and the log (run_id, epoch,
    train_loss, val_f1), which ``early_stop`` accepts. An epoch is one pass over the
    training rows and goes on where the one before it ended; ``train_loss`` is what the
    pass found, ``val_f1`` the macro-F1 over observed labels that its step leads to.
    """
    val_rows = _terms(_encoded(val, labels), settings, "label_id")
    log, best, best_score, waited = [], None, 0.0, 0
    for epoch, (loss, model) in enumerate(islice(epochs(train, labels, settings), settings.passes[-1]), start=1):
        predictions = val_rows.select(
            F.lit("candidate").alias("model"),
            F.col("label_id").cast("string").alias("true_label"),
            model.scored(F.col("terms")).cast("string").alias("pred_label"),
        )
        found = macro_f1_observed(predictions).first()
        score = float(found["macro_f1_observed"]) if found else 0.0
        log.append((0, epoch, loss, score))
        if score > best_score:
            best, best_score, waited = model, score, 0
        else:
            waited += 1
            if 0 < settings.patience <= waited:
                break
    return best, train.sparkSession.createDataFrame(log, "run_id bigint, epoch bigint, train_loss double, val_f1 double")


def save_model(model: SoftmaxModel, path: str) -> None:
    model.save(SparkSession.active(), path)


def load_model(path: str) -> SoftmaxModel:
    return SoftmaxModel.load(SparkSession.active(), path)
