"""Queries over the test tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench import fixtures as X
from textbench.fixed import LABELS
from textbench.functions import logits as L
from textbench.functions.labels import decode_label, encode_label
from textbench.functions.parsing import extract_response
from textbench.functions.prompts import build_prompt
from textbench.operators import balance as B
from textbench.operators import compare as C
from textbench.operators import epochs as E
from textbench.operators import labels as LB
from textbench.operators import losses as LO
from textbench.operators import metrics as M
from textbench.operators import predictions as P
from textbench.operators import rows as R
from textbench.operators import tokens as TK
from textbench.operators.generation import generate
from textbench.operators.generation import generate_stored as generate_with_store
from textbench.plans import prompted as PR
from textbench.plans import training as TR
from textbench.session import work_dir
from textbench.sources import reports as RP
from textbench.sources import tables as S

K = len(LABELS)
SEED = 42
ALPHA = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
VOCABULARY = 5000
MAX_LENGTH = 256
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines can be compared by value."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({name: F.round(F.col(name), digits) for name in doubles})


def encoded(spark, d, dirty: bool = False) -> DataFrame:
    frame = X.labelled_dirty(spark, d) if dirty else X.labelled(spark, d)
    return LB.encode_table(frame)


def train_rows(spark, d) -> DataFrame:
    return encoded(spark, d).filter(F.col("split") == "train")


# -- sources and sinks --------------------------------------------------------


@query
def read_labelled(spark, d):
    path = work_dir(spark)
    S.write_labelled(X.labelled_dirty(spark, d), path)
    rows = S.read_labelled(spark, path, keep=["row_id"])
    return rows.withColumn("row_id", F.col("row_id").cast("bigint"))


@query
def read_splits(spark, d):
    base = work_dir(spark)
    paths = {s: f"{base}/{s}" for s in ("train", "val", "test")}
    for split, path in paths.items():
        S.write_labelled(X.labelled_dirty(spark, d).filter(F.col("split") == split).drop("split"), path)
    rows = S.read_splits(spark, paths)
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("text") == "nan").alias("n_missing")
    )


def _saved_models(spark, d, models):
    base = work_dir(spark)
    paths = {m: f"{base}/{m}" for m in X.MODELS}
    for m in models:
        S.write_predictions(X.predictions(spark, d).filter(F.col("model") == m), paths[m], keep=["row_id"])
    return paths


@query
def read_predictions(spark, d):
    paths = _saved_models(spark, d, ["tuned"])
    rows = S.read_predictions(spark, paths["tuned"], "tuned", keep=["row_id"])
    return rows.withColumn("row_id", F.col("row_id").cast("bigint"))


@query
def read_available_predictions(spark, d):
    paths = _saved_models(spark, d, ["tuned", "few"])
    rows, _ = S.read_available_predictions(spark, paths, keep=["row_id"])
    return rows.withColumn("row_id", F.col("row_id").cast("bigint"))


@query
def write_predictions(spark, d):
    path = work_dir(spark)
    S.write_predictions(P.parse_outputs(X.raw_outputs(spark, d)), path, keep=["model", "row_id"])
    saved = S.read_table(spark, path)
    return saved.select(
        "model",
        F.col("row_id").cast("bigint").alias("row_id"),
        "text",
        "true_label",
        "pred_label",
        F.coalesce("raw_output", F.lit("")).alias("raw_output"),
    )


@query
def metrics_report(spark, d):
    return RP.metrics_report(X.predictions(spark, d))


@query
def comparison_report(spark, d):
    return RP.comparison_report(C.compare_models(X.predictions(spark, d), X.MODELS))


# -- projections, predicates, scalar functions ---------------------------------


@query
def encode_label_(spark, d):
    return encoded(spark, d, dirty=True).select("row_id", "label", "label_id", "known")


@query
def encode_label_resolved(spark, d):
    """With the vocabulary that the data themselves decide on."""
    rows = X.labelled_dirty(spark, d)
    return LB.encode_by_mapping(rows, LB.resolve_labels(rows)).select("row_id", "label", "label_id", "known")


@query
def decode_label_(spark, d):
    scored = LO.score_logits(X.logits(spark, d), K)
    return scored.select("row_id", decode_label(F.col("y")).alias("true_label"), decode_label(F.col("pred")).alias("pred_label"))


@query
def label_in_range(spark, d):
    raw = X.labelled_dirty(spark, d).withColumn(
        "label_id", F.coalesce(encode_label(F.col("label"), unknown="null"), F.lit(-1).cast("bigint"))
    )
    return LB.label_in_range(raw, K).select("row_id", "label", "label_id")


@query
def build_prompt_zero(spark, d):
    return X.labelled_dirty(spark, d).select("row_id", build_prompt(F.col("text"), "zero-shot").alias("prompt"))


@query
def build_prompt_few(spark, d):
    return X.labelled_dirty(spark, d).select("row_id", build_prompt(F.col("text"), "few-shot").alias("prompt"))


@query
def extract_response_(spark, d):
    return X.raw_outputs(spark, d).select("model", "row_id", extract_response(F.col("raw_output")).alias("response"))


@query
def parse_outputs(spark, d):
    return P.parse_outputs(X.raw_outputs(spark, d)).select("model", "row_id", "true_label", "pred_label", "n_found")


@query
def parse_counts(spark, d):
    return P.parse_counts(P.parse_outputs(X.raw_outputs(spark, d)))


@query
def truncate_output(spark, d):
    return P.truncate_output(X.raw_outputs(spark, d)).select("model", "row_id", "text", "raw_output")


@query
def encode_tokens(spark, d):
    rows = X.labelled(spark, d)
    vocabulary = TK.token_vocabulary(rows.filter(F.col("split") == "train"), VOCABULARY)
    encoded_rows = TK.encode_tokens(rows, vocabulary, MAX_LENGTH)
    return encoded_rows.select(
        "row_id",
        F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"),
        F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), " ").alias("attention_mask"),
    )


@query
def score_logits(spark, d):
    scored = LO.score_logits(X.logits(spark, d), K)
    p = [F.col("probabilities")[i].alias(f"p_{label}") for i, label in enumerate(LABELS)]
    return rounded(scored.select("row_id", "y", "pred", "p_true", *p))


@query
def score_counts(spark, d):
    return LO.score_counts(LO.score_logits(X.logits(spark, d), K))


@query
def cross_entropy(spark, d):
    z = X.logits(spark, d)
    smooth = L.cross_entropy(F.col("z"), F.col("y"), K, 0.1)
    return rounded(z.select("row_id", "y", L.cross_entropy(F.col("z"), F.col("y"), K).alias("loss"), smooth.alias("loss_smoothed")))


@query
def focal_loss(spark, d):
    z = X.logits(spark, d)
    return rounded(
        z.select(
            "row_id",
            "y",
            L.focal_loss(F.col("z"), F.col("y"), K).alias("loss"),
            L.focal_loss(F.col("z"), F.col("y"), K, 2.0, ALPHA, 0.1).alias("loss_alpha_smoothed"),
        )
    )


# -- joins ----------------------------------------------------------------------


@query
def zero_filled_counts(spark, d):
    """With a seventh label that no row has."""
    return B.zero_filled_counts(encoded(spark, d).groupBy("label_id").agg(F.count("*").alias("n")), [*LABELS, "surprise"])


@query
def attach_class_weight(spark, d):
    train = train_rows(spark, d)
    return rounded(B.attach_class_weight(train, B.class_weights(train)).select("row_id", "label", "label_id", "weight"))


@query
def paired_predictions(spark, d):
    return rounded(C.paired_predictions(X.predictions(spark, d), X.MODELS))


# -- aggregations -----------------------------------------------------------------


@query
def class_counts(spark, d):
    return B.class_counts(encoded(spark, d, dirty=True))


@query
def class_distribution(spark, d):
    return B.class_distribution(X.labelled(spark, d))


@query
def class_weights(spark, d):
    return rounded(B.class_weights(train_rows(spark, d)))


@query
def sampling_weights(spark, d):
    return rounded(B.sampling_weights(train_rows(spark, d)))


@query
def confusion_matrix(spark, d):
    return M.confusion_matrix(X.predictions(spark, d))


@query
def confusion_matrix_wide(spark, d):
    return M.confusion_matrix_wide(X.predictions(spark, d))


@query
def accuracy(spark, d):
    return rounded(M.accuracy(X.predictions(spark, d)))


@query
def per_class_metrics(spark, d):
    return rounded(M.per_class_metrics(X.predictions(spark, d)))


@query
def macro_f1(spark, d):
    return rounded(M.macro_f1(X.predictions(spark, d)))


@query
def observed_metrics(spark, d):
    return rounded(M.observed_metrics(X.predictions(spark, d)))


@query
def macro_f1_observed(spark, d):
    return rounded(M.macro_f1_observed(X.predictions(spark, d)))


@query
def micro_f1(spark, d):
    """Over the list without its last label, where it differs from the accuracy."""
    return rounded(M.micro_f1(X.predictions(spark, d), LABELS[:-1]))


@query
def weighted_f1(spark, d):
    return rounded(M.weighted_f1(X.predictions(spark, d)))


@query
def metrics_summary(spark, d):
    return rounded(M.metrics_summary(X.predictions(spark, d)))


@query
def classification_report(spark, d):
    return M.classification_report(X.predictions(spark, d))


@query
def classification_report_partial(spark, d):
    return M.classification_report(X.predictions(spark, d), LABELS[:-1])


@query
def evaluate_predictions(spark, d):
    return rounded(M.evaluate_predictions(X.predictions(spark, d)))


@query
def compare_models(spark, d):
    return rounded(C.compare_models(X.predictions(spark, d), X.MODELS))


@query
def model_improvement(spark, d):
    return rounded(C.model_improvement(C.compare_models(X.predictions(spark, d), X.MODELS)), 4)


@query
def mean_loss(spark, d):
    return rounded(LO.mean_loss(LO.focal_loss(X.logits(spark, d), K)))


@query
def weighted_mean_loss(spark, d):
    z = X.logits(spark, d)
    weights = B.class_weights(z.withColumn("label_id", F.col("y")))
    return rounded(LO.weighted_mean_loss(LO.cross_entropy(z, K), weights))


@query
def epoch_loss(spark, d):
    return rounded(E.epoch_loss(X.batch_log(spark, d)))


@query
def token_vocabulary(spark, d):
    return TK.token_vocabulary(X.labelled(spark, d), VOCABULARY)


# -- windows ------------------------------------------------------------------------


@query
def running_epoch_loss(spark, d):
    return rounded(E.running_epoch_loss(X.batch_log(spark, d)))


@query
def best_epoch(spark, d):
    return E.best_epoch(X.epoch_log(spark, d))


@query
def early_stop(spark, d):
    return E.early_stop(X.epoch_log(spark, d), patience=2)


@query
def key_tokens(spark, d):
    rows = X.trainable(spark, d)
    return TK.key_tokens(rows, None, top=10)


# -- sort, limit, sets, sampling -------------------------------------------------------


@query
def row_ordinal(spark, d):
    return R.row_ordinal(X.table(spark, d, "documents")).select("doc_id", "ordinal")


@query
def row_ordinal_by_key(spark, d):
    events = X.table(spark, d, "events").select("event_id", "user_id")
    return R.ordinal_within(events, "event_id", ["user_id"])


@query
def first_n(spark, d):
    return R.first_n(X.labelled(spark, d), 100).select("row_id", "text", "label")


@query
def first_n_all(spark, d):
    return R.first_n(X.labelled(spark, d), 0).select("row_id", "label")


@query
def label_union(spark, d):
    return LB.label_union(X.labelled_dirty(spark, d))


@query
def unseen_labels(spark, d):
    return LB.unseen_labels(X.labelled_dirty(spark, d))


@query
def label_mapping(spark, d):
    return LB.label_mapping(X.labelled_dirty(spark, d).filter(F.col("split") == "train"))


@query
def resolve_labels(spark, d):
    return LB.resolve_labels(X.labelled_dirty(spark, d))


@query
def resolve_labels_listed(spark, d):
    return LB.resolve_labels(X.labelled(spark, d))


@query
def shuffle_rows(spark, d):
    return R.shuffle_rows(X.labelled(spark, d).filter(F.col("split") == "train"), SEED).select(
        "sort_key", "row_id", "text", "label"
    )


@query
def weighted_sample(spark, d):
    return B.weighted_sample(train_rows(spark, d), SEED)


# -- training and scoring ------------------------------------------------------------------


def _trained(spark, d):
    rows = X.trainable(spark, d)
    return TR.train_classifier(rows.filter(F.col("split") == "train"), TR.label_list(rows))


def _test_rows(spark, d):
    return X.trainable(spark, d).filter(F.col("split") == "test")


def _confusion(model, rows: DataFrame) -> DataFrame:
    return M.confusion_matrix(TR.predict_table(model, rows))


@query
def train_classifier(spark, d):
    """Confusion table on the training rows of a model fitted here."""
    return _confusion(_trained(spark, d), X.trainable(spark, d).filter(F.col("split") == "train"))


@query
def select_by_validation(spark, d):
    """The log, a row per pass, and which epoch ``early_stop`` takes."""
    rows = X.trainable(spark, d)
    train, val = (rows.filter(F.col("split") == s) for s in ("train", "val"))
    _, log = TR.select_by_validation(train, val, TR.label_list(rows))
    chosen = E.early_stop(log, TR.Settings().patience)
    return rounded(log.join(chosen, "run_id").select("epoch", "train_loss", "val_f1", "best_epoch", "best_f1", "stopped_early"))


@query
def predict_table(spark, d):
    return TR.predict_table(_trained(spark, d), _test_rows(spark, d)).select("row_id", "true_label", "pred_label")


@query
def evaluate_split(spark, d):
    """The report on the test split, with the macro-F1 over observed labels as a row of its own."""
    score, report = TR.evaluate_split(_trained(spark, d), _test_rows(spark, d))
    macro = score.select(F.lit("macro_f1_observed").alias("label"), F.col("macro_f1_observed").alias("f1"))
    return report.unionByName(macro, allowMissingColumns=True)


def _differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, n_differing) of two tables of predictions, row by row."""
    both = a.select("row_id", "pred_label").join(b.select("row_id", F.col("pred_label").alias("other")), "row_id", "full")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("pred_label").eqNullSafe(F.col("other"))).alias("n_differing"))


@query
def save_model(spark, d):
    """Whether a saved model, read back, predicts as the one in memory."""
    model, path = _trained(spark, d), work_dir(spark)
    TR.save_model(model, path)
    test = _test_rows(spark, d)
    return _differences(TR.predict_table(model, test), TR.predict_table(TR.load_model(path), test))


@query
def load_model(spark, d):
    """Confusion table on the test rows of a saved model, read back."""
    path = work_dir(spark)
    TR.save_model(_trained(spark, d), path)
    return _confusion(TR.load_model(path), _test_rows(spark, d))


@query
def baseline_predictions(spark, d):
    return P.baseline_predictions(X.labelled(spark, d), SEED)


def stub_generator():
    """Stands in for a language model: repeats the prompt and adds an answer chosen by its length.

    Made of inner functions, which travel to the workers by value.
    """
    answers = ["joy", "SADNESS\n\nExplanation: sad", "no idea", "love, not anger", " neutral ", "fear"]

    def continue_prompts(prompts):
        return prompts.map(lambda p: p + answers[len(p) % len(answers)])

    return continue_prompts


def refusing_generator():
    """Fails for every prompt."""

    def refuse(prompts):
        raise RuntimeError("a prompt was asked")

    return refuse


@query
def baseline_predictions_unlisted(spark, d):
    """Where the data have missing texts and a label that is not listed."""
    rows = X.labelled_dirty(spark, d)
    return P.baseline_predictions(rows, SEED, mapping=LB.resolve_labels(rows))


@query
def generate_(spark, d):
    prompts = X.labelled(spark, d).select("row_id", build_prompt(F.col("text"), "few-shot").alias("prompt"))
    return generate(prompts, stub_generator()).select("row_id", "raw_output")


@query
def generate_stored(spark, d):
    """Outputs that a store keeps; a second call finds them all there."""
    prompts = X.labelled(spark, d).select("row_id", build_prompt(F.col("text"), "few-shot").alias("prompt"))
    store = work_dir(spark)
    asked_again = refusing_generator()
    generate_with_store(prompts, stub_generator(), store)
    return generate_with_store(prompts, asked_again, store).select("row_id", "raw_output")


def _prompted(spark, d):
    test = X.labelled(spark, d).filter(F.col("split") == "test")
    return PR.prompted_predictions(test, stub_generator(), "stub", "few-shot")


@query
def prompted_predictions(spark, d):
    return _prompted(spark, d)


@query
def prompted_evaluation(spark, d):
    return PR.prompted_evaluation(_prompted(spark, d))[1]


def _prompted_unlisted(spark, d):
    rows = X.labelled_dirty(spark, d)
    test = rows.filter(F.col("split") == "test")
    return PR.prompted_predictions(test, stub_generator(), "stub", mapping=LB.resolve_labels(rows))


@query
def prompted_predictions_unlisted(spark, d):
    """Where the data have a label that is not listed, which stays a true label."""
    return _prompted_unlisted(spark, d)


@query
def prompted_evaluation_unlisted(spark, d):
    return PR.prompted_evaluation(_prompted_unlisted(spark, d))[1]


def stub_continuations():
    """Outputs that don't repeat the prompt, some with the marker behind the answer."""
    answers = ["joy\n\nLyric: x\nEmotion: anger", "SADNESS", "no idea", "Emotion: love"]

    def answer(prompts):
        return prompts.map(lambda p: answers[len(p) % len(answers)])

    return answer


@query
def prompted_predictions_continued(spark, d):
    test = X.labelled(spark, d).filter(F.col("split") == "test")
    return PR.prompted_predictions(test, stub_continuations(), "stub", continuation=True)


@query
def all_improvements(spark, d):
    return rounded(C.all_improvements(C.compare_models(X.predictions(spark, d), X.MODELS)), 4)


# a trailing underscore keeps a query apart from the imported function of its name
QUERIES = {name.rstrip("_"): fn for name, fn in QUERIES.items()}
