import math
from collections import Counter

import pytest
from plans import exchanged
from pyspark.sql import functions as F

from textbench.fixed import LABELS
from textbench.operators import tokens as TK
from textbench.operators.generation import generate, generate_stored, stored_outputs
from textbench.operators.labels import resolve_labels
from textbench.operators.predictions import baseline_predictions, parse_counts, parse_outputs
from textbench.plans.prompted import prompted_predictions
from textbench.plans import prompted as PR

TEXTS = ["the cat the dog", "a cat", "", None, "dog dog DOG bird"]


def frame(spark, texts=TEXTS, labels=None):
    data = [(i, t, (labels or ["joy"] * len(texts))[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "row_id bigint, text string, label string")


def test_vocabulary(spark):
    got = [(r["token"], r["token_id"], r["n"]) for r in TK.token_vocabulary(frame(spark), 4).orderBy("token_id").collect()]
    assert got == [("dog", 2, 4), ("cat", 3, 2), ("the", 4, 2), ("a", 5, 1)]


def test_encoding(spark):
    df = frame(spark)
    got = TK.encode_tokens(df, TK.token_vocabulary(df, 3), 5).orderBy("row_id").collect()
    assert [r["input_ids"] for r in got] == [[4, 3, 4, 2, 0], [1, 3, 0, 0, 0], [0] * 5, [1, 0, 0, 0, 0], [2, 2, 2, 1, 0]]
    assert [sum(r["attention_mask"]) for r in got] == [4, 2, 0, 1, 4]
    cut = TK.encode_tokens(df, TK.token_vocabulary(df, 3), 2).orderBy("row_id").collect()
    assert [r["input_ids"] for r in cut] == [[4, 3], [1, 3], [0, 0], [1, 0], [2, 2]]


def test_vocabulary_with_many_equal_counts(spark):
    texts = ["b a d c " * 3, "z y x w v u t", "q"]
    got = [r["token"] for r in TK.token_vocabulary(frame(spark, texts), 7).orderBy("token_id").collect()]
    assert got == ["a", "b", "c", "d", "q", "t", "u"]
    assert TK.token_vocabulary(frame(spark, texts), 100).count() == 12


def test_key_tokens(spark):
    texts, labels = ["x x y", "y z", "z z z"], ["a", "b", "b"]
    counts = {"a": Counter("xxy"), "b": Counter("yzzzz")}
    total = {c: sum(n.values()) for c, n in counts.items()}

    def score(c, t):
        o = "b" if c == "a" else "a"
        inside = (counts[c][t] + 1) / (total[c] - counts[c][t] + 1)
        outside = (counts[o][t] + 1) / (total[o] - counts[o][t] + 1)
        return round(math.log(inside) - math.log(outside), 6)

    got = {(r["label"], r["rank"]): (r["token"], r["n"], r["score"]) for r in TK.key_tokens(frame(spark, texts, labels), ["a", "b"], 2).collect()}
    for label in "ab":
        best = sorted(((-score(label, t), t, n) for t, n in counts[label].items()))[:2]
        for rank, (s, t, n) in enumerate(best, 1):
            assert got[(label, rank)] == (t, n, pytest.approx(-s, abs=1e-6))


def picky():
    def answer(prompts):
        if prompts.str.contains("bad").any():
            raise RuntimeError("a prompt was refused")
        return prompts.str.upper()

    return answer


def test_only_failing_prompts_fall_back(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "good")], "row_id bigint, prompt string").coalesce(1)
    got = {r["row_id"]: r["raw_output"] for r in generate(df, picky()).collect()}
    assert got == {1: "FINE", 2: "neutral", 3: "GOOD"}


def echo():
    def answer(prompts):
        return prompts.map(lambda p: p + (" FEAR\n" if "dog" in p else " joy, not fear"))

    return answer


def test_prompted_predictions(spark):
    df = frame(spark, labels=["joy", "fear", "surprise", None, "love"])
    got = {r["row_id"]: r for r in PR.prompted_predictions(df, echo(), "m", "zero-shot").collect()}
    assert {i: r["pred_label"] for i, r in got.items()} == {0: "fear", 1: "joy", 2: "joy", 3: "joy", 4: "fear"}
    assert {i: r["true_label"] for i, r in got.items()} == {0: "joy", 1: "fear", 2: "joy", 3: "joy", 4: "love"}
    assert got[0]["raw_output"] == "FEAR" and got[3]["text"] == "nan"
    limited = PR.prompted_predictions(df, echo(), "m", "few-shot", max_samples=2)
    assert sorted(r["row_id"] for r in limited.collect()) == [0, 1]


def test_prompted_evaluation(spark):
    df = frame(spark, labels=["fear", "joy", "joy", "joy", "love"])
    f1, report = PR.prompted_evaluation(PR.prompted_predictions(df, echo(), "m"))
    assert f1.first()["macro_f1"] == pytest.approx((1 + 2 / 3) / 6)
    assert report.count() == 9


def test_generation_runs_once(spark, tmp_path):
    """Two metrics over one prediction table: every prompt is generated a single time."""
    marks = str(tmp_path)

    def counting():
        def answer(prompts):
            import os
            import uuid

            for _ in prompts:
                open(os.path.join(marks, uuid.uuid4().hex), "w").close()
            return prompts

        return answer

    f1, report = PR.prompted_evaluation(PR.prompted_predictions(frame(spark), counting(), "m"))
    f1.collect(), report.collect()
    assert len(list(tmp_path.iterdir())) == len(TEXTS)


def test_parse_counts(spark):
    df = spark.createDataFrame([("m", "joy"), ("m", "pain"), ("m", "joy or love"), ("m", None)], "model string, raw_output string")
    got = {(r["pred_label"], r["n_found"]): r["n"] for r in parse_counts(parse_outputs(df)).collect()}
    assert got == {("joy", 1): 1, ("joy", 2): 1, ("neutral", 0): 2}


def test_baselines_encode_labels_as_everywhere(spark):
    data = [(0, None, "train"), (1, None, "train"), (2, "odd", "train"), (3, "fear", "train"), (4, "odd", "test"), (5, None, "test")]
    df = spark.createDataFrame(data, "row_id bigint, label string, split string")
    got = baseline_predictions(df, 1).filter("model = 'majority'").orderBy("row_id").collect()
    # missing and unlisted labels are class 0, three of four training rows
    assert [(r["true_label"], r["pred_label"]) for r in got] == [("joy", "joy"), ("joy", "joy")]
    derived = baseline_predictions(df, 1, mapping=resolve_labels(df)).filter("model = 'majority'").orderBy("row_id").collect()
    assert [(r["true_label"], r["pred_label"]) for r in derived] == [("odd", "nan"), ("nan", "nan")]


def test_prompts_are_spread_over_tasks(spark):
    df = spark.range(1200).selectExpr("id as row_id", "concat('t', id) as text", "'joy' as label")

    def echo(prompts):
        from pyspark import TaskContext

        return prompts.map(lambda p: f"joy {TaskContext.get().partitionId()}")

    got = prompted_predictions(df, echo, "m", max_samples=1000, continuation=True).collect()
    assert len(got) == 1000 and len({r["raw_output"] for r in got}) > 5
    bounded = prompted_predictions(df, echo, "m", continuation=True, tasks=3).collect()
    assert len(bounded) == 1200 and len({r["raw_output"] for r in bounded}) <= 3


def noting(marks, killed_by=None):
    """Notes each prompt in a file of its own; ends the worker at the prompt ``killed_by``."""

    def answer(prompts):
        import os
        import uuid

        for p in prompts:
            if p == killed_by:
                os._exit(1)
            with open(os.path.join(marks, uuid.uuid4().hex), "w") as file:
                file.write(p)
        return prompts.str.upper()

    return answer


def test_a_second_run_asks_what_the_first_left(spark, tmp_path):
    """A task is killed; what the others have answered is not asked again."""
    rows = [(i, f"p{i % 40}") for i in range(120)]
    df = spark.createDataFrame(rows, "row_id bigint, prompt string").repartition(4)
    store, (first, second) = str(tmp_path / "store"), (tmp_path / "1", tmp_path / "2")
    first.mkdir(), second.mkdir()
    with pytest.raises(Exception, match="(?i)worker|crash|abort"):
        generate_stored(df, noting(str(first), "p17"), store, prompts_per_task=5)
    kept = {r["output"].lower() for r in stored_outputs(spark, store).collect()}
    assert 0 < len(kept) < 40
    got = generate_stored(df, noting(str(second)), store, prompts_per_task=5).collect()
    assert sorted((r["row_id"], r["raw_output"]) for r in got) == sorted((i, p.upper()) for i, p in rows)
    asked = sorted(f.read_text() for f in second.iterdir())
    assert asked == sorted({p for _, p in rows} - kept)  # each missing prompt, once
    third = tmp_path / "3"
    third.mkdir()
    assert generate_stored(df, noting(str(third)), store).count() == 120
    assert not list(third.iterdir())


def test_refused_prompts_are_asked_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, None), (4, "good")], "row_id bigint, prompt string")
    store = str(tmp_path / "store")
    got = {r["row_id"]: r["raw_output"] for r in generate_stored(df, picky(), store).collect()}
    assert {k: got[k] for k in (1, 2, 4)} == {1: "GOOD", 2: "neutral", 4: "GOOD"}
    later = lambda prompts: prompts.map(lambda p: "now")
    got = {r["row_id"]: r["raw_output"] for r in generate_stored(df, later, store).collect()}
    assert {k: got[k] for k in (1, 2, 4)} == {1: "GOOD", 2: "now", 4: "GOOD"}
    assert generate_stored(df.limit(0), picky(), str(tmp_path / "none")).count() == 0


def test_encoding_moves_no_text(spark):
    df = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate([*TEXTS, None, "", "b a c"])], "row_id bigint, text string, label_id int")
    encoded = TK.encode_tokens(df, TK.token_vocabulary(df, 3), 5, columns=["label_id"])
    moved = exchanged(encoded)
    assert moved and not any("text" in columns for columns in moved)
    got = {r["row_id"]: r for r in encoded.collect()}
    assert len(got) == df.count()
    assert {i: r["label_id"] for i, r in got.items()} == {r["row_id"]: r["label_id"] for r in df.collect()}
    assert all(len(r["input_ids"]) == len(r["attention_mask"]) == 5 for r in got.values())


def test_key_tokens_of_thousands_of_labels(spark):
    df = spark.range(30_000).selectExpr("concat('l', id % 3000) as label", "concat('own', id % 3000 % 26, ' shared tok', id % 7) as text")
    df = df.withColumn("text", F.translate("text", "0123456789", "abcdefghij"))
    got = TK.key_tokens(df, None, 2).collect()
    assert len({r["label"] for r in got}) == 3000 and max(r["rank"] for r in got) == 2
    some = TK.key_tokens(df, [f"l{i}" for i in range(2500)], 1)
    assert some.count() == 2500


def test_prompted_true_labels_stay(spark):
    data = [(0, "a", "surprise", "train"), (1, "b", "joy", "train"), (2, "c", "surprise", "test"), (3, "d", "late", "test")]
    df = spark.createDataFrame(data, "row_id bigint, text string, label string, split string")
    answer = lambda prompts: prompts.map(lambda p: "joy\n\nEmotion: anger")
    test = df.filter("split = 'test'")
    whole = prompted_predictions(test, answer, "m", mapping=resolve_labels(df), continuation=True).orderBy("row_id").collect()
    assert [(r["true_label"], r["pred_label"]) for r in whole] == [("surprise", "joy"), ("joy", "joy")]
    cut = prompted_predictions(test, answer, "m").orderBy("row_id").collect()
    assert [(r["true_label"], r["pred_label"]) for r in cut] == [("joy", "anger"), ("joy", "anger")]


def test_baselines(spark):
    labels = ["love", "fear"] * 5 + ["joy"]
    data = [(i, x, "train") for i, x in enumerate(labels)] + [(100 + i, "joy", "test") for i in range(300)]
    got = baseline_predictions(spark.createDataFrame(data, "row_id bigint, label string, split string"), 1).collect()
    # fear and love are equally frequent: the lower class id wins
    assert {r["pred_label"] for r in got if r["model"] == "majority"} == {"fear"}
    uniform = Counter(r["pred_label"] for r in got if r["model"] == "uniform")
    assert set(uniform) == set(LABELS) and all(25 < n < 80 for n in uniform.values()) and len(got) == 600
