import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textbench.catalog.oracles import PROMPTS, ZERO_SHOT
from textbench.fixed import LABELS, MISSING_STRINGS
from textbench.functions import labels as LF
from textbench.functions import logits as L
from textbench.functions import parsing as PA
from textbench.functions import prompts as PR
from textbench.functions import text as TX


LIST = "joy, sadness, anger, fear, love, neutral"


def values(spark, data, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_encode_label(spark):
    data = ["joy", "neutral", "surprise", None, "JOY", ""]
    assert values(spark, data, LF.encode_label) == [0, 5, 0, 0, 0, 0]
    assert values(spark, data, lambda c: LF.encode_label(c, unknown="null")) == [0, 5, None, None, None, None]
    assert values(spark, [None, "a"], lambda c: LF.encode_label(c, ["a", "nan"])) == [1, 0]
    assert values(spark, data, LF.is_known_label) == [True, True, False, False, False, False]
    with pytest.raises(PySparkException, match="unknown label: surprise"):
        values(spark, ["surprise"], lambda c: LF.encode_label(c, unknown="error"))
    with pytest.raises(ValueError):
        LF.encode_label(F.lit("joy"), unknown="guess")


def test_decode_label(spark):
    assert values(spark, [0, 5, 6, -1, None], LF.decode_label, "bigint") == ["joy", "neutral", None, None, None]


def test_parse_output(spark):
    data = ["not sadness but joy", "enjoyable", "BELOVED", "pain", "", None, "Not SADNESS", "joy\n\nExplanation: fear"]
    assert values(spark, data, PA.parse_output) == ["joy", "joy", "love", "neutral", "neutral", "neutral", "sadness", "joy"]
    assert values(spark, data, PA.labels_found) == [2, 1, 1, 0, 0, 0, 1, 2]


def test_extract_response(spark):
    data = ["a Emotion: b Emotion:\n joy \t", " no marker ", None, "Emotion:", "x Emotion:　\x1cfear\xa0\n"]
    assert values(spark, data, PA.extract_response) == ["joy", " no marker ", None, "", "fear"]


def test_strip_agrees_with_python(spark):
    rnd = random.Random(1)
    alphabet = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["a", "é", "​", "﻿"]
    data = ["".join(rnd.choice(alphabet) for _ in range(6)) for _ in range(300)]
    assert values(spark, data, TX.strip) == [x.strip() for x in data]


def test_prompts(spark):
    for mode, whole in PROMPTS.items():
        got = values(spark, ["la la", "Emotion: <text>\n", "", None], lambda c, mode=mode: PR.build_prompt(c, mode))
        before, after = whole.split("<text>")
        assert got == [before + x + after for x in ("la la", "Emotion: <text>\n", "", "nan")]
    own = values(spark, ["x"], lambda c: PR.build_prompt(c, "few-shot", ["p", "q"], [("t", "q")]))
    assert own[0].endswith("examples:\n\nLyric: t\nEmotion: q\n\n" + ZERO_SHOT[ZERO_SHOT.index("Classify") :].replace(LIST, "p, q").replace("<text>", "x"))
    with pytest.raises(ValueError):
        PR.build_prompt(F.lit(""), "no-shot")


def test_saved_lengths_count_code_points(spark):
    text = "🙂é" * 125
    assert values(spark, [text, "short", None], TX.saved_text) == [text[:200], "short", None]
    assert values(spark, [text, None], TX.saved_output) == [text[:100], ""]


def test_missing_strings(spark):
    assert values(spark, [*MISSING_STRINGS, None], TX.missing_to_nan) == ["nan"] * (len(MISSING_STRINGS) + 1)
    assert values(spark, [" ", "none", "x"], TX.missing_to_nan) == [" ", "none", "x"]


def test_tokens(spark):
    data = ["Don't STOP, l'Été 2024!", "", None, "日本 x1y"]
    assert values(spark, data, TX.tokens) == [["don", "t", "stop", "l", "été"], [], ["nan"], ["日本", "x", "y"]]


def test_fixed_decimals_agree_with_python(spark):
    data = [a / b for b in range(1, 161) for a in range(b + 1)]
    for digits in (2, 4):
        got = values(spark, data, lambda c: TX.fixed_decimals(c, digits), "double")
        assert got == [f"{x:.{digits}f}" for x in data]


def test_logits(spark):
    rnd = random.Random(2)
    cases = [([rnd.uniform(-5, 5) for _ in range(4)], rnd.randrange(4)) for _ in range(50)] + [([1000.0, 999.0, -1000.0, 0.0], 1)]
    df = spark.createDataFrame([(i, z, y) for i, (z, y) in enumerate(cases)], "i int, z array<double>, y bigint")
    alpha = [0.5, 1.0, 2.0, 4.0]
    z, y = F.col("z"), F.col("y")
    got = df.select(
        "i",
        L.softmax(z, 4).alias("p"),
        L.cross_entropy(z, y, 4).alias("ce"),
        L.cross_entropy(z, y, 4, 0.2).alias("smooth"),
        L.focal_loss(z, y, 4, 1.5, alpha, 0.2).alias("focal"),
        L.predicted_class(z, 4).alias("pred"),
    ).orderBy("i").collect()
    for (scores, true), row in zip(cases, got):
        e = [math.exp(s - max(scores)) for s in scores]
        p = [x / sum(e) for x in e]
        logs = [s - max(scores) - math.log(sum(e)) for s in scores]
        smooth = 0.8 * -logs[true] + 0.2 / 4 * -sum(logs)
        assert row["p"] == pytest.approx(p)
        assert row["ce"] == pytest.approx(-logs[true])
        assert row["smooth"] == pytest.approx(smooth)
        assert row["focal"] == pytest.approx((1 - p[true]) ** 1.5 * smooth * alpha[true])
        assert row["pred"] == scores.index(max(scores))


def test_equal_scores_go_to_the_lowest_class(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>")
    assert df.select(L.predicted_class(F.col("z"), 3).alias("c")).first()["c"] == 1


def test_label_list_is_ordered():
    assert LABELS == ["joy", "sadness", "anger", "fear", "love", "neutral"]
