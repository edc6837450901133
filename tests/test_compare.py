from golden import FEW_SHOT, ZERO_SHOT, pairs
from textbench.operators import compare as C
from textbench.sources import reports as RP


def test_ranking_and_ties(frame):
    df = frame(pairs(ZERO_SHOT), "b").union(frame(pairs(ZERO_SHOT), "a")).union(frame(pairs(FEW_SHOT), "c"))
    given = [r["model"] for r in C.compare_models(df, ["b", "a", "c"]).orderBy("rank").collect()]
    by_name = [r["model"] for r in C.compare_models(df).orderBy("rank").collect()]
    assert given == ["c", "b", "a"] and by_name == ["c", "a", "b"]


def test_models_outside_the_order_come_last(frame):
    df = frame(pairs(ZERO_SHOT), "zz").union(frame(pairs(ZERO_SHOT), "a"))
    assert [r["model"] for r in C.compare_models(df, ["zz"]).orderBy("rank").collect()] == ["zz", "a"]


def test_every_pair_of_better_and_worse(frame):
    df = frame(pairs(ZERO_SHOT), "zero").union(frame(pairs(FEW_SHOT), "few"))
    got = C.all_improvements(C.compare_models(df, ["zero", "few", "none"])).collect()
    assert {(r["better"], r["worse"]) for r in got} == {
        ("few", "zero"), ("few", "none"), ("zero", "none"), *((m, "random guess") for m in ("few", "zero", "none")),
    }
    assert [round(r["points"], 2) for r in got if (r["better"], r["worse"]) == ("few", "zero")] == [round(11.1820 - 5.3221, 2)]


def test_comparison_shows_the_row_counts(frame):
    df = frame(pairs(ZERO_SHOT), "zero").union(frame(pairs(FEW_SHOT)[:40], "few"))
    assert {r["model"]: r["n"] for r in C.compare_models(df).collect()} == {"zero": 100, "few": 40}


def test_improvement(frame):
    df = frame(pairs(ZERO_SHOT), "zero").union(frame(pairs(FEW_SHOT), "few"))
    got = {r["baseline"]: r for r in C.model_improvement(C.compare_models(df)).collect()}
    assert set(got) == {"zero", "random guess"}
    assert got["zero"]["candidate"] == "few"
    assert round(got["zero"]["points"], 2) == round(11.1820 - 5.3221, 2)
    assert round(got["zero"]["ratio"], 3) == round(0.111820 / 0.053221, 3)
    assert round(got["random guess"]["points"], 2) == round(11.1820 - 100 / 6, 2)
    chosen = C.model_improvement(C.compare_models(df), "zero").collect()
    assert {(r["candidate"], r["baseline"]) for r in chosen} == {("zero", "few"), ("zero", "random guess")}


def test_pairs_share_only_common_rows(spark):
    data = [
        ("a", 1, "joy", "joy"), ("a", 2, "joy", "love"), ("a", 3, "fear", "fear"), ("a", 4, "fear", "odd"), ("a", None, "joy", "joy"),
        ("b", 2, "joy", "love"), ("b", 3, "fear", "joy"), ("b", 4, "fear", "fear"), ("b", 5, "joy", "joy"),
    ]
    df = spark.createDataFrame(data, "model string, row_id bigint, true_label string, pred_label string")
    row = C.paired_predictions(df, ["a", "b"]).first().asDict()
    assert row == {
        "model_a": "a", "model_b": "b", "n_a": 4, "n_b": 4, "n_both": 3,
        "both_right": 0, "only_a": 1, "only_b": 1, "both_wrong": 1, "agreement": 1 / 3,
    }


def test_three_models_make_three_pairs(spark):
    data = [(m, i, "joy", "joy" if i < n else "love") for m, n in (("x", 3), ("y", 2), ("z", 0)) for i in range(4)]
    df = spark.createDataFrame(data, "model string, row_id bigint, true_label string, pred_label string")
    got = {(r["model_a"], r["model_b"]): (r["both_right"], r["only_a"], r["only_b"], r["both_wrong"]) for r in C.paired_predictions(df, ["x", "y", "z"]).collect()}
    assert got == {("x", "y"): (2, 1, 0, 1), ("x", "z"): (0, 3, 0, 1), ("y", "z"): (0, 2, 0, 2)}


def test_report_text(frame, spark, tmp_path):
    df = frame(pairs(ZERO_SHOT), "zero").union(frame(pairs(FEW_SHOT), "a model with a rather long name"))
    lines = RP.comparison_report(C.compare_models(df))
    got = [r["line"] for r in lines.orderBy("line_no").collect()]
    assert got[0] == got[2] == got[-1] == "=" * 60
    assert got[6] == "a model with a rather long name 0.1118 " + "█" * 4
    assert got[7] == f"{'zero':20s} 0.0532 " + "█" * 2
    assert "a model with a rather long name" in got[-3]
    RP.write_report(lines, str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == got


def test_bar_is_cut_not_rounded(spark):
    from pyspark.sql import functions as F

    line = spark.range(1).select(RP.comparison_line(F.lit("tuned"), F.lit(0.6396)).alias("x")).first()["x"]
    assert line == f"{'tuned':20s} 0.6396 " + "█" * 25


def test_metrics_report_text(frame):
    got = [r["line"] for r in RP.metrics_report(frame(pairs(FEW_SHOT))).orderBy("line_no").collect()]
    assert got[:8] == [
        "=" * 50, "EVALUATION METRICS", "=" * 50, "", "Accuracy: 0.2400", "Macro F1: 0.1118", "Micro F1: 0.2400", "Weighted F1: 0.1677",
    ]
    assert got[13:19] == ["joy:", "  Precision: 0.2278", "  Recall: 0.9474", "  F1: 0.3673", "  Support: 19", ""]
    assert len(got) == 13 + 6 * 6


def test_saved_predictions_are_compared(frame, spark, tmp_path):
    from pyspark.sql import functions as F

    from textbench.plans.comparison import compare_saved
    from textbench.sources.tables import write_predictions

    paths = {m: str(tmp_path / m) for m in ("zero", "few", "absent")}
    for model, cells in (("zero", ZERO_SHOT), ("few", FEW_SHOT)):
        write_predictions(frame(pairs(cells), model).withColumn("text", F.lit('a "text"\nin two lines')), paths[model])
    ranking, lines, missing = compare_saved(spark, paths, str(tmp_path / "report"))
    assert missing == ["absent"]
    assert [(r["model"], round(r["macro_f1"], 4)) for r in ranking.orderBy("rank").collect()] == [("few", 0.1118), ("zero", 0.0532)]
    assert spark.read.text(str(tmp_path / "report")).count() == lines.count() == 13
