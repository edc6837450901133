import pytest
from pyspark.errors import AnalysisException

from textbench.sources import tables as S

TEXTS = ['plain', 'two\nlines', 'a "quoted" word', 'comma, here', ' blanks ', 'back\\slash', 'cr\rlf\r\n', '"', "None", None, "é🙂"]


def labelled(spark):
    data = [(i, t, "joy" if i else None, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(data, "row_id bigint, text string, label string, extra string")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    S.write_labelled(labelled(spark).repartition(3), path, fmt)
    got = {int(r["row_id"]): (r["text"], r["label"]) for r in S.read_labelled(spark, path, fmt, keep=["row_id"]).collect()}
    missing = (None, "None") if fmt == "csv" else (None,)  # a typed source has its own missing value
    want = {i: ("nan" if t in missing else t, "joy" if i else "nan") for i, t in enumerate(TEXTS)}
    assert got == want


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('label,other,text\njoy,1,hello\nfear,2,"a\nb ""c"""\n7,3,\n', encoding="utf-8")
    got = [(r["text"], r["label"]) for r in S.read_labelled(spark, str(tmp_path / "a.csv")).collect()]
    assert got == [("hello", "joy"), ('a\nb "c"', "fear"), ("nan", "7")]


def test_splits(spark, tmp_path):
    paths = {}
    for split, n in (("train", 3), ("val", 2)):
        (tmp_path / f"{split}.csv").write_text("text,label\n" + "x,joy\n" * n)
        paths[split] = str(tmp_path / f"{split}.csv")
    df = S.read_splits(spark, paths)
    assert {r["split"]: r["n"] for r in S.split_counts(df).collect()} == {"train": 3, "val": 2}
    S.write_splits(df, str(tmp_path / "by_split"))
    back = S.read_table(spark, str(tmp_path / "by_split"), "parquet")
    assert back.filter("split = 'val'").count() == 2


def test_predictions_are_cut_and_read_back(spark, tmp_path):
    data = [("t" * 300, "joy", "fear", 'long "output"\n' * 20), ("short", "joy", "joy", None)]
    df = spark.createDataFrame(data, "text string, true_label string, pred_label string, raw_output string")
    path = str(tmp_path / "p")
    S.write_predictions(df, path)
    saved = {r["pred_label"]: r for r in S.read_table(spark, path).collect()}
    assert saved["fear"]["text"] == "t" * 200 and saved["fear"]["raw_output"] == ('long "output"\n' * 20)[:100]
    assert saved["joy"]["raw_output"] is None
    assert sorted(tuple(r) for r in S.read_predictions(spark, path, "m").collect()) == [("m", "joy", "fear"), ("m", "joy", "joy")]


def test_three_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", "joy", "joy")], "text string, true_label string, pred_label string")
    S.write_predictions(df, str(tmp_path / "p"))
    assert S.read_table(spark, str(tmp_path / "p")).columns == ["text", "true_label", "pred_label"]


def test_missing_models_are_left_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,true_label,pred_label\nx,joy,joy\n")
    paths = {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "nothing.csv")}
    df, missing = S.read_available_predictions(spark, paths)
    assert missing == ["b"] and [r["model"] for r in df.collect()] == ["a"]
    with pytest.raises(FileNotFoundError):
        S.read_available_predictions(spark, {"b": paths["b"]})
    (tmp_path / "c.csv").write_text("something\n1\n")
    with pytest.raises(AnalysisException):
        S.read_available_predictions(spark, {"c": str(tmp_path / "c.csv")})[0].collect()


def test_models_without_a_key_are_paired_by_position(spark, tmp_path):
    from textbench.operators.compare import paired_predictions

    labels = [("joy", "joy"), ("joy", "love"), ("fear", "fear")] * 100
    for name, data in (("a", labels), ("b", labels[:150])):
        lines = "".join(f'"text {i}\nsecond ""line""",{t},{p}\n' for i, (t, p) in enumerate(data))
        (tmp_path / f"{name}.csv").write_text("text,true_label,pred_label\n" + lines)
    paths = {m: str(tmp_path / f"{m}.csv") for m in ("a", "b")}
    df, _ = S.read_available_predictions(spark, paths, number=True)
    one = df.filter("model = 'a'").orderBy("row_id").collect()
    assert [(r["true_label"], r["pred_label"]) for r in one] == labels and one[-1]["row_id"] == 299
    row = paired_predictions(df, ["a", "b"]).first()
    assert (row["n_a"], row["n_b"], row["n_both"], row["both_right"], row["both_wrong"], row["agreement"]) == (300, 150, 150, 100, 50, 1.0)


def test_positions_need_a_single_file(spark, tmp_path):
    spark.range(10).repartition(3).write.options(**S.CSV_FORMAT).csv(str(tmp_path / "many"))
    with pytest.raises(ValueError, match="single file"):
        S.number_rows(S.read_table(spark, str(tmp_path / "many")))


def write(path, **files):
    path.mkdir()
    for name, text in files.items():
        (path / f"{name}.csv").write_text(text)
    return str(path)


@pytest.mark.parametrize("multi_line", [True, False])
def test_columns_are_found_by_the_header_of_each_file(spark, tmp_path, multi_line):
    path = write(tmp_path / "two", a="text,label\nhello,joy\n", b="label,text\nanger,world\n", c="more,label,text\n1,fear,dark\n")
    got = S.read_labelled(spark, path, multi_line=multi_line).collect()
    assert sorted((r["text"], r["label"]) for r in got) == [("dark", "fear"), ("hello", "joy"), ("world", "anger")]


def test_records_with_too_many_fields(spark, tmp_path):
    path = write(tmp_path / "odd", a="text,label\nfine,joy\nshort\nx,joy,extra\n")
    with pytest.raises(Exception, match="more fields than its header"):
        S.read_labelled(spark, path).collect()
    kept = S.read_labelled(spark, path, malformed="drop").collect()
    assert sorted((r["text"], r["label"]) for r in kept) == [("fine", "joy"), ("short", "nan")]
    marked = S.read_labelled(spark, path, malformed="mark")
    assert marked.filter("malformed").count() == 1 and marked.count() == 3
    with pytest.raises(ValueError):
        S.read_table(spark, path, malformed="maybe")


def test_ingest(spark, tmp_path):
    path = write(tmp_path / "in", a='text,label\n"two\nlines",joy\n', b="label,text\nfear,NA\n")
    S.ingest(spark, path, str(tmp_path / "out"))
    got = S.read_table(spark, str(tmp_path / "out"), "parquet").collect()
    assert sorted((r["text"], r["label"]) for r in got) == [("NA", "fear"), ("two\nlines", "joy")]


def test_an_empty_folder_of_predictions_is_ranked_last(spark, tmp_path):
    from textbench.plans.comparison import compare_saved

    full = write(tmp_path / "full", a="text,true_label,pred_label\na,joy,love\n")
    empty = write(tmp_path / "empty", a="text,true_label,pred_label\n")
    ranking, _, missing = compare_saved(spark, {"none": empty, "gone": str(tmp_path / "gone"), "some": full})
    assert missing == ["gone"]
    assert [(r["model"], r["n"]) for r in ranking.orderBy("rank").collect()] == [("some", 1), ("none", 0)]


def test_headers_are_found_without_reading_the_files(spark, tmp_path, monkeypatch):
    """Each file is opened once for its header, and no job runs before the rows are asked for."""
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("text,label\n" + "x,joy\n" * 1000)
    asked, first = [], S._first_line
    monkeypatch.setattr(S, "_first_line", lambda spark, file: asked.append(file) or first(spark, file))
    spark.sparkContext.setJobGroup("headers", "headers")
    table = S.read_labelled(spark, str(tmp_path), multi_line=False)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    assert len(asked) == len(set(asked)) == 3
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert table.count() == 3000


def test_headers_of_many_and_of_empty_files(spark, tmp_path):
    names = ["text,label", "label,text", "more,label,text"]
    for k in range(40):
        row = {"text": f"t{k}", "label": "joy", "more": "x"}
        header = names[k % 3]
        (tmp_path / f"part {k}%20.csv").write_text(f"{header}\n" + ",".join(row[c] for c in header.split(",")) + "\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n \n")
    got = sorted(r["text"] for r in S.read_labelled(spark, str(tmp_path)).collect())
    assert got == sorted(f"t{k}" for k in range(40))


def test_headers_of_compressed_files(spark, tmp_path):
    import gzip

    for k, header in enumerate(("text,label", "label,text")):
        with gzip.open(tmp_path / f"{k}.csv.gz", "wt", encoding="utf-8-sig") as file:
            file.write(f"{header}\n" + ",".join({"text": f"é{k}", "label": "joy"}[c] for c in header.split(",")) + "\n")
    got = sorted((r["text"], r["label"]) for r in S.read_labelled(spark, str(tmp_path)).collect())
    assert got == [("é0", "joy"), ("é1", "joy")]
