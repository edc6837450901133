"""Every query against its SQL, and properties of all plans."""

import contextlib
import io
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as driver  # noqa: E402
from textbench.catalog.oracles import ORACLES  # noqa: E402
from textbench.catalog.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TRAINED = {"train_classifier", "select_by_validation", "predict_table", "evaluate_split", "save_model", "load_model"}
KINDS = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_sql_that_does_not_show_what_a_model_learned():
    assert set(ORACLES) == set(QUERIES) - TRAINED | {"save_model"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    kinds = {c[0]: KINDS[str(c[1])] for c in result.description}
    assert kinds == {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = [c[0] for c in result.description]
    want = sorted(result.fetchall(), key=str)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got == want and got


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_plans(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan, node
    assert ("MapInPandas" in plan) == (name == "generate")


def test_the_driver_gets_all_of_them():
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", ["compare_models", "class_weights", "confusion_matrix", "paired_predictions", "weighted_sample"])
def test_texts_are_not_read_where_only_labels_count(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "text:string" not in plan


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert [(r["model"], r["macro_f1"], r["accuracy"]) for r in sorted(rows, key=lambda r: r["rank"])] == [
        ("tuned", 0.573848, 0.67), ("few", 0.284664, 0.34), ("zero", 0.150598, 0.17),
    ]


SPREAD = [
    "compare_models", "per_class_metrics", "paired_predictions", "class_weights", "weighted_sample", "shuffle_rows", "first_n",
    "early_stop", "running_epoch_loss", "token_vocabulary", "key_tokens", "encode_tokens", "resolve_labels", "baseline_predictions",
]


@pytest.mark.parametrize("name", SPREAD)
def test_result_does_not_depend_on_partitions(spark, monkeypatch, rows, name):
    from textbench import fixtures

    read = fixtures.table
    results = []
    for parts in (1, 8):
        monkeypatch.setattr(fixtures, "table", lambda *args, parts=parts: read(*args).repartition(parts))
        results.append(rows(QUERIES[name](spark, SF)))
    assert results[0] == results[1]
