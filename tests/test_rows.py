import hashlib
import random

import pytest
from plans import exchanged, names
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textbench.operators import rows as R
from textbench.session import materialize


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 7)


def test_ordinal_within_a_hot_key(spark, rows, small_blocks):
    rnd = random.Random(3)
    ids = rnd.sample(range(1000), 300)
    data = [(i, "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}") for i in ids]
    df = spark.createDataFrame(data, "id bigint, k string").repartition(5)
    got = rows(R.ordinal_within(df, "id", ["k"]), "id", "k", "ordinal")
    want = []
    for key in {k for _, k in data}:
        want += [(i, key, n) for n, i in enumerate(sorted(i for i, k in data if k == key))]
    assert got == sorted(want, key=str)


def test_global_ordinal_and_negative_ids(spark, rows, small_blocks):
    ids = [-20, -8, -1, 0, 3, 13, 14, 99]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "id bigint")
    assert rows(R.ordinal_within(df, "id")) == sorted([(i, n) for n, i in enumerate(ids)], key=str)


def test_running_totals(spark, small_blocks):
    rnd = random.Random(4)
    data = [(k, i, rnd.choice([None, rnd.random()])) for k in "ab" for i in range(40)]
    df = spark.createDataFrame(data, "k string, i bigint, v double").repartition(3)
    got = R.running_totals(df, ["k"], "i", {"s": (F.col("v"), "sum"), "m": (F.col("v"), "max")})
    got = {(r["k"], r["i"]): (r["s"], r["m"]) for r in got.collect()}
    for k, i, _ in data:
        seen = [v for kk, ii, v in data if kk == k and ii <= i and v is not None]
        s, m = got[(k, i)]
        assert m == max(seen, default=None)
        assert (s or 0) == pytest.approx(sum(seen))


def test_null_key_is_refused(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, k string")
    with pytest.raises(PySparkException, match="k is NULL"):
        R.ordinal_within(df, "id", ["k"]).collect()


def test_row_ordinal_over_many_files(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).select("id", (F.col("id") * 2).alias("v")).write.parquet(path)
    got = R.row_ordinal(spark.read.parquet(path))
    assert got.columns == ["id", "v", "ordinal"]
    assert rows(got, "id", "ordinal") == sorted([(i, i) for i in range(1000)], key=str)


@pytest.mark.parametrize("n", [None, 0])
def test_first_n_without_a_limit(spark, n):
    assert R.first_n(spark.range(50).withColumnRenamed("id", "row_id"), n).count() == 50


@pytest.mark.parametrize("ranges", [4096, 3])
def test_first_n_small_and_large(spark, monkeypatch, ranges):
    monkeypatch.setattr(R, "BLOCK_ROWS", 16)
    monkeypatch.setattr(R, "RANGES", ranges)
    df = spark.range(0, 500, 3).select(F.col("id").alias("row_id")).repartition(4)
    for n in (1, 20, 166, 167):
        assert sorted(r["row_id"] for r in R.first_n(df, n).collect()) == [3 * i for i in range(n)]
    assert R.first_n(df, 10_000).count() == df.count()


@pytest.mark.parametrize("n", [50_000, 150_000])
def test_first_n_is_one_filter_for_every_n(spark, n):
    df = spark.range(200_000).select((F.xxhash64("id")).alias("row_id"), "id")  # strewn over the whole number range
    got = R.first_n(df, n)
    want = sorted(r["row_id"] for r in df.collect())[n - 1]
    assert got.count() == n and got.agg(F.max("row_id")).first()[0] == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Limit" not in plan


def test_first_n_passes_over_rows_without_a_place(spark):
    df = spark.createDataFrame([(None,), (5,), (2,)], "row_id bigint")
    assert [r["row_id"] for r in R.first_n(df, 1).collect()] == [2]
    assert sorted(r["row_id"] for r in R.first_n(df, 3).collect()) == [2, 5]
    assert R.first_n(df, 0).count() == 3


def test_first_n_at_the_ends_of_the_number_range(spark):
    ids = [-(2**63), -5, 0, 2**62, 2**63 - 2, 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "row_id bigint")
    for n in range(1, 8):
        assert sorted(r["row_id"] for r in R.first_n(df, n).collect()) == ids[:n]


def test_shuffle_is_seeded_and_whole(spark):
    df = spark.range(100).withColumnRenamed("id", "row_id")
    one, same, other = ([r["row_id"] for r in R.shuffle_rows(f, s).collect()] for f, s in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert one == same != other and sorted(one) == list(range(100)) and one != sorted(one)
    assert one == sorted(range(100), key=lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest())


def test_numbers_of_strewn_and_equal_values(spark, rows):
    rnd = random.Random(8)
    ids = sorted({rnd.randrange(-(2**62), 2**62) for _ in range(3000)}, key=lambda i: i % 997)
    df = spark.createDataFrame([(i, "hot" if n % 3 else "cold") for n, i in enumerate(ids)], "id bigint, k string").repartition(5)
    got = {r["id"]: r["ordinal"] for r in R.ordinal_within(df, "id").collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}
    want = {}
    for key in ("hot", "cold"):
        own = sorted(i for n, i in enumerate(ids) if ("hot" if n % 3 else "cold") == key)
        want.update({(key, i): n for n, i in enumerate(own)})
    assert {(r["k"], r["id"]): r["ordinal"] for r in R.ordinal_within(df, "id", ["k"]).collect()} == want
    twice = spark.createDataFrame([(v,) for v in (2, 1, None, 2, 1, 1)], "v int")
    assert [r["v"] for r in R.sorted_numbers(twice, ["v"]).orderBy("number").collect()] == [None, 1, 1, 1, 2, 2]
    assert R.sorted_numbers(twice.limit(0), ["v"]).count() == 0


def test_a_hot_value_is_numbered_in_many_ranges(spark, monkeypatch):
    """No range holds the rows of a key that has all of them."""
    written = []
    monkeypatch.setattr(R, "materialize", lambda df: written.append(materialize(df)) or written[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 40_009 * 10**12).alias("id"))
        assert R.sorted_numbers(df, ["k", "id"]).count() == 40_000
        sizes = [r["count"] for r in written[0].groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) > 2 and max(sizes) < 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_offsets_of_a_million_files_move_no_row(spark, monkeypatch):
    offsets = materialize(spark.range(1_000_000).select(F.xxhash64("id").alias("_path"), (F.col("id") * 10).alias("_offset")))
    placed = spark.range(500).select(F.xxhash64(F.col("id") * 1999).alias("_path"), F.lit(3).alias("_index"), F.lit("t").alias("text"))
    joined = R.at_offsets(placed, offsets)
    assert "BroadcastHashJoin" in names(joined) and not exchanged(joined)
    assert {r["_offset"] for r in joined.collect()} == {19990 * i for i in range(500)}
    monkeypatch.setattr(R, "BROADCAST_BYTES", 1000 * R.OFFSET_BYTES)
    assert R.at_offsets(placed, offsets).count() == 500


def test_running_totals_evaluate_the_input_once(spark, small_blocks):
    counted = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    df = spark.range(100).selectExpr("'k' as k", "id as i", "double(id) as v").mapInArrow(passing, "k string, i bigint, v double")
    got = R.running_totals(df, ["k"], "i", {"s": (F.col("v"), "sum")}).collect()
    assert counted.value == 100 and {r["i"]: r["s"] for r in got} == {i: i * (i + 1) / 2 for i in range(100)}
