import hashlib
import itertools
from collections import Counter

import pytest
from plans import exchanged, nodes
from pyspark.sql import functions as F

from textbench.fixed import LABELS
from textbench.operators import balance as B
from textbench.operators import labels as LB
from textbench.operators import losses as LO


def frame(spark, labels, split="train"):
    return spark.createDataFrame([(i, label, split) for i, label in enumerate(labels)], "row_id bigint, label string, split string")


def test_vocabularies(spark, rows):
    clean = frame(spark, ["joy", "fear", "joy"])
    dirty = clean.union(frame(spark, ["surprise", None], "val"))
    assert rows(LB.label_union(dirty)) == [("fear",), ("joy",), ("nan",), ("surprise",)]
    assert rows(LB.unseen_labels(clean)) == []
    assert rows(LB.unseen_labels(dirty)) == [("nan",), ("surprise",)]
    assert rows(LB.label_mapping(clean)) == [(0, "fear"), (1, "joy")]
    assert rows(LB.resolve_labels(clean), "label_id", "label") == [(i, x) for i, x in enumerate(LABELS)]
    # a strange label in any split: the train split alone makes the mapping
    assert rows(LB.resolve_labels(dirty)) == [(0, "fear", "derived"), (1, "joy", "derived")]


def test_unknown_labels_stay_countable(spark):
    encoded = LB.encode_table(frame(spark, ["love", "surprise", None]))
    assert [(r["label_id"], r["known"]) for r in encoded.orderBy("row_id").collect()] == [(4, True), (0, False), (0, False)]


def test_a_mapping_follows_the_order_of_the_labels(spark):
    names = ["b", "a", "", "ab", "aa", "aab", "Z", "é", "zz", "z\U0001f642", "z\ufb01", "a b"]
    got = LB.label_mapping(frame(spark, names + names)).orderBy("label_id").collect()
    assert [r["label"] for r in got] == sorted(names, key=lambda x: x.encode())
    assert [r["label_id"] for r in got] == list(range(len(names)))


def test_encoding_by_a_mapping(spark):
    df = frame(spark, ["love", "fear", None, "love"])
    mapping = LB.label_mapping(df.filter("row_id in (0, 1)"))
    got = LB.encode_by_mapping(df, mapping).orderBy("row_id").collect()
    assert [(r["label_id"], r["known"]) for r in got] == [(1, True), (0, True), (0, False), (1, True)]
    assert got[0].asDict().keys() == {"row_id", "label", "split", "label_id", "known"}
    kept = LB.resolved_label(df, mapping).orderBy("row_id").collect()
    assert [r["label"] for r in kept] == ["love", "fear", "fear", "love"]


def test_counts_and_weights(spark):
    df = LB.encode_table(frame(spark, ["a"] * 3 + ["b"]), ["a", "b", "c"])
    assert [r["n"] for r in B.class_counts(df, ["a", "b", "c"]).orderBy("label_id").collect()] == [3, 1, 0]
    weights = B.class_weights(df, ["a", "b", "c"])
    assert [r["weight"] for r in weights.orderBy("label_id").collect()] == pytest.approx([4 / 9, 4 / 3, 0])
    sampling = [r["weight"] for r in B.sampling_weights(df, ["a", "b", "c"]).orderBy("label_id").collect()]
    assert sampling == pytest.approx([1 / 3.000001, 1 / 1.000001, 1e6])
    attached = B.attach_class_weight(df, weights).orderBy("row_id").collect()
    assert [r["weight"] for r in attached] == pytest.approx([4 / 9] * 3 + [4 / 3])


def test_ids_out_of_range_are_not_counted(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (-1,), (None,)], "label_id bigint")
    assert [r["n"] for r in B.class_counts(df, ["a", "b"]).orderBy("label_id").collect()] == [1, 1]
    assert LB.label_in_range(df, 2).count() == 2


def test_distribution(spark):
    df = frame(spark, ["joy", "joy", "fear", "love"]).union(frame(spark, ["joy"], "val"))
    got = {r["label"]: r.asDict() for r in B.class_distribution(df).collect()}
    assert (got["joy"]["n_train"], got["joy"]["pct_train"], got["joy"]["n_val"], got["joy"]["n_all"]) == (2, 50.0, 1, 3)
    assert got["fear"]["pct_val"] == 0.0 and got["joy"]["pct_test"] is None


def test_weighted_mean_loss(spark):
    losses = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (2, 1, 4.0)], "row_id bigint, y bigint, loss double")
    weights = spark.createDataFrame([(0, 0.5), (1, 2.0)], "label_id bigint, weight double")
    assert LO.weighted_mean_loss(losses, weights).first()["weighted_mean_loss"] == pytest.approx((0.5 + 1 + 8) / 3)
    assert LO.mean_loss(losses).first()["mean_loss"] == pytest.approx(7 / 3)


# -- balanced sample ----------------------------------------------------------


def drawn_by_hand(data, seed, digits):
    """The draws as a plain loop: class by running chance, row by position in hash order."""
    members = {}
    for row_id, label_id in data:
        bucket = int(hashlib.md5(f"{seed}:row:{row_id}".encode()).hexdigest()[:digits], 16)
        members.setdefault(label_id, []).append((bucket, row_id))
    members = {c: [r for _, r in sorted(m)] for c, m in sorted(members.items())}
    chances = [len(m) / (len(m) + 1e-6) for m in members.values()]
    upto = list(itertools.accumulate(chances))
    out = {}
    for row_id, _ in data:
        digest = hashlib.md5(f"{seed}:draw:{row_id}".encode()).hexdigest()
        u, v = int(digest[:13], 16) / 16**13, int(digest[13:26], 16) / 16**13
        place = next((i for i, top in enumerate(upto) if u * upto[-1] < top), len(upto) - 1)
        chosen = list(members.values())[place]
        out[row_id] = (list(members)[place], chosen[min(int(v * len(chosen)), len(chosen) - 1)])
    return out


@pytest.mark.parametrize("digits, copies", [(4, 1000), (1, 2)])
def test_sample_equals_a_plain_loop(spark, monkeypatch, digits, copies):
    """Also with few buckets and many salts per row: a class of 2 rows out of 900 is drawn some 300 times."""
    monkeypatch.setattr(B, "BUCKET_HEX_DIGITS", digits)
    monkeypatch.setattr(B, "COPIES_PER_KEY", copies)
    data = [(i * 3, 0 if i % 3 else 5) for i in range(898)] + [(9000, 2), (9001, 2)]
    df = spark.createDataFrame(data, "row_id bigint, label_id bigint").withColumn("text", F.concat(F.lit("t"), "row_id"))
    want = drawn_by_hand(data, 11, digits)
    for parts in (1, 8):
        got = B.weighted_sample(df.repartition(parts), 11, columns=["text"]).collect()
        assert {r["draw_id"]: (r["label_id"], r["row_id"]) for r in got} == want
        assert len(got) == len(data) and all(r["text"] == f"t{r['row_id']}" for r in got)
    shares = Counter(c for c, _ in want.values())
    assert all(abs(n - 300) < 60 for n in shares.values())


def test_sample_size_can_be_given(spark):
    df = LB.encode_table(frame(spark, ["joy"] * 9 + ["fear"]))
    got = B.weighted_sample(df, 5, num_samples=400)
    assert got.count() == 400
    assert 150 < got.filter("label_id = 3").count() < 250


def test_sample_leaves_out_ids_out_of_range(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 77), (4, None)], "row_id bigint, label_id bigint")
    got = B.weighted_sample(df, 5).collect()
    assert len(got) == 2 and {r["row_id"] for r in got} <= {1, 2}


def test_a_mapping_of_many_labels_of_one_beginning(spark):
    names = [f"class_{i:05d}" for i in range(20_000)]
    df = spark.range(60_000).selectExpr("format_string('class_%05d', id % 20000) as label", "'train' as split")
    got = {r["label"]: r["label_id"] for r in LB.label_mapping(df).collect()}
    assert got == {name: i for i, name in enumerate(names)}


def test_a_sample_moves_texts_once(spark):
    """Windows and draws see keys only; the texts go through the last join alone."""
    data = [(i, "joy" if i % 50 else "fear", "t" * 100) for i in range(1000)]
    df = LB.encode_table(spark.createDataFrame(data, "row_id bigint, label string, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sample = B.weighted_sample(df, 3, columns=["text"])
        moved = exchanged(sample)
        assert sum("text" in columns for columns in moved) == 1
        windows = [n for n in nodes(sample) if n.nodeName() == "Window"]
        assert windows and not any("text" in n.output().toString() for n in windows)
        assert sample.count() == 1000 and sample.filter("text is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
