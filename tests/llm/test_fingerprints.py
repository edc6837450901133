import hashlib
import re

from llm_helpers import shingle_set
from pyspark.sql import functions as F

from textbench.llm import fingerprints as P


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_by_brute_force(odd, odd_rows):
    order = sorted(((i, t or "") for i, t, *_ in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    texts = [t for _, t in order]
    want = []
    for k, (i, t) in enumerate(order):
        after, n = texts[(k + 1) % len(texts)], len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(shingle_set(t), shingle_set(edited))))
    for blocks in (1, 5):
        rows = P.edit_and_compare(odd, blocks=blocks)
        near = P.resemblance(F.col("fingerprint"), F.col("edited_fingerprint"))
        got = rows.select("doc_id", "n_chars", "edited_sha256", near.alias("near")).collect()
        assert sorted((str(r[0]), *r[1:3]) for r in got) == sorted((str(w[0]), *w[1:3]) for w in want)
        near = {(str(r[0]), r[2]): r[3] for r in got}
        assert all(abs(near[str(i), sha] - j) < 0.2 for i, _, sha, j in want)


def test_empty_table_and_single_row(empty, documents):
    assert P.edit_and_compare(empty).count() == 0
    row = P.edit_and_compare(documents([(1, "a b c d e f g h", None, None)])).first()
    assert row["edited_sha256"] == hashlib.sha256(b"a b c d e f a b").hexdigest()


def test_sketches_of_parts_merge_and_estimate(spark):
    base = [f"w{i}" for i in range(3000)]
    a, b = " ".join(base[:2000]), " ".join(base[500:])
    df = spark.createDataFrame([("x", a), ("x", b), ("y", a), (None, None)], "key string, text string")
    df = df.withColumn("sketch", P.sketch(F.col("text")))
    merged = {r["key"]: r["sketch"] for r in P.merge(df, ["key"]).collect()}
    whole = df.groupBy().agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("sketch")))).alias("s")).first()["s"][: P.K]
    assert merged["x"] == whole and len(merged["y"]) == P.K and merged[None] == []
    pair = spark.createDataFrame([(a, b)], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    x, y = F.col("a"), F.col("b")
    row = pair.select(P.resemblance(x, y), P.containment(x, y), P.distinct_shingles(x), P.distinct_shingles(P.merge_pair(x, y))).first()
    assert abs(row[0] - 1492 / 2996) < 0.15 and abs(row[1] - 1492 / 1996) < 0.25
    assert abs(row[2] / 1996 - 1) < 0.3 and abs(row[3] / 2996 - 1) < 0.3


def test_equal_texts_have_equal_prints(spark):
    df = spark.createDataFrame([("a b c",), ("a b c",), ("",), (None,)], "text string")
    prints = [r[0] for r in df.select(P.printed(P.sketch(F.col("text")))).collect()]
    assert prints[0] == prints[1] != "" and prints[2] == prints[3] == ""
    assert re.fullmatch(r"[A-Za-z0-9+/=]+", prints[0])
