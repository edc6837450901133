import pytest
from llm_helpers import alnum, prose

from textbench.llm import decontaminate as D


def brute(texts, items, window=10):
    out = []
    for t in texts:
        w, hit, found = alnum(t), set(), set()
        for name, item in items:
            v = alnum(item)
            n = min(len(v), window)
            for i in range(len(v) - n + 1) if n else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[i : i + n]:
                        hit.update(range(s, s + n))
                        found.add(str(name))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("broadcast_bytes", [500_000, 0])
def test_against_brute_force(spark, odd, odd_rows, documents, broadcast_bytes):
    item = prose(50, 14)
    items = [(3, item), (12, item.upper().replace(" ", ", ")), (5, "one"), (6, ""), (7, None), (8, prose(51, 12)), (9, "ab! ab")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [prose(60, 5) + " " + item + " " + item + "x", "ab ab ab", item[: len(item) // 2], " ".join(item.split()[2:12]), "the " * 40]
    rows = odd_rows + [(100 + i, t, "en", "z") for i, t in enumerate(texts)]
    docs = documents(rows)
    got = D.decontaminate(docs, bench, broadcast_bytes=broadcast_bytes).collect()
    want = [(str(r[0]), *w) for r, w in zip(rows, brute([r[1] for r in rows], items), strict=True)]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted(want)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    kept = D.keep_clean(docs, bench, broadcast_bytes=broadcast_bytes)
    assert kept.columns == docs.columns and kept.count() == sum(w[2] == 0 for w in want)


def test_nothing_to_match(spark, odd, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_hit"] for r in D.decontaminate(odd, none).collect()} == {0}
    assert D.decontaminate(empty, none).count() == 0 and D.keep_clean(empty, none).count() == 0


def test_clashing_columns_of_the_benchmark(spark, odd):
    names = "doc_id text_hash words window shingle place start n parts at rows item row".split()
    kinds = "item_id bigint, text string, " + ", ".join(f"`{c}` string" for c in names)
    bench = spark.createDataFrame([(1, prose(2, 60), *["x"] * len(names))], kinds)
    plain = bench.select("item_id", "text")
    want = sorted(map(str, D.decontaminate(odd, plain).collect()))
    assert sorted(map(str, D.decontaminate(odd, bench).collect())) == want
    assert D.keep_clean(odd, bench).count() == D.keep_clean(odd, plain).count() < odd.count()
