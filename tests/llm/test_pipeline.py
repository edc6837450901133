import random
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from llm_helpers import alnum, prose, shingle_set

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as C  # noqa: E402

from textbench.llm.queries import ORACLES, QUERIES  # noqa: E402
from textbench.session import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_native_operators_stay_in_the_engine(spark):
    for name in ("op1_fingerprints", "op6_decontamination"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_stages(spark, documents, odd_rows):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("item_id = 2").first()["text"]
    near = odd_rows[0][1].split()
    near[30] = "edited"
    rows = [(i, t, "en" if t and lang else lang, s) for i, t, lang, s in odd_rows] + [
        (700, "and so " + item + " it was", "en", "a"), (701, " ".join(near), "en", "b"), (702, "the password = hunter2hunter2", "en", "a"),
    ]
    docs, kept = documents(rows).repartition(3), {}
    for name, stage in C.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == before.columns
        if name == "secrets":
            assert docs.filter("doc_id = 702").first()["text"] == "the <secret>"
    assert kept["language"].isdisjoint({2, 3, 4, 9}) and {1, 5, 7, 8, 700, 701, 702} <= kept["language"]
    assert 1 in kept["near_duplicates"] and kept["near_duplicates"].isdisjoint({7, 701})
    assert 700 not in kept["decontamination"] and kept["near_duplicates"] - kept["decontamination"] == {700}
    assert kept["secrets"] == kept["packing"] == kept["decontamination"]
    assert docs.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).filter("doc_tokens != `sum(length)`").count() == 0


def _corpus(items):
    """Documents with near copies, benchmark passages, and secrets of few and of many owners."""
    r = random.Random(21)
    live, wide = "9f8a6c2be1d04735ab90cd12ef34", "71c0ffee5ad0b1e2c3d4a5968778"
    rows = []
    for i in range(90):
        words = prose(5000 + i, r.randrange(40, 120)).split()
        if i % 9 == 1:  # edits of the one before, some too many
            words = rows[-1][1].split()
            for k in range(r.randrange(1, 6)):
                words[(11 * k + i) % len(words)] = f"edit{i}"
        if i % 10 == 4:
            words[20:20] = r.choice(items).split()[: r.randrange(8, 14)]
        if i % 15 == 7:
            words[5:5] = ["token", "=", live]
        if i % 6 == 3:
            words[5:5] = [wide]
        rows.append((i, " ".join(words), "en", f"owner{i % 30 if i % 6 == 3 else i % 3}"))
    return rows + [(200, rows[8][1], "en", "owner1"), (200, rows[8][1], "en", "owner1"), (None, prose(9, 60), "en", None)], live, wide


def test_stages_against_brute_force(spark, documents, tmp_path):
    items = [prose(7000 + i, 12) for i in range(5)] + ["only four words here"]
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, live, wide = _corpus(items)
    docs = documents(rows).repartition(4)
    stages = dict(C.STAGES)

    # one document, that of the least id, of each group of similarity 0.8
    texts = sorted({t: min([i for i, u, *_ in rows if u == t and i is not None], default=10**9) for _, t, *_ in rows}.items(), key=lambda x: x[1])
    top = {t: t for t, _ in texts}

    def find(t):
        return t if top[t] == t else find(top[t])

    sets = {t: shingle_set(t) for t, _ in texts}
    for k, (t, _) in enumerate(texts):
        for u, _ in texts[k + 1 :]:
            if len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u]):
                top[find(u)] = find(t)
    one = materialize(stages["near_duplicates"](spark, docs, str(tmp_path)))
    kept = sorted(r["text"] for r in one.collect())
    assert kept == sorted(t for t, _ in texts if top[t] == t) and len(kept) < len(texts)

    # none that holds a window of a benchmark item
    windows = {tuple(w[k : k + 10]) for w in map(alnum, items) for k in range(max(1, len(w) - 9))}
    holds = lambda w: any(tuple(w[k : k + len(x)]) == x for x in windows for k in range(len(w) - len(x) + 1))
    clean = materialize(stages["decontamination"](spark, one, str(tmp_path)))
    assert sorted(r["text"] for r in clean.collect()) == sorted(t for t in kept if not holds(alnum(t)))

    # secrets masked, but not what many owners have
    owners = defaultdict(set)
    for r in clean.collect():
        for value in (live, wide):
            if value in r["text"]:
                owners[value].add(r["source"])
    assert len(owners[live]) < 5 <= len(owners[wide])
    masked = materialize(stages["secrets"](spark, clean, str(tmp_path)))
    want = sorted(re.sub(f"token = {live}|{live}", "<secret>", r["text"]) for r in clean.collect())
    assert sorted(r["text"] for r in masked.collect()) == want

    # the ids of all texts, each in one piece, in sequences without gaps
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, masked, str(tmp_path)).collect()
    for r in masked.collect():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        own = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == r["doc_id"])
        assert [a for a, *_ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1]] and sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == crc for a, n, crc in own)
    used = defaultdict(list)
    for p in pieces:
        used[p["sequence_id"]].append((p["offset"], p["length"]))
    assert all(sum(n for _, n in own) <= 2048 for own in used.values())


def test_an_empty_corpus_stays_empty(spark, empty):
    docs = empty
    for _, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SF))
        assert docs.count() == 0


def test_nothing_to_learn_a_language_from_keeps_the_corpus(spark, documents):
    docs = documents([(1, "some text", None, "a"), (2, "12 !", None, "a"), (3, None, None, "a"), (2, "other text", None, "b")])
    kept = C.language(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "some text"), (2, "other text")]
