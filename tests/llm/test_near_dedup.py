import random

import numpy as np
from llm_helpers import prose, shingle_set

from textbench.llm import near_dedup as N


def test_groups_by_brute_force(odd_rows, documents):
    base = prose(70, 300)
    words = base.split()
    edits = []
    for k in range(12):  # copies with more and more words replaced
        w = list(words)
        for j in range(k):
            w[23 * j + 5] = f"new{k}x{j}"
        edits.append(" ".join(w))
    rows = odd_rows + [(200 + i, t, "en", "z") for i, t in enumerate(edits)] + [(300, base, "en", "z"), (301, prose(71, 300), "en", "z")]
    texts = {}
    for i, t, *_ in rows:
        if i is not None:
            texts.setdefault(i, t or "")
    sets = {i: shingle_set(t) for i, t in texts.items()}
    group = {i: i for i in texts}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in texts:
        for j in texts:
            union = len(sets[i] | sets[j])
            near = texts[i] == texts[j] or union and len(sets[i] & sets[j]) / union >= 0.8
            if i < j and near:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    docs = documents(rows).repartition(4)
    got = N.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["group"] for r in got if r["id"] >= 10} == {i: top(i) for i in texts if i >= 10}
    # rows without an id get negative ones; the empty one of them is a copy of rows 2 and 3
    nameless = {r["id"] for r in got if r["id"] < 0}
    assert len(nameless) == 2 and {r["group"] for r in got if r["id"] in (2, 3)} <= nameless
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["group"] for r in got})


def test_empty_table(empty):
    assert N.near_duplicates(empty).count() == 0 and N.keep_one(empty).count() == 0


def test_signature_estimates_probability_jaccard():
    r = np.random.default_rng(3)
    elements = r.integers(1, 2**63, 300, dtype=np.uint64)
    x, y = r.integers(1, 6, 300).astype(float), r.integers(1, 6, 300).astype(float)
    x[250:], y[:50] = 0, 0
    both = np.flatnonzero((x > 0) & (y > 0))
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    a, b = (N.signature(elements[w > 0], w[w > 0], 2048) for w in (x, y))
    assert abs(np.mean(a == b) - exact) < 0.04


def test_components_follow_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r["id"]: r["group"] for r in N.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_members_of_a_bucket_that_meet_no_pivot(spark):
    rows = [(i, prose(400 + i, 100)) for i in range(8)]
    for i in (5, 6, 7):  # a chain of edits from row 4, far from the pivots
        words = rows[i - 1][1].split()
        words[i * 10] = "edited"
        rows[i] = (i, " ".join(words))
    members = spark.createDataFrame([(i, len(shingle_set(t)), [7]) for i, t in rows], "id bigint, size int, bands array<bigint>")
    shared = N.buckets(members)
    asked = {(r["a"], r["b"]) for r in N.pivot_pairs(shared).collect()}
    assert not asked & {(4, 5), (5, 6), (6, 7)}
    sets = N.shingle_sets(spark.createDataFrame(rows, "id bigint, text string"))
    got = {r["id"]: r["group"] for r in N.linked(shared, sets).collect()}
    assert got == {4: 4, 5: 4, 6: 4, 7: 4}


def _sets(spark, seed, n):
    """Sets around a few bases, some far and some near; groups at random."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base, size = r.randrange(3), r.choice([1, 4, 5, 20, 21, 40])
        own = {1000 * base + k for k in range(size)}
        for k in range(r.randrange(0, 1 + size // 4)):
            own.discard(r.choice(sorted(own)))
            own.add(10_000 + r.randrange(40))
        rows.append((i, r.randrange(6), sorted(own)))
    return rows, spark.createDataFrame(rows, "id bigint, `group` bigint, shingles array<bigint>")


def test_candidates_hold_all_links_between_groups(spark):
    rows, sets = _sets(spark, 5, 150)
    pairs = N.prefix_pairs(sets)
    asked = {(r["a"], r["b"]) for r in pairs.collect()}
    near = set()
    for i, g, x in rows:
        for j, h, y in rows:
            shared = len(set(x) & set(y))
            if i < j and g != h and shared / (len(x) + len(y) - shared) >= 0.8:
                near.add((i, j))
    assert near and near <= asked
    assert all(rows[a][1] != rows[b][1] for a, b in asked)
    assert {(r["a"], r["b"]) for r in N.verified(pairs, sets).collect()} == near


def test_candidates_of_a_crowd_are_few(spark):
    """A crowd that is one group, and strangers that share its common shingles: nobody meets the crowd's pairs."""
    r = random.Random(6)
    base = list(range(60))
    rows = [(i, 0, sorted({*base, 1000 + i})) for i in range(400)]
    rows += [(400 + i, 1 + i, sorted({*r.sample(base, 30), *range(2000 + 40 * i, 2030 + 40 * i)})) for i in range(30)]
    sets = spark.createDataFrame(rows, "id bigint, `group` bigint, shingles array<bigint>")
    assert N.prefix_pairs(sets).count() < 1000


def test_rows_of_one_id_with_different_texts(documents):
    rows = [(1, prose(81, 60), "en", "a"), (1, prose(82, 60), "de", "b"), (1, prose(83, 60), "de", "b"), (1, prose(82, 60), "fr", "b"), (2, prose(82, 60), "de", "c")]
    docs = documents(rows).repartition(3)
    got = N.near_duplicates(docs).collect()
    assert len(got) == 5
    kept = N.keep_one(docs).collect()
    assert sorted(r["text"] for r in kept) == sorted({t for _, t, *_ in rows})
    again = N.keep_one(docs.repartition(1)).collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, again))
