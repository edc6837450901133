import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from llm_helpers import prose

from textbench.llm import language as LG
from textbench.llm import quality as Q
from textbench.llm import toxicity as T
from textbench.llm.labelled import sample

ALPHABETS = {"en": ["the", "tion", "ing", "and", "was"], "de": ["ung", "sch", "ß", "keit", "über"], "fr": ["é", "eau", "que", "ç", "ment"]}


def words(lang, n, r):
    return " ".join(r.choice(ALPHABETS[lang]) + r.choice(ALPHABETS[lang]) for _ in range(n))


def held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language(spark, documents, odd_rows):
    r = random.Random(5)
    rows = [(i, words(lang, r.randint(3, 60), r), lang, "s") for i in range(1000, 1240) for lang in [r.choice(list(ALPHABETS))]]
    docs = documents(rows + [(i, t, None, s) for i, t, _, s in odd_rows]).repartition(4)
    got = LG.identify(docs).collect()
    truth = {i: lang for i, _, lang, _ in rows}
    known = [x for x in got if x["doc_id"] in truth]
    assert len(got) == len(rows) + len(odd_rows) and all(x["held_out"] == held(x["doc_id"]) for x in known)
    assert np.mean([x["lang_pred"] == truth[x["doc_id"]] for x in known if x["held_out"]]) > 0.95
    odd = {x["doc_id"]: x for x in got if x["doc_id"] is not None and x["doc_id"] < 1000}
    assert all((odd[i]["lang_pred"], odd[i]["score"]) == ("und", 0.0) for i in (2, 3, 4, 9)) and odd[1]["lang_pred"] != "und"
    assert all(0 <= x["score"] <= 1 for x in got)
    kept = LG.keep_accepted(docs)
    assert kept.columns == docs.columns and {2, 3, 4, 9}.isdisjoint(x["doc_id"] for x in kept.select("doc_id").collect())
    assert kept.count() >= len(rows)


def test_nothing_to_learn_from(empty, documents, labels):
    assert LG.identify(empty).count() == 0 and LG.keep_accepted(empty).count() == 0
    alone = documents([(1, "some text", None, None), (2, None, None, None)])
    assert {(r["lang_pred"], r["score"]) for r in LG.identify(alone).collect()} == {("und", 0.0)}
    none = labels([])
    for op, score in ((T, 0.0), (Q, 0.5)):
        assert op.score(empty, none).count() == 0
        assert {r["score"] for r in op.score(alone, none).collect()} == {score}
        assert {r["score"] for r in op.score(alone, labels([(1, 1, 1), (2, None, None), (None, 0, 0)])).collect()} == {score}


@pytest.fixture(scope="module")
def labelled(documents, labels, odd_rows):
    r, rows, marks = random.Random(6), [], []
    for i in range(2000, 2300):
        text = prose(i, r.randint(30, 200)).split()
        toxic, good = r.random() < 0.3, r.random() < 0.6
        for _ in range(3 if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(["vilewretch", "badoaf", "scumlord"]))
        if not good:
            text = [w + r.choice(["!!", "###", "$$$"]) for w in text]
        rows.append((i, " ".join(text), "en", "s"))
        marks.append((i, int(good), int(toxic)))
    extra = [(2000, None, None), (None, 1, 1), (99_999, 1, 0)]
    return documents(rows + odd_rows).repartition(4), labels(marks + extra), {m[0]: m for m in marks}, len(rows) + len(odd_rows)


@pytest.mark.parametrize(("op", "place"), [(Q, 1), (T, 2)])
def test_held_out_accuracy(labelled, op, place):
    docs, marks, truth, n = labelled
    got = op.score(docs, marks).collect()
    assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
    told = [(r["score"], truth[r["doc_id"]][place]) for r in got if r["doc_id"] in truth and r["held_out"]]
    good, bad = ([s for s, y in told if y == c] for c in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_segments_by_brute_force():
    r = random.Random(8)
    for _ in range(300):
        scores = [r.randint(-4, 4) for _ in range(r.randint(0, 14))]

        def maximal(a, b):
            """The maximal segments of scores[a:b]: the best one, then what is left and right of it."""
            best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i, j = best[3:]
            return [*maximal(a, i), (i, j), *maximal(j, b)]

        got = T.segments(scores)
        want = maximal(0, len(scores))
        assert sum(s for *_, s in got) == sum(sum(scores[i:j]) for i, j in want)
        assert all(s == sum(scores[i:j]) > 0 for i, j, s in got)
        assert max((s for *_, s in got), default=0) == max((sum(scores[i:j]) for i, j in want), default=0)


def test_maximal_segments_are_the_right_ones():
    """Scores without ties: the segments themselves, not only their sums."""
    r = random.Random(18)
    for _ in range(300):
        scores = [r.gauss(-0.2, 1) for _ in range(r.randint(0, 16))]

        def maximal(a, b):
            best = max(((sum(scores[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            return [] if best[0] <= 0 else [*maximal(a, best[1]), best[1:], *maximal(best[2], b)]

        assert [(a, b) for a, b, _ in T.segments(scores)] == maximal(0, len(scores))


def test_log_odds_by_hand():
    frame = pd.DataFrame({"token": [b"a", b"b", b""], "n0": [30, 2, 100], "n1": [1, 9, 20], "n": [90, 20, 400]})
    got = T.log_odds(frame)
    n0, n1, weight = 132, 30, T.PRIOR_SHARE * 162
    for k, (x0, x1, n) in enumerate(zip(frame["n0"], frame["n1"], frame["n"], strict=True)):
        a, b = x1 + weight * n / 510, x0 + weight * n / 510
        delta = math.log(a / (n1 + weight - a)) - math.log(b / (n0 + weight - b))
        assert got["delta"][k] == pytest.approx(delta) and got["z"][k] == pytest.approx(delta / math.sqrt(1 / a + 1 / b))
    assert got["delta"][0] < 0 < got["delta"][1]


def test_tokens_are_counted_over_all_rows(documents, labels):
    """Counts of labelled rows and of all documents, whatever the sample is."""
    rows = [(i, f"word{i % 3} common longword{i % 2}", "en", "s") for i in range(60)]
    docs, marks = documents(rows).repartition(3), labels([(i, 1, i % 2) for i in range(0, 60, 2)] + [(1, 1, 1)])
    usable = [(i, i % 2) for i in [*range(0, 60, 2), 1] if not held(i)]
    counts = T.token_counts(T.with_labels(docs, T.usable_labels(marks, "toxic"))).toPandas()
    got = {bytes(t): (a, b) for t, a, b in zip(counts["token"], counts["n0"], counts["n1"], strict=True)}
    assert got[b"common"] == tuple(sum(y == c for _, y in usable) for c in (0, 1))
    assert got[b"word0"] == tuple(sum(y == c and i % 3 == 0 for i, y in usable) for c in (0, 1))
    assert T.occurrences(docs, [b"common", b"word1", b"longw*"]) == {b"common": 60, b"word1": 20, b"longw*": 60, b"": 60 * 5}


def test_a_sample_is_bounded_by_rows_and_by_bytes(documents, labels):
    rows = [(1, f"{prose(i, 40)} {i}", "en", "s") for i in range(400)] + [(i, prose(i, 40), "en", "s") for i in range(10, 60)]
    marks = labels([(1, 1, 0)] + [(i, i % 2, 0) for i in range(10, 60)])
    got = sample(documents(rows), marks, "quality", 20).collect()
    assert all(sum(r["label"] == c for r in got) <= 20 for c in (0, 1))
    few = sample(documents(rows), marks, "quality", 20, bytes_per_class=1000).collect()
    assert few and all(sum(len(r["text"]) for r in few if r["label"] == c) < 1000 + 400 for c in (0, 1))


def test_network_by_loops(monkeypatch):
    """Answers, chunks and probability as the definition has them, in parts and at once."""
    net = Q.Network.random(3)
    r = np.random.default_rng(4)
    net.mean, net.spread, net.head = r.normal(size=37), r.uniform(0.5, 2, 37), r.normal(size=38)
    tables = net.tables()
    for n in (0, 3, 60, 64 * 4, 64 * 4 + 1, 1500):
        data = Q.as_bytes(prose(8, 400)[:n])
        answers = np.array([
            [sum(net.embedding[data[i + p]] @ net.filters[p, :, f] for p in range(Q.WIDTH)) for f in range(Q.FILTERS)]
            for i in range(len(data) - Q.WIDTH + 1)
        ])
        blocks = [answers[i : i + 64].max(axis=0) for i in range(0, len(answers), 64)]
        if len(blocks) <= 4:
            chunks = [np.max(blocks, axis=0)]
        else:
            chunks = [np.max(blocks[i : i + 4], axis=0) for i in [*range(0, len(blocks) - 4, 3), len(blocks) - 4]]
        chunks = np.maximum(np.array(chunks) + net.bias, 0)
        pooled = [*chunks.max(axis=0), *chunks.mean(axis=0), *chunks.min(axis=0), np.log1p(len(data)) / 10]
        x = (np.array(pooled) - net.mean) / net.spread
        want = 1 / (1 + np.exp(-(x @ net.head[:-1] + net.head[-1])))
        assert net.probability(data, tables) == pytest.approx(want, rel=1e-3)
        with monkeypatch.context() as m:
            m.setattr(Q, "CHUNKS_AT_ONCE", 3)
            assert net.probability(data, tables) == pytest.approx(want, rel=1e-3)


def test_peaks_in_parts(monkeypatch):
    net, data = Q.Network.random(5), Q.as_bytes(prose(10, 900))
    whole = net._peaks(data, net.tables())
    monkeypatch.setattr(Q, "CHUNKS_AT_ONCE", 2)
    parts = net._peaks(data, net.tables())
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_language_vector_and_steps_by_loops():
    idf = np.random.default_rng(6).uniform(1, 5, LG.DIMENSIONS)
    text = "Ein Wort, zwei WÖRTER!  12"
    plain = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in plain:
        plain = plain.replace("  ", " ")
    grams = Counter(plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1))

    def feature(gram):
        h = 0
        for c in gram:
            h = (h * 0x110000 + ord(c)) % 2**64
        return int(LG.mix(np.array([h], dtype=np.uint64) + np.uint64(len(gram)))[0] % LG.DIMENSIONS)

    want = Counter()
    for gram, n in grams.items():
        want[feature(gram)] += n
    want = {k: n * idf[k] for k, n in want.items()}
    length = math.sqrt(sum(v * v for v in want.values()))
    at, values = LG.vector(text, idf)
    assert at.tolist() == sorted(want) and values == pytest.approx([want[k] / length for k in sorted(want)])

    r = np.random.default_rng(7)
    vectors = [(np.sort(r.choice(6, 3, replace=False)), r.uniform(0, 1, 3)) for _ in range(12)]
    targets = r.integers(0, 3, 12)
    model = LG.Ftrl(["x", "y", "z"])
    model.fit(vectors, targets, passes=2, seed=3)
    z, n = np.zeros((6, 3)), np.zeros((6, 3))

    def weight(i, k):
        if abs(z[i, k]) <= model.l1:
            return 0.0
        return -(z[i, k] - math.copysign(model.l1, z[i, k])) / ((model.beta + math.sqrt(n[i, k])) / model.alpha + model.l2)

    order, random_order = np.arange(12), np.random.default_rng(3)
    for _ in range(2):
        random_order.shuffle(order)
        for row in order:
            w = {(i, k): weight(i, k) for i in range(6) for k in range(3)}
            score = [sum(v * w[i, k] for i, v in zip(*vectors[row], strict=True)) for k in range(3)]
            p = np.exp(score) / np.exp(score).sum()
            for i, v in zip(*vectors[row], strict=True):
                for k in range(3):
                    g = v * (p[k] - (targets[row] == k))
                    z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / model.alpha * w[i, k]
                    n[i, k] += g * g
    assert model.weights[:6] == pytest.approx(np.array([[weight(i, k) for k in range(3)] for i in range(6)]))
    model.calibrate(vectors, targets)

    def loss(t):
        return -sum(math.log(LG._softmax(v @ model.weights[at] / t)[y]) for (at, v), y in zip(vectors, targets, strict=True))

    assert loss(model.temperature) <= min(loss(t) for t in np.geomspace(0.02, 5, 60)) + 1e-3


def test_ties_between_languages_go_to_the_first(documents):
    same = [(i, "abc abc", lang, "s") for i, lang in enumerate(["b", "a"] * 40)]
    got = LG.identify(documents(same)).collect()
    assert len({(r["lang_pred"], r["score"]) for r in got}) == 1


def test_the_most_frequent_languages_are_learned(documents):
    r = random.Random(31)
    rows = [(i, words(lang, 20, r), lang, "s") for i in range(120) for lang in [("en", "de", "en", "de", "fr")[i % 5]]]
    model, _ = LG.train(documents(rows), languages=2)
    assert model.labels == ["de", "en"]


def test_gradients_of_the_network():
    net = Q.Network.random(2)
    net.weights = np.random.default_rng(1).normal(0, 1, 3 * Q.FILTERS + 1)
    data = Q.as_bytes(prose(9, 120))

    def loss():
        out = net.answers(data, net.tables().astype(np.float64))
        size = 4 * Q.BLOCK
        starts = list(range(0, max(1, len(out) - size + 1), 3 * Q.BLOCK))
        if starts[-1] + size < len(out):
            starts.append(len(out) - size)
        c = np.maximum(np.stack([out[s : s + size].max(axis=0) for s in starts]) + net.bias, 0)
        x = np.concatenate((c.max(axis=0), c.mean(axis=0), c.min(axis=0), [1.0]))
        return np.log1p(np.exp(-(x @ net.weights)))

    found = net.step(data, 1, 1.0)
    for name, gradient in zip(("embedding", "filters", "bias", "weights"), found, strict=True):
        value = getattr(net, name)
        at = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        before = value[at]
        value[at] = before + 1e-3
        up = loss()
        value[at] = before - 1e-3
        down = loss()
        value[at] = before
        assert abs((up - down) / 2e-3 - gradient[at]) < 0.05 * abs(gradient[at]) + 1e-3


def test_toxic_scores_do_not_follow_the_sample(documents, labels):
    r, rows, marks = random.Random(9), [], []
    for i in range(3000, 3800):
        toxic = r.random() < 0.15
        text = prose(i, 60).split()
        if r.random() < (0.6 if toxic else 0.1):
            text.insert(r.randrange(60), "vilewretch")
        rows.append((i, " ".join(text), "en", "s"))
        marks.append((i, 1, int(toxic)))
    docs, marks = documents(rows), labels(marks)
    whole, some = (np.mean([x["score"] for x in T.score(docs, marks, T.train(docs, marks, n)).collect()]) for n in (3000, 60))
    assert abs(whole - some) < 0.08


@pytest.mark.parametrize("op", [Q, T])
def test_clashing_columns_of_labels(spark, labelled, op):
    docs, marks, *_ = labelled
    names = "text label draw hash bytes upto weight n score lang source".split()
    more = marks.selectExpr("*", *(f"'x' as `{c}`" for c in names))
    got, want = (sorted((str(r["doc_id"]), r["score"]) for r in op.score(docs, m).collect()) for m in (more, marks))
    assert got == want
