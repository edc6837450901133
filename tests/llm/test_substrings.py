from collections import Counter

import pyarrow as pa
from llm_helpers import prose, spaced

from textbench.llm import substrings as S


def brute(texts, window):
    words = [spaced(t) for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def test_against_brute_force(documents, odd_rows, monkeypatch):
    shared = prose(90, 40)
    texts = [
        prose(91, 30) + " " + shared + " " + prose(92, 20), shared.replace(" ", "\n"), shared + " tail", "a " * 80, "a b " * 60,
        prose(93, 34), prose(93, 34), prose(94, 35), prose(94, 35), shared[5:], prose(95, 50) + " " + prose(95, 50),
    ]
    rows = odd_rows + [(500 + i, t, "en", "z") for i, t in enumerate(texts)]
    want = [(str(r[0]), *w) for r, w in zip(rows, brute([r[1] for r in rows], 35), strict=True)]
    for parts, chunk in ((1, 1_000_000), (6, 500)):
        monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
        got = S.remove_repeats(documents(rows).repartition(parts)).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_a_hot_line_is_partitioned_further(documents, monkeypatch):
    """A common line with differing surroundings makes one anchor's group too large; so does
    a common passage. No worker holds either."""
    line, passage = prose(96, 14), prose(97, 45)
    texts = [f"{prose(1000 + i, 30)} {line} {prose(2000 + i, 30)}" for i in range(60)]
    texts += [f"{prose(3000 + i, 8)} {passage} {prose(4000 + i, 8)}" for i in range(40)] + texts[:3] + [passage]
    rows = [(i, t, "en", "z") for i, t in enumerate(texts)]
    want = [(i, *w) for i, w in enumerate(brute(texts, 35))]
    assert sum(w[2] for w in want) > 1000
    monkeypatch.setattr(S, "GROUP_SUFFIXES", 100)
    for chunk in (2_000, 1_000_000):
        monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
        got = S.remove_repeats(documents(rows).repartition(4)).collect()
        assert sorted(tuple(r) for r in got) == want


def test_neighbours_over_the_ends_of_batches():
    rows = [(1, 5, 10, 0), (1, 5, 11, 3), (1, 6, 12, 1), (1, 7, 0, -1), (1, 7, 13, 2), (2, 7, 14, 2), (2, 8, 0, -1), (2, 8, 15, 4), (2, 8, 16, 5)]
    names = ["anchor", "suffix", "key", "start"]
    for size in range(1, 10):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*p, strict=True)], names) for p in parts]
        got = [r["key"] for b in S._neighbours(35)(iter(batches)) for r in b.to_pylist()]
        assert got == [10, 11, 13, 15, 16], size


def test_short_windows(documents):
    texts = ["a b c d e", "x b c d y", "b c", "a a a a"]
    got = S.remove_repeats(documents([(i, t, None, None) for i, t in enumerate(texts)]), window=3, anchor=2).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {i: w[2] for i, w in enumerate(brute(texts, 3))}


def test_empty_table(empty):
    assert S.remove_repeats(empty).count() == 0
