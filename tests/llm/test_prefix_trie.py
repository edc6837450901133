import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from textbench.llm import prefix_trie as T

EXTRA = "at name left right ending least prefix depth parent source h n head order number first".split()
KINDS = "conv_id bigint, turn bigint, role string, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], KINDS).repartition(3)


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [r[3:] for r in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((
            min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(seed, convs, longest, choices=3):
    r = random.Random(seed)
    texts = ["a", "bb", "ünï", "", None, "x" * 30_000][:choices]
    return [(c, t, r.choice(["user", None, "assistant"][:2]), r.choice(texts)) for c in convs for t in range(r.randrange(1, longest))]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_by_brute_force(table):
    rows = rows_of(1, [*range(40), *range(100, 140), 250, 999, 2**60], 12)
    assert got(T.prefix_trie(table(rows))) == plain(rows)


def test_odd_rows(table):
    """Nulls, ties of a turn, repeated rows, conversations that lose all turns."""
    rows = rows_of(2, range(30), 5, 6)
    rows += [(None, 1, "user", "a"), (200, None, "user", "later"), (200, -1, "user", "b"), (200, 0, None, None), (200, 0, "x", "y")]
    rows += rows[:6] + [(c, 0, "user", "a") for c in range(301, 340)]  # no conversation 300: their first turns go
    want = plain(rows)
    assert any(r[1] == 0 and r[7] != T.EMPTY_SHA256 for r in want)
    assert got(T.prefix_trie(table(rows))) == want


def test_only_turnless(table):
    conv = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    rows = [(conv, 0, "user", "a")]
    assert got(T.prefix_trie(table(rows))) == plain(rows) and len(plain(rows)) == 1


def test_copies_and_a_long_conversation(table, monkeypatch):
    monkeypatch.setattr(T, "PART", 8)
    rows = [(c, t, "user", f"same {t}") for c in range(90) for t in range(4)]
    rows += [(500, t, "user", f"turn {t}") for t in range(70)]
    assert got(T.prefix_trie(table(rows))) == plain(rows)


def test_empty_table(table):
    assert T.prefix_trie(table(rows_of(1, [1], 3)).limit(0)).count() == 0
