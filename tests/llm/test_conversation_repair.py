import hashlib
import random
import time
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from textbench.llm import conversation_repair as C

EXTRA = "conv place number first earliest content letter fault initial at kind copy".split()
KINDS = "conv_id bigint, turn bigint, role string, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)
NEED = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """All edits by recursion: (cost, edits)."""

    @lru_cache(None)
    def rest(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []

        def add(cost, edit, after):
            if after is not None:
                found.append((cost + after[0], edit + after[1]))

        if inserts < 3:
            add(3, "I", rest(i, NEED[state], inserts + 1))
        if i < len(rows):
            role, truncated = rows[i].lower(), 3 if rows[i].isupper() else 0
            add(4, "D", rest(i + 1, state, 0))
            if role != "x":
                if role == NEED[state] or role == "s" and state == "":
                    add(truncated, "K", rest(i + 1, role, 0))
                add(3 + truncated, "R", rest(i + 1, NEED[state], 0))
        return min(found, default=None)

    return rest(0, "", 0)


def plain(rows, damage):
    conversations, ids = defaultdict(list), set()
    for c, t, role, text, *_ in rows:
        ids.add(c)
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(kind, text)
        conversations[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c in ids:
        if not damage and not conversations[c]:
            continue
        own = sorted(
            conversations[c],
            key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()),
        )
        turns = [t for t, _, _ in own if t is not None]
        seen, letters, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            left, letter = text.rstrip(" \t\n\x0b\x0c\r"), role[:1] if role[:1] in ("u", "a", "s") else "o"
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
                letter = letter.upper() if fault == "truncated" else "x"
            letters += letter
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        cost, audit = cheapest(letters)
        lines, state, rest = [], "", iter(own)
        for edit in audit:
            name = {"u": "user", "a": "assistant"}[NEED[state]]
            if edit == "I":
                lines.append(f"{name}:")
            else:
                _, role, text = next(rest)
                if edit == "D":
                    continue
                lines.append(f"{role if edit == 'K' else name}:{text}")
                if edit == "K":
                    state = role[:1]
                    continue
            state = NEED[state]
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def rows_of(seed, n):
    r = random.Random(seed)
    texts = ["Hi.", "Yes!", "no end", "  ", "", "Why? \n", "Hi.", None, "x" * 20_000 + ".", "ünï."]
    return [
        (c, r.choice([None, *range(t + 1)]) if r.random() < 0.2 else t, r.choice(["user", "assistant", "system", "tool", None, "user", "assistant"]), r.choice(texts))
        for c in [*range(n), None, 2**60]
        for t in range(r.randrange(1, 9))
    ]


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], KINDS).repartition(3)


def values(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_search_against_all_edits():
    r = random.Random(1)
    for _ in range(4000):
        rows = "".join(r.choice("uuaasoUASOxx") for _ in range(r.randrange(13)))
        assert C.repair(rows) == cheapest(rows), rows


def test_bounds_rise_from_below():
    """The estimate never exceeds the cost and falls short by two turns at most."""
    r = random.Random(2)
    short = 0
    for _ in range(500):
        rows = "".join(r.choice("uasoUASOx") for _ in range(r.randrange(12)))
        estimate = int(C.rest_costs(rows)[0, C.START])
        assert estimate <= cheapest(rows)[0] <= estimate + 6
        short += estimate < cheapest(rows)[0]
    assert short  # so that bounds do rise, and failed states are met


def test_long_conversations_take_time_in_proportion():
    r = random.Random(3)
    for letters in ("u", "s", "ao", "uasoUASOx"):
        rows = "".join(r.choice(letters) for _ in range(40_000))
        began = time.time()
        cost, edits = C.repair(rows)
        assert time.time() - began < 20
        assert len(C.turns_of(rows, edits)) == len(rows) + 1 and cost > 0


def test_as_it_is_and_with_damage(spark, table, tmp_path):
    rows = rows_of(5, 60)
    assert values(C.repairs(table(rows))) == plain(rows, False)
    path = tmp_path / "data"
    table(rows).write.parquet(f"{path}/conversations.parquet")
    assert values(C.op11_conversation_repair(spark, str(path))) == plain(rows, True)


def test_parts_of_a_long_conversation(table, monkeypatch):
    monkeypatch.setattr(C, "PART", 4)
    rows = [(7, t, "user" if t % 3 else "assistant", f"line {t}.") for t in range(50)]
    assert values(C.repairs(table(rows))) == plain(rows, False)


def test_no_rows(spark, table, tmp_path):
    empty = table(rows_of(5, 1)).limit(0)
    assert C.repairs(empty).count() == 0
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op11_conversation_repair(spark, str(tmp_path)).count() == 0


def test_all_rows_dropped(spark, table, tmp_path):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table([(conv, 0, "user", "Hi.")]).write.parquet(f"{tmp_path}/conversations.parquet")
    got = values(C.op11_conversation_repair(spark, str(tmp_path)))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
