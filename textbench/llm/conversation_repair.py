"""Cheapest repair of a conversation's structure by iterative-deepening A*.

Edits go through the rows in order: Delete a row, Insert a turn without text, Keep a row,
Rerole it to user or assistant. The search is depth first, tries edits in ASCII order of
their initials, and gives a path up as soon as its cost and the least that the rest can
cost exceed the bound. A bound that no path meets rises to the least cost that exceeded
it. A state (row, roles so far) that failed is kept with the cost it had left, and is not
entered again with as little. So the first path that ends in an accepted state is the
cheapest, and of those the first in ASCII order.

What the rest costs at least is what it would cost if the conversation might end after
any role. That is at most two inserted turns too little, so few bounds are tried and the
work is in proportion to the rows, however long a conversation is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.streams import digests, groups
from textbench.operators.rows import sorted_numbers
from textbench.session import materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Lines that are joined by one task ahead of the digest.
PART = 256
#: Conversations of up to so many rows are looked up if the same pattern was searched before.
REMEMBERED_ROWS, REMEMBERED = 32, 50_000
BATCH_ROWS = 5000
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

# roles so far: none, system, up to a user's turn, up to an assistant's
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The role that may follow and the state after it; one of the start may also be the system's.
NEXT_ROLE = ("u", "u", "a", "u")
NEXT = (USER, USER, ASSISTANT, USER)

# a row is a letter: the initial of its role (u, a, s, o for others), in upper case if it is truncated
MUST_GO = "x"


def after(state: int, initial: str) -> int | None:
    """The state after a row of that role is kept, None if it cannot be."""
    if initial == NEXT_ROLE[state]:
        return NEXT[state]
    return SYSTEM if initial == "s" and state == START else None


def rest_costs(rows: str) -> np.ndarray:
    """Of each row and state, what the rows from there on cost at least: exact for a
    grammar that may end anywhere. Rows are initials, in upper case if truncated."""
    least = np.zeros((len(rows) + 1, 4), dtype=np.int64)
    later = [0, 0, 0, 0]
    for i in range(len(rows) - 1, -1, -1):
        initial = rows[i].lower()
        open_cost = TRUNCATED if rows[i] != initial else 0
        now = []
        for state in range(4):
            cost = later[state] + DELETE
            if initial != MUST_GO:
                kept = after(state, initial)
                if kept is not None:
                    cost = min(cost, later[kept] + open_cost)
                cost = min(cost, later[NEXT[state]] + REROLE + open_cost)
            now.append(cost)
        # an inserted turn leads to another state at the same row; two rounds settle it
        for _ in range(2):
            now = [min(now[s], now[NEXT[s]] + INSERT) for s in range(4)]
        least[i] = later = now
    return least


def _moves(row: str, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows used, state after), in ASCII order. No row: ``row`` is empty."""
    insert = ("I", INSERT, 0, NEXT[state])
    if not row:
        return [insert]
    initial = row.lower()
    moves = [("D", DELETE, 1, state), insert]
    if initial != MUST_GO:
        open_cost = TRUNCATED if row != initial else 0
        kept = after(state, initial)
        if kept is not None:
            moves.append(("K", open_cost, 1, kept))
        moves.append(("R", REROLE + open_cost, 1, NEXT[state]))
    return moves


MOVES = {(row, state): _moves(row, state) for row in ["", MUST_GO, *"uasoUASO"] for state in range(4)}


def within(rows: str, least: np.ndarray, bound: int) -> tuple[str | None, int]:
    """The first accepted path of that cost at most; else None and the least cost that exceeded it."""
    n, over = len(rows), None
    failed: dict[tuple[int, int], int] = {}
    path = bytearray()
    # of each open place: row, state, cost so far, moves left
    stack: list[tuple[int, int, int, Iterator]] = [(0, START, 0, iter(MOVES[rows[:1], START]))]
    while stack:
        i, state, cost, moves = stack[-1]
        if i == n and state in ENDS:
            return path.decode(), cost
        for edit, price, used, to in moves:
            total = cost + price
            estimate = total + int(least[i + used, to])
            if estimate > bound:
                over = estimate if over is None else min(over, estimate)
            elif failed.get((i + used, to), -1) < bound - total:
                path.append(ord(edit))
                stack.append((i + used, to, total, iter(MOVES[rows[i + used : i + used + 1], to])))
                break
        else:
            failed[i, state] = max(failed.get((i, state), -1), bound - cost)
            stack.pop()
            if path:
                path.pop()
    return None, over


def repair(rows: str) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair. ``rows`` has a letter for each row: u, a, s, or o
    for other roles, in upper case if it is truncated; x for one that must go."""
    least = rest_costs(rows)
    bound = int(least[0, START])
    while True:
        path, cost = within(rows, least, bound)
        if path is not None:
            return cost, path
        bound = cost


def turns_of(rows: str, edits: str) -> list[tuple[str, str]]:
    """Of each row, and of the end: (inserted roles ahead of it, its role's initial if changed
    or '=' if kept, '' if deleted)."""
    out, state, i, ahead = [], START, 0, ""
    for edit in edits:
        if edit == "D":
            out.append((ahead, ""))
        elif edit == "K":
            out.append((ahead, "="))
            state = after(state, rows[i].lower())
        elif edit == "R":
            out.append((ahead, NEXT_ROLE[state]))
            state = NEXT[state]
        else:
            ahead += NEXT_ROLE[state]
            state = NEXT[state]
            continue
        i, ahead = i + 1, ""
    return [*out, (ahead, "")]


# -- rows --------------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text): the rows after damage by a hash of conversation and turn.

    One in twenty is dropped, emptied, loses its sentence ends, is repeated next to itself,
    becomes the user's. NULL values count as one blank, but NULL turns stay so for their order.
    """
    def known(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select(
        known("conv_id").alias("conv"), F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        known("turn").alias("at"), known("role").alias("role"), known("text").alias("text"),
    )
    kind = F.crc32(F.concat("conv", F.lit(":"), "at").cast("binary")) % 20
    rows = rows.withColumn("kind", kind).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv", "conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def compact(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, content, state) of ``rows`` (conv, turn, role, text): a hash of role
    and text, and whether the text is blank, open (does not end a sentence) or whole."""
    text = F.rtrim(F.col("text"), F.lit(SPACE))
    state = F.when(text == "", "blank").when(F.substring(text, -1, 1).isin(".", "!", "?"), "whole").otherwise("open")
    return rows.select("conv", "turn", "role", _content().alias("content"), state.alias("state"))


def _content() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def faulty_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (see ``compact``) in order: conv, place in the conversation, role, content,
    fault and letter (see ``repair``); the first fault counts. Rows of one turn stand in the
    order of role and content."""
    numbered = sorted_numbers(rows, ["conv", F.col("turn").asc_nulls_first(), "role", "content"])
    earliest = numbered.groupBy("conv", "content").agg(F.min("number").alias("earliest"))
    first = numbered.groupBy("conv").agg(F.min("number").alias("first"))
    numbered = numbered.join(first, "conv").join(earliest, ["conv", "content"])
    fault = (
        F.when(F.col("state") == "blank", "blank")
        .when(F.col("number") > F.col("earliest"), "duplicate")
        .when(F.col("state") == "open", "truncated")
    )
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("u", "a", "s"), initial).otherwise("o")
    letter = F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", F.upper(plain)).otherwise(plain)
    place = (F.col("number") - F.col("first")).alias("place")
    return materialize(numbered.select("conv", place, "role", "content", fault.alias("fault"), letter.alias("letter")))


FOUND = "conv string, place bigint, ahead string, changed string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each row, and with that behind the last row the conversation's counts."""
    known = lru_cache(REMEMBERED)(repair)
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    names = ["conv", "place", "ahead", "changed", *_COUNTS, "audit"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * len(_COUNTS), pa.string()]
    out: list[list] = [[] for _ in names]

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)
        for values in out:
            values.clear()
        return batch

    for rows in groups(batches, ["conv"]):
        letters = "".join(rows.column("letter").to_pylist())
        cost, audit = known(letters) if len(letters) <= REMEMBERED_ROWS else repair(letters)
        edits = turns_of(letters, audit)
        faults, initials = rows.column("fault").to_pylist(), rows.column("initial").to_pylist()
        illegal = sum(pair not in legal for pair in zip(initials, initials[1:], strict=False))
        n = len(letters)
        counts = [faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit]
        new = [[rows.column("conv")[0].as_py()] * (n + 1), range(n + 1), [a for a, _ in edits], [c for _, c in edits]]
        for values, more in zip(out, [*new, *([None] * n + [v] for v in counts)], strict=True):
            values.extend(more)
        if len(out[0]) >= BATCH_ROWS:
            yield flushed()
    yield flushed()


def _line(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(":"), text)


def repaired_lines(rows: DataFrame, edits: DataFrame, texts: DataFrame) -> DataFrame:
    """(conv, place, line): the lines that each of ``rows`` (see ``faulty_rows``) leaves, inserted
    ones ahead of it first, joined by newlines; NULL if none. A row that stays is the only
    one of its content, so its text is looked up in ``texts`` (conv, role, text) by that."""
    both = edits.select("conv", "place", "ahead", "changed").join(rows.select("conv", "place", "role", "content"), ["conv", "place"], "left")
    texts = texts.select("conv", _content().alias("content"), "text").groupBy("conv", "content").agg(F.first("text").alias("text"))
    both = both.filter("ahead != '' or changed != ''").join(texts, ["conv", "content"], "left")

    def role(initial):
        return F.when(initial == "u", "user").otherwise("assistant")

    ahead = F.transform(F.split("ahead", ""), lambda x: F.when(x != "", _line(role(x), F.lit(""))))
    changed = F.col("changed")
    own = F.when(changed == "=", _line(F.col("role"), F.col("text"))).when(changed != "", _line(role(changed), F.col("text")))
    line = F.nullif(F.array_join(F.concat(ahead, F.array(own)), "\n"), F.lit(""))
    return both.select("conv", "place", line.alias("line"))


def repairs(conversations: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation of (conv_id, turn, role, text), as it is.

    Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Rows without a conv_id are one conversation, that of NULL. Rows without a turn come
    first, ties of a turn stand in the order of role and of a hash of the text. NULL
    roles and texts are one blank. Equal rows are duplicates of the first. Other columns
    are ignored; a table without rows gives none.

    A conversation's letters, one of a few for each row, are searched by one task, some
    hundred bytes a row; its texts never meet but in the digest, which reads them one
    after the other.
    """
    def known(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select(
        known("conv_id").alias("conv"), F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        known("role").alias("role"), known("text").alias("text"),
    )
    return _repaired(rows)


def _repaired(rows: DataFrame) -> DataFrame:
    rows = materialize(rows)
    turns = rows.groupBy("conv").agg(
        F.min("conv_id").alias("conv_id"),
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
    )
    marked = faulty_rows(compact(rows))
    letters = marked.select("conv", "place", "fault", "letter", F.substring("role", 1, 1).alias("initial"))
    letters = letters.repartition("conv").sortWithinPartitions("conv", "place")
    edits = materialize(letters.mapInArrow(_search, FOUND))
    counts = edits.filter("audit is not null").select("conv", *_COUNTS, "audit")
    lines = repaired_lines(marked, edits, rows).filter("line is not null")
    part = F.floor(F.col("place") / PART).alias("part")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    parts = lines.groupBy("conv", part).agg(joined.alias("lines"))
    hashes = digests(parts, "conv", "part", "lines", "\n").withColumnRenamed("sha256", "repaired_sha256")
    out = turns.join(counts, "conv").join(hashes, "conv", "left")
    return out.select(
        "conv_id",
        F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"),
        *_COUNTS,
        "audit",
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """``repairs`` of the conversations after ``damaged``; one that has lost all rows needs none."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = _repaired(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("own")).distinct()
    found = ids.join(found, F.col("own").eqNullSafe(F.col("conv_id")), "left")
    zero = F.lit(0).cast("bigint")
    return found.select(
        F.col("own").alias("conv_id"),
        *(F.coalesce(c, zero).alias(c) for c in ["gaps", *_COUNTS]),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )
