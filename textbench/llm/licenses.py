"""License scans by ordered signature rules.

Every rule is a hand-written pattern over lower-cased text with a keyword, a label and a
priority (``license_rules``). A text is searched only by rules whose keyword it contains,
and the longest words that the pattern cannot do without.
Identifiers of a license expression, joined by AND, OR and WITH, are detections each.
Detections that overlap are resolved: one inside the span of a detection of at least its
priority is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.license_rules import IDENTIFIERS, SIGNATURES
from textbench.llm.words import IS_WORD, TO_LOWER, known_id, spans, with_missing_ids

# fixed values: the base's phrases and labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

GAP = r"[^0-9a-z\x80-\xff]+"
BEFORE, BEHIND = r"(?<![0-9a-z\x80-\xff])", r"(?![0-9a-z\x80-\xff])"
#: Words of a signature that a text must hold to be searched for it, besides the keyword.
MOST_KEYWORDS = 4
BASE_PRIORITY, IDENTIFIER_PRIORITY = 100, 90
EXPRESSION = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n\"'*<>;]{1,400})")
IDENTIFIER = re.compile(rb"[0-9a-z][0-9a-z.-]*[0-9a-z]|[0-9a-z]")
OPERATORS = {b"and", b"or", b"with"}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    base: bool = False


def needed_words(words: str) -> list[str]:
    """The plain words that every match of a signature holds, longest first."""
    group = re.compile(r"\((?:\?:)?[^()]*\)\??")
    while group.search(words):  # what is optional or has alternatives, from the inside
        words = group.sub("#", words)
    plain = re.split("_(?!\\?)", words)
    return sorted({w for w in plain if re.fullmatch("[0-9a-z]+", w)}, key=lambda w: (-len(w), w))


def _rule(label: str, priority: int, keyword: str, words: str, base: bool = False) -> Rule:
    # an optional gap may also be none
    pattern = words.replace("_?", f"(?:{GAP})?").replace("_", GAP)
    gates = dict.fromkeys([*needed_words(words)[:MOST_KEYWORDS], keyword])
    keywords = tuple(k.encode() for k in gates)
    return Rule(label, priority, keywords, re.compile(BEFORE.encode() + pattern.encode() + BEHIND.encode()), base)


def rules() -> list[Rule]:
    """All rules in order: the base's, then by priority, then as they are listed."""
    out = [_rule(label, BASE_PRIORITY, max(words.split(), key=len), words.replace(" ", "_"), True) for words, label in BASE.items()]
    out += [_rule(label, *signature) for label, signatures in SIGNATURES.items() for signature in signatures]
    return sorted(out, key=lambda rule: -rule.priority)


@dataclass(frozen=True)
class Detection:
    label: str
    priority: int
    start: int
    end: int
    base: bool


def identifiers(data: bytes) -> Iterator[Detection]:
    """The known identifiers of all license expressions, with or without what versions
    are meant (+, -only, -or-later)."""
    for m in EXPRESSION.finditer(data):
        for name in IDENTIFIER.finditer(m[1]):
            if name[0] in OPERATORS:
                continue
            plain = name[0].decode().removesuffix("-only").removesuffix("-or-later")
            if plain in IDENTIFIERS:
                yield Detection(IDENTIFIERS[plain], IDENTIFIER_PRIORITY, m.start(1) + name.start(), m.start(1) + name.end(), False)


class Prefilter:
    """Finds the rules whose keywords a text holds, all of them in one pass over the text."""

    def __init__(self, ordered: list[Rule]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.of_first: dict[bytes, list[int]] = {}
        for place, rule in enumerate(ordered):
            self.of_first.setdefault(rule.keywords[0], []).append(place)
            for keyword in rule.keywords:
                self.automaton.add_word(keyword.decode("latin-1"), keyword)
        self.automaton.make_automaton()
        self.ordered = ordered

    def rules_for(self, data: bytes) -> list[Rule]:
        """The rules to search ``data`` by, in their order."""
        present = {keyword for _, keyword in self.automaton.iter(data.decode("latin-1"))}
        asked = (place for keyword in present for place in self.of_first.get(keyword, ()))
        return [self.ordered[place] for place in sorted(asked) if present.issuperset(self.ordered[place].keywords)]


def search(data: bytes, prefilter: Prefilter) -> list[Detection]:
    """Everything that the rules find in lower-cased UTF-8, in their order."""
    found = list(identifiers(data)) if b"spdx-license" in data else []
    for rule in prefilter.rules_for(data):
        found += [Detection(rule.label, rule.priority, *m.span(), rule.base) for m in rule.pattern.finditer(data)]
    return found


def resolve(found: list[Detection]) -> list[Detection]:
    """``found`` without detections inside one of at least their priority, by place.

    Of equal spans and priorities the first stays. Detections of the base always do. One
    sweep for each priority: the intervals kept so far, by start, with the greatest end
    up to each, tell what lies inside one of them.
    """
    kept: list[Detection] = []
    starts = ends = np.zeros(0, dtype=np.int64)
    for _, level in groupby(sorted(found, key=lambda d: -d.priority), key=lambda d: d.priority):
        level = sorted(level, key=lambda d: (d.start, -d.end))  # what contains another comes first
        reach = -1
        for d, at in zip(level, np.searchsorted(starts, [d.start for d in level], side="right"), strict=True):
            inside = d.end <= reach or at > 0 and d.end <= ends[at - 1]
            reach = max(reach, d.end)
            if d.base or not inside:
                kept.append(d)
        order = sorted((d.start, d.end) for d in kept)
        starts = np.array([a for a, _ in order], dtype=np.int64)
        ends = np.maximum.accumulate(np.array([b for _, b in order], dtype=np.int64))
    return sorted(kept, key=lambda d: (d.start, -d.end))


def detect(data: bytes, rules: list[Rule] | Prefilter) -> list[Detection]:
    """Detections in lower-cased UTF-8 that are not suppressed."""
    return resolve(search(data, rules if isinstance(rules, Prefilter) else Prefilter(rules)))


_LOWER = bytes(TO_LOWER.tolist())
KINDS = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, detections array<struct<label:string,priority:int,first_word:int,last_word:int>>"
)


def scan(documents: DataFrame) -> DataFrame:
    """Per row: word count, places of the base's phrases, labels, score, detections.

    Words are counted over the whole text, lower-cased in A-Z only; detections tell
    their first and last word. ``score`` is the surest detection's priority over 100,
    0 without any. NULL and empty texts have no words and no labels; very long texts are
    searched whole, in time about in proportion; ties are resolved as ``resolve`` says;
    repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    ordered = rules()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prefilter = Prefilter(ordered)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
                starts, _ = spans(IS_WORD[np.frombuffer(data, dtype=np.uint8)])
                found = detect(data, prefilter)
                word = np.searchsorted(starts, [d.start for d in found]).tolist()
                last = (np.searchsorted(starts, [d.end for d in found]) - 1).tolist()
                base = [w for d, w in zip(found, word, strict=True) if d.base]
                rows.append(
                    (
                        len(starts),
                        len(base),
                        min(base, default=None),
                        max(base, default=None),
                        ",".join(sorted({d.label for d in found if d.base})),
                        ",".join(sorted({d.label for d in found})),
                        max((d.priority for d in found), default=0) / 100,
                        [
                            {"label": d.label, "priority": d.priority, "first_word": a, "last_word": b}
                            for d, a, b in zip(found, word, last, strict=True)
                        ],
                    )
                )
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    rows = documents.select(known_id(F.col("doc_id")), F.coalesce("text", F.lit("")).alias("text"))
    return with_missing_ids(rows.mapInPandas(run, KINDS))


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
