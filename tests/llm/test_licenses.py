import random
import re
import time

import pytest
from llm_helpers import alnum

from textbench.llm import licenses as L


def test_base_by_brute_force(documents, odd_rows):
    texts = [
        "Under the MIT License. under THE mit, license!", "summit license under the mit licenses", "Apache-License, Version 2.0 and cc by nc é cc-by-nc",
        "xcc by nc cc by ncé", "licensed under the terms of the GNU GPL v3", "SPDX-License-Identifier: MPL-2.0", "the mit license", "All rights reserved.",
    ]
    rows = odd_rows + [(600 + i, t, "en", "z") for i, t in enumerate(texts)]
    got = L.scan(documents(rows).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        for i, t, *_ in rows:
            if i == r["doc_id"] and i is not None:
                words, places, labels = alnum(t), [], set()
                for phrase, label in L.BASE.items():
                    p = phrase.split()
                    at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
                    places += at
                    labels |= {label} if at else set()
                assert (r["n_words"], r["n_base"]) == (len(words), len(places))
                assert (r["first_word"], r["last_word"]) == (min(places, default=None), max(places, default=None))
                assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(","))
                assert 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[604] == "gpl-3" and labels[605] == "mpl-2" and labels[606] == "mit" and labels[607] == "proprietary"
    assert labels[1] == labels[2] == "" and next(r["score"] for r in got if r["doc_id"] == 605) == 0.9


def test_suppression_keeps_the_surest():
    ordered = L.rules()
    assert len(ordered) > 300 and [r.priority for r in ordered] == sorted((r.priority for r in ordered), reverse=True)
    found = L.detect(b"licensed under the apache license 2.0, cc by nc", ordered)
    assert {(d.label, d.priority) for d in found} == {("apache-2", 80), ("cc-by-nc", 100)}


def test_empty_table(empty):
    assert L.scan(empty).count() == 0


def test_rules_are_written_by_hand():
    """Hundreds of signatures, no two alike, each behind a keyword that its matches hold."""
    ordered = L.rules()
    patterns = [(r.label, r.pattern.pattern) for r in ordered]
    assert len(set(patterns)) == len(patterns) > 300
    assert len({r.pattern.pattern for r in ordered}) == len(patterns)
    for label, signatures in L.SIGNATURES.items():
        for _, keyword, words in signatures:
            assert keyword in words, (label, words)


@pytest.mark.parametrize(("text", "labels"), [
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", {"mit", "apache-2", "bsd-3-clause"}),
    ("// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", {"gpl-2", "gpl-exception"}),
    ("SPDX-License-Identifier: LGPL-2.1-only\nMPL-2.0", {"lgpl-2.1", "mpl-2"}),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", {"apache-2"}),
    ("GNU Lesser General Public License, version 2.1", {"lgpl-2.1"}),
    ("GNU Affero General Public License v3.0 or later", {"agpl-3"}),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", {"cc-by-nc-sa"}),
    ("released under a 3-clause BSD license", {"bsd-3-clause"}),
    ("The Software shall be used for Good, not Evil.", {"json"}),
    ("a summit, a limit, and transmit", set()),
])
def test_signatures(text, labels):
    assert {d.label for d in L.detect(text.lower().encode(), L.rules())} == labels


def test_suppression_by_brute_force():
    r = random.Random(4)
    for _ in range(300):
        found = []
        for _ in range(r.randrange(15)):
            a = r.randrange(30)
            found.append(L.Detection(r.choice("abc"), r.choice([30, 60, 60, 80, 100]), a, a + r.randrange(1, 12), r.random() < 0.1))
        want = []
        for i, d in enumerate(found):
            inside = [
                e for j, e in enumerate(found)
                if i != j and e.start <= d.start and d.end <= e.end
                and (e.priority > d.priority or e.priority == d.priority and ((e.start, e.end) != (d.start, d.end) or j < i))
            ]
            if d.base or not inside:
                want.append(d)
        got = L.resolve(found)
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_many_detections_take_time_in_proportion():
    data = b"licensed under the mit license. all rights reserved; apache 2.0 " * 20_000
    began = time.time()
    assert len(L.detect(data, L.rules())) >= 60_000
    assert time.time() - began < 20


def test_keywords_lose_no_match():
    """What the patterns find without any prefilter is what the gated rules find."""
    ordered = L.rules()
    gated = L.Prefilter(ordered)
    assert all(r.keywords for r in ordered)
    r = random.Random(5)
    samples = [words for signatures in L.SIGNATURES.values() for _, _, words in signatures]
    for _ in range(150):
        text = []
        for words in r.sample(samples, 4):  # optional parts there or not, one of each alternative
            while (m := re.search(r"\((?:\?:)?([^()]*)\)(\??)", words)):
                one = r.choice(m[1].split("|"))
                words = words[: m.start()] + ("" if m[2] and r.random() < 0.5 else one) + words[m.end() :]
            words = re.sub(r"_\?", "_", words)
            words = re.sub(r"\[([^\]]*)\](?:\{[^}]*\})?", lambda m: m[1][0], words)
            words = re.sub(r"\.\{[^}]*\}\??", "x", words).replace("?", "").replace("\\", "")
            text.append(words.replace("_", r.choice([" ", ", ", "-", " \n "])))
        data = ". ".join(text).encode()
        plain = [(rule.label, *m.span()) for rule in ordered for m in rule.pattern.finditer(data)]
        assert sorted((d.label, d.start, d.end) for d in L.search(data, gated)) == sorted(plain)
        assert plain
