import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import prose
from tokenizers import Tokenizer

from textbench.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))


def test_word_by_word_ids_are_the_tokenizers(tokenizer, odd_rows):
    texts = [t or "" for _, t, *_ in odd_rows] + [
        "it's don't We'LL 'quoted' a'b", "<|endoftext|> a<|startoftext|>b <| x", "`a~b_c-d1234,5.6 [x]{y}|z\\w^&*()",
        "\x00\x01 a\x7fb nb\xa0sp \x1csep", "Ünïcode ſtraße ΑΣ İstanbul x́y 你好 🙂🙂 １２３ ½ x²", "× ÷ a×b Þþ Ðð ªº µ ß",
    ]
    for text, ids in zip(texts, P.WordIds(P.TOKENIZER).texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [2048, 64])
def test_round_trip_and_padding(tokenizer, documents, odd_rows, capacity):
    rows = odd_rows + [(400 + i, prose(80 + i, 10 + 7 * i), "en", "z") for i in range(150)]
    got = P.pack(documents(rows).repartition(5), capacity=capacity).toPandas()
    by_id = {}
    for i, t, *_ in rows:
        by_id.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    for i, wanted in by_id.items():
        own = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        assert own.length.sum() == sum(map(len, wanted))
        for r in own.itertuples():
            fits = [ids for ids in wanted if len(ids) == r.doc_tokens]
            data = [np.array(ids[r.start : r.start + r.length], "<u4").tobytes() for ids in fits]
            assert r.ids_crc32 in {zlib.crc32(d) for d in data}
    sequences = got.sort_values("offset").groupby("sequence_id")
    for _, s in sequences:
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= capacity
    used = got.length.sum()
    assert len(sequences) * capacity - used < 0.05 * used + 2 * capacity


def test_cuts_cover_every_length():
    for n in range(1, 5000, 7):
        pieces = P.cut(n)
        assert sum(length for length, _ in pieces) == n
        assert all(length * k <= P.CAPACITY and length > 0 for length, k in pieces)


def test_empty_table(empty):
    assert P.pack(empty).count() == 0
