"""Piece ids against the library's, decoding, bounded caches, edge cases."""

import random

import numpy as np
import pytest
import sentencepiece

from stockweave.llm import pieces as P
from stockweave.llm.queries import QUERIES, table, vocabulary

SF = "/root/testdata/sf0.01"
PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_ids_equal_the_library(library):
    rng = random.Random(9)
    hard = ["a", " ", "  x  y ", "é日本語 ok", "\n\n", "x▁y z", "▁", "▁▁ a", "a" * 400, "tab\there", "😀😀 a", "1234567 89", "=" * 50, "the  the   the", "\x00 nul", "İstanbul", "--- ... !!!", "                 x"]
    hard += ["".join(rng.choice("abcdeist hnor  .,\né1") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    encoder = P.PieceEncoder(P.PieceModel.load(PATH))
    for text, packed in zip(hard, encoder.encode_batch(hard)):
        assert ids(packed) == library.encode(text), text
        if "▁" not in text:
            assert encoder.decode(packed) == text


def test_small_blocks_and_cache_change_nothing(library, monkeypatch):
    monkeypatch.setattr(P, "BATCH_CHARS", 20)
    monkeypatch.setattr(P, "CACHE_ENTRIES", 10)
    monkeypatch.setattr(P, "PAIR_SLOTS", 1 << 20)
    encoder = P.PieceEncoder(P.PieceModel.load(PATH))
    for k in range(30):
        text = f"some words number {k} and {k * k} again, with-{k} punctuation"
        assert ids(encoder.encode_batch([text])[0]) == library.encode(text)


def test_query_equals_library(spark, library):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for r in QUERIES["op5_suffix_pieces"](spark, SF).collect():
        want = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes())) and r["round_trip"]


def test_edge_cases(spark, awkward, library):
    coded = awkward.select("doc_id", "text", P.encode(awkward["text"], PATH).alias("i"))
    rows = coded.select("doc_id", "text", "i", P.decode(coded["i"], PATH).alias("back")).collect()
    assert len(rows) == 8 and all(r["back"] == r["text"] for r in rows)
    assert all((r["i"] is None) == (r["text"] is None) for r in rows)
    assert all(ids(r["i"]) == library.encode(r["text"]) for r in rows if r["text"])
    assert awkward.limit(0).select(P.encode(awkward["text"], PATH).alias("i")).collect() == []
