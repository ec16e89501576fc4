"""Token files: round trip, single documents, checksums, repeated tasks, edge cases."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from stockweave.llm import tokens as K
from stockweave.llm.queries import QUERIES, vocabulary
from stockweave.sources.files import scratch_path

SF = "/root/testdata/sf0.001"
HARD = ["", " ", "a  b", " lead", "trail ", "x\n\n y", "a\tb c", "don't we'll 's", "1 2,3 4.", "é. ,a .b c.", " x 　y", "word,, two.. x", "ªº ² x", "\n", "日本 語。 ok", "é á.", "x ʰ, ǅ.",
        "a" * 5000, " ." * 500, "\x1c a\x1c b"]


def test_words_give_the_ids_of_whole_texts():
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    encoder = K.ByteBpe(vocabulary("byte_bpe_50k.json"), 2)
    for text in HARD:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_words_of_letters_and_signs_need_no_library_call():
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    encoder, called = K.ByteBpe(vocabulary("byte_bpe_50k.json"), 2), []
    library = encoder._encode
    encoder._encode = lambda text: called.append(text) or library(text)
    for text in ["Word a$$$ ab.%%% es.\nNdor el.\nés, él'\ns x, que!!", "és sí.\nno*** (_) a_ b- c"]:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == model.encode(text, add_special_tokens=False).ids, text
    assert called == [" (_)"]
    for text in ["$$$ a", "x a.\n\nb c", "x a.\n1 b", "x a.\nb1 c", "x a½. b", "x a.\n½. b", "x a<|endoftext|>b <|endoftext|> c.", "x a'.\n's b'll a'\nll", "a\u0301. b\u0301\nc", "x a.\x1cb a…\nb a.\x85b", "x a.\r\nb", "é", "x_y a"]:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(K, "CACHE_ENTRIES", 3)
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    encoder = K.ByteBpe(vocabulary("byte_bpe_50k.json"), 2)
    for k in range(20):
        text = " ".join(f"word{chr(97 + (k * j) % 26)} more{j}, end." for j in range(6))
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == model.encode(text, add_special_tokens=False).ids


def test_query_equals_direct_encoding(spark):
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, start = [], 0
    for i, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op10_token_frames"](spark, SF).collect()) == want


def test_single_documents_and_rolling(spark, docs, monkeypatch):
    monkeypatch.setattr(K, "ROLL_BYTES", 100)
    data = docs([(i, f"text number {i} " * (i % 4)) for i in range(30)])
    manifest = K.write_token_files(data, scratch_path(spark, "t"), vocabulary("byte_bpe_50k.json"), 2).cache()
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {r["key"]: list(r["ids"]) for r in K.read_documents(spark, manifest, [7, 21, 99]).collect()}
    assert got == {i: model.encode(f"text number {i} " * (i % 4), add_special_tokens=False).ids + [2] for i in (7, 21)}
    assert sum(r["n_docs"] for r in manifest.collect()) == 30


def test_damage_is_noticed(tmp_path):
    frames = [b"x"]
    import zstandard, xxhash  # noqa: E401
    raw = np.arange(50, dtype="<u2").tobytes()
    frames = [zstandard.ZstdCompressor().compress(raw)]
    good = K.pack_file(frames, [len(raw)], [xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF], [5], [50], 2)
    bad = K.pack_file(frames, [len(raw)], [1], [5], [50], 2)
    for name, body in (("good", good), ("bad", bad), ("cut", good[:-1])):
        (tmp_path / name).write_bytes(body)
    store, folder = K.open_store(str(tmp_path))
    (_, key, ids), = K.read_frames(store.open_input_file(f"{folder}/good"))
    assert key == 5 and ids.tolist() == list(range(50))
    for name in ("bad", "cut"):
        with pytest.raises(ValueError):
            list(K.read_frames(store.open_input_file(f"{folder}/{name}")))


def test_edge_cases(spark, awkward):
    path = vocabulary("byte_bpe_50k.json")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = K.read_token_files(K.write_token_files(awkward, scratch_path(spark, "t"), path, 2), schema, K.ids_digest).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6]
    assert rows[1]["n_tokens"] == 1 and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))
    empty = K.write_token_files(awkward.limit(0), scratch_path(spark, "t"), path, 2)
    assert empty.collect() == [] and K.read_token_files(empty, schema, K.ids_digest).collect() == []
