"""Token-ID files: independent zstandard frames, one per document, with a trailing seek table.

File layout (all integers little endian, the public zstandard seekable layout):

* one zstandard frame per document: its token ids as unsigned 16 or 32 bit integers;
* a skippable frame (magic 0x184D2A50) with the documents' index: ``key int64, n_tokens uint32`` each and, last,
  the id width in bytes; keys that are null are stored as the smallest int64;
* a skippable frame (magic 0x184D2A5E) with the seek table: per frame its compressed size, its decompressed size and
  the low 32 bits of the XXH64 of its content; then the number of frames, a flag byte and the magic 0x8F92EAB1.

A reader fetches the footer, then only the frames it wants. Files roll at ``ROLL_BYTES``, so memory is bounded by one
file, whatever the number of documents. They are written under a temporary name and renamed, so that a repeated or
duplicated task leaves the same file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ROLL_BYTES = 32 << 20
CACHE_ENTRIES = 300_000
SIGN_ENTRIES = 10_000
CHUNK_CHARS = 1 << 16
NULL_KEY = -(1 << 63)
_DOUBLE_SPACE = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_SIGNS = r"([!-/:-@\[-`{-~]+)"
_UNITS = re.compile(rf"([^\W\d_]+){_SIGNS}(?:\n([^\W\d_]+){_SIGNS}?)?")

MANIFEST = "file string, part int, seq int, n_docs long, n_tokens long"



def byte_letters() -> dict[int, str]:
    """Byte to the visible letter that stands for it in byte-level vocabularies (fixed by the file format)."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Words(dict):
    """Ids of `` word`` by word; a missing one is taken from the old generation or encoded."""

    def __init__(self, encoder: ByteBpe) -> None:
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        encoder = self.encoder
        ids = encoder.old.get(word)
        if ids is None:
            ids = encoder._letters(word) if word.isalpha() else encoder._find(word)
        self[word] = ids
        return ids


class ByteBpe:
    """Encodes whole texts with a byte-level BPE file, one call per unseen word.

    The file's pre-tokenizer never joins text across a single space between two visible characters, so a text may be
    cut there and the words encoded one by one. It also takes a run of letters with its space as one unit, a run of
    ASCII signs after it as one, and a line break between sign and letter as one. So words of these go unit by unit
    straight to the merges; others, and those that hold an added token, go through the library. Words already seen
    come from a bounded cache of two generations: when the young one is full, it becomes the old one.
    """

    def __init__(self, path: str, width: int) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.dtype = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        self.young, self.old, self.letters, self.signs = _Words(self), {}, byte_letters(), {}
        self.space = self.letters[32]
        self.merges = self.model.model.tokenize
        added = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        top = max(self.model.get_vocab().values())
        self.packed = [i.to_bytes(width, "little") for i in range(min(top + 1, 1 << 8 * width))]

    def _encode(self, text: str) -> bytes:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _merge(self, unit: str) -> bytes:
        seen = unit.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merges(seen)])

    def _letters(self, word: str) -> bytes:
        """A run of letters after a space."""
        if not word.isascii():
            return self._merge(" " + word)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merges(self.space + word)])

    def _sign(self, signs: str) -> bytes:
        ids = self.signs.get(signs)
        if ids is None:
            ids = self._merge(signs)
            if len(self.signs) < SIGN_ENTRIES:
                self.signs[signs] = ids
        return ids

    def _find(self, word: str) -> bytes:
        """The ids of `` word``, of a word that is not in the caches."""
        found = _UNITS.fullmatch(word)
        if found is None or self.added.search(word):
            return self._encode(" " + word)
        first, signs, line, more = found.groups()
        if not first.isalpha() or (line and not line.isalpha()):  # numbers that are no digits
            return self._encode(" " + word)
        ids = (self.young.get(first) or self.old.get(first) or self._letters(first)) + self._sign(signs)
        if line:
            ids += self._sign("\n") + self._merge(line) + (self._sign(more) if more else b"")
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self.young) > CACHE_ENTRIES:
            self.old, self.young = self.young, _Words(self)
        plain = text[0] != " " and text[-1] != " " and not _DOUBLE_SPACE.search(text)
        words = text.split(" ") if plain else _SAFE_CUT.split(text)
        first = self._merge(words[0]) if words[0].isalpha() else self._encode(words[0])
        return first + b"".join(map(self.young.__getitem__, words[1:]))


_ENCODERS: dict[tuple, ByteBpe] = {}


def byte_bpe(path: str, width: int) -> ByteBpe:
    """The worker's encoder of this file, loaded once."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = ByteBpe(path, width)
    return _ENCODERS[path, width]


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def pack_file(frames: list[bytes], sizes: list[int], sums: list[int], keys: list[int], counts: list[int], width: int) -> bytes:
    index = np.zeros(len(keys), [("key", "<i8"), ("n", "<u4")])
    index["key"], index["n"] = keys, counts
    index_body = index.tobytes() + bytes([width])
    table = b"".join(struct.pack("<III", len(f), s, c) for f, s, c in zip(frames, sizes, sums))
    table += struct.pack("<IBI", len(frames), 0x80, FOOTER_MAGIC)
    return b"".join([*frames, struct.pack("<II", INDEX_MAGIC, len(index_body)), index_body, struct.pack("<II", SEEK_MAGIC, len(table)), table])


def read_footer(handle) -> tuple[np.ndarray, np.ndarray, int]:
    """The seek table, the index and the id width of an open file."""
    size = handle.size()
    handle.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", handle.read(9))
    if magic != FOOTER_MAGIC or flags != 0x80:
        raise ValueError("not a seekable token file")
    start = size - 9 - 12 * count
    handle.seek(start)
    seek = np.frombuffer(handle.read(12 * count), [("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])
    handle.seek(start - 8 - 12 * count - 1)
    body = handle.read(12 * count + 1)
    return seek, np.frombuffer(body[:-1], [("key", "<i8"), ("n", "<u4")]), body[-1]


def read_frames(handle, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(position, key, ids)`` of the wanted documents; only their frames are read, and their checksums verified."""
    seek, index, width = read_footer(handle)
    starts = np.concatenate([[0], np.cumsum(seek["packed"], dtype=np.int64)])
    picked = np.arange(len(index)) if wanted is None else np.flatnonzero(wanted(index["key"]))
    unpack = zstandard.ZstdDecompressor()
    for i in picked.tolist():
        handle.seek(int(starts[i]))
        raw = unpack.decompress(handle.read(int(seek["packed"][i])), max_output_size=max(1, int(seek["size"][i])))
        if len(raw) != seek["size"][i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != seek["sum"][i]:
            raise ValueError(f"frame {i}: checksum differs")
        yield i, int(index["key"][i]), np.frombuffer(raw, f"<u{width}")


class _Roller:
    """Collects documents and writes a file whenever it holds enough."""

    def __init__(self, root: str, part: int, width: int) -> None:
        self.root, self.part, self.width, self.seq = root, part, width, 0
        self.pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
        self.store, self.folder = open_store(root)
        self.clear()

    def clear(self) -> None:
        self.frames, self.sizes, self.sums, self.keys, self.counts, self.held = [], [], [], [], [], 0

    def add(self, key: int | None, raw: bytes) -> None:
        frame = self.pack.compress(raw)
        self.frames.append(frame)
        self.sizes.append(len(raw))
        self.sums.append(xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.keys.append(NULL_KEY if key is None else key)
        self.counts.append(len(raw) // self.width)
        self.held += len(frame) + 64

    def flush(self) -> dict:
        name = f"part-{self.part:06d}-{self.seq:05d}.swt.zst"
        body = pack_file(self.frames, self.sizes, self.sums, self.keys, self.counts, self.width)
        draft = f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft) as out:
            out.write(body)
        self.store.move(draft, f"{self.folder}/{name}")
        row = {"file": [f"{self.root}/{name}"], "part": [self.part], "seq": [self.seq], "n_docs": [len(self.keys)], "n_tokens": [sum(self.counts)]}
        self.seq += 1
        self.clear()
        return row


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Encode ``text`` (null: empty), append ``end_id`` and write the files in ascending key order.

    Returns the manifest, one row per file in order, with ``base``: the ids before the file. Null keys come first; rows
    with equal keys stand in the order of their texts. No document, no file.
    """
    spark = docs.sparkSession
    store, folder = open_store(root)
    store.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        roller = _Roller(root, TaskContext.get().partitionId(), width)
        end = int(end_id).to_bytes(width, "little")
        encoder = byte_bpe(tokenizer, width)
        done = []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                roller.add(k, encoder.encode(t.as_py() or "") + end)
                if roller.held >= ROLL_BYTES:
                    done.append(roller.flush())
        if roller.keys:
            done.append(roller.flush())
        for row in done:
            yield pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    manifest = f"{root}/_manifest.parquet"
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(manifest)
    # One row per file: the only global window is over this list.
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return spark.read.parquet(manifest).withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, schema: str, digest: Callable[[int, int | None, np.ndarray], tuple], batch: int = 2000) -> DataFrame:
    """``digest(start, key, ids)`` of every document in the files, as rows of ``schema``; one task holds one frame."""
    names = [part.split()[0] for part in schema.split(",")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start in zip(frame["file"], frame["base"].astype("int64")):
                start, rows = int(start), []
                store, name = open_store(path)
                with store.open_input_file(name) as handle:
                    for _, key, ids in read_frames(handle):
                        rows.append(digest(start, None if key == NULL_KEY else key, ids))
                        start += len(ids)
                        if len(rows) >= batch:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = manifest.select("file", "base")
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, 1)
    return files.repartition(tasks).mapInPandas(read, schema)


def read_documents(spark: SparkSession, manifest: DataFrame, keys: list[int]) -> DataFrame:
    """``key, ids`` of the requested documents: their frames alone are fetched and decompressed."""
    wanted = np.array(sorted(keys), dtype=np.int64)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["file"]:
                store, name = open_store(path)
                with store.open_input_file(name) as handle:
                    for _, key, ids in read_frames(handle, lambda have: np.isin(have, wanted)):
                        yield pd.DataFrame({"key": [key], "ids": [ids.astype(np.int64).tolist()]})

    return manifest.select("file").mapInPandas(read, "key long, ids array<long>")


def ids_digest(start: int, key: int | None, ids: np.ndarray) -> tuple:
    return key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
