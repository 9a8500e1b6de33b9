"""Operator 5, token ids as sorted string tables.

A shard holds a range of identifiers in ascending order. Layout::

    "TSST0001"
    blocks      zstd of entries; an entry is varint(shared) varint(unshared) varint(len(value)) key-suffix value
                then the unsigned little-endian offsets of the restart entries and their number (32 bits each)
    index       zstd of (varint key length, key, varint offset, varint size) of each block's last key
    bloom       the filter's bits
    footer      8 x unsigned 64-bit: index offset, index size, bloom offset, bloom size, hashes, entries, tokens, bytes an id
                unsigned 32-bit crc of that, "TSST0001"

Keys have 9 bytes: 0 for a null identifier, or 1 and the big-endian identifier with its sign flipped, so byte order is
ascending order with nulls first. Equal keys are allowed and keep their order. ``Reader.get`` tests the Bloom filter, then
searches the sparse index and the block's restarts by halving.

Nulls and empties: a null text is empty and has its end id; a null identifier is a key of its own kind, first of all;
repeated rows are entries each; an empty table gives no shards and no rows; other columns aren't read. Very long texts are
entries like others, of blocks of their own. Ties: entries of one identifier go by the hash of their texts."""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, encode

MAGIC = b"TSST0001"
FOOTER = struct.Struct("<8Q")
BLOCK_BYTES, RESTART_EVERY, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 16, 10, 7
END_ID = 1


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Writes entries in ascending key order to a binary stream."""

    def __init__(self, out, id_bytes: int = 2, block_bytes: int = BLOCK_BYTES):
        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.at, self.entries, self.tokens = 0, 0, 0
        self.index, self.hashes = bytearray(), []
        self._new_block()
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def _new_block(self) -> None:
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.in_block % RESTART_EVERY:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        else:
            shared = 0
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.in_block = key, self.in_block + 1
        self.entries += 1
        self.tokens += len(value) // self.id_bytes
        self.hashes.append(key)
        if len(self.block) >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.in_block:
            raw = self.pack(bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts)))
            self.index += _varint(len(self.last)) + self.last + _varint(self.at) + _varint(len(raw))
            self._put(raw)
        self._new_block()

    def close(self) -> None:
        self._end_block()
        index_at, index = self.at, self.pack(bytes(self.index))
        self._put(index)
        bits = max(64, -(-BLOOM_BITS * len(self.hashes) // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.hashes:
            for p in _bloom_places(key, bits, BLOOM_HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        self._put(bytes(bloom))
        footer = FOOTER.pack(index_at, len(index), bloom_at, len(bloom), BLOOM_HASHES, self.entries, self.tokens, self.id_bytes)
        self._put(footer + struct.pack("<I", zlib.crc32(footer)) + MAGIC)


class Reader:
    """Reads a shard through a seekable binary file; blocks are read when asked for."""

    def __init__(self, file):
        self.file, tail = file, FOOTER.size + 4 + len(MAGIC)
        end = file.seek(0, 2)
        file.seek(end - tail)
        raw = file.read(tail)
        footer = raw[: FOOTER.size]
        if raw[-len(MAGIC) :] != MAGIC or struct.unpack("<I", raw[FOOTER.size : FOOTER.size + 4])[0] != zlib.crc32(footer):
            raise ValueError("not a whole shard")
        index_at, index_size, bloom_at, bloom_size, self.hash_count, self.entries, self.tokens, id_bytes = FOOTER.unpack(footer)
        self.kind = np.dtype(f"<u{id_bytes}")
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.bloom = self._at(bloom_at, bloom_size)
        self.lasts, self.blocks, raw, at = [], [], self.unpack(self._at(index_at, index_size)), 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.lasts.append(raw[at : at + n])
            offset, at = _read_varint(raw, at + n)
            size, at = _read_varint(raw, at)
            self.blocks.append((offset, size))

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        raw = self.unpack(self._at(*self.blocks[k]))
        n = struct.unpack("<I", raw[-4:])[0]
        return raw[: -4 * (n + 1)], list(struct.unpack(f"<{n}I", raw[-4 * (n + 1) : -4]))

    @staticmethod
    def _entries(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            yield key, raw[at + own : at + own + size]
            at += own + size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, value in self._entries(self._block(k)[0], 0):
                yield id_of(key), np.frombuffer(value, self.kind)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with that identifier."""
        key = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, 8 * len(self.bloom), self.hash_count)):
            return []
        found = []
        for k in range(bisect.bisect_left(self.lasts, key), len(self.blocks)):
            raw, restarts = self._block(k)
            first = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(raw, at))[0])
            for at_key, value in self._entries(raw, restarts[max(0, first - 1)]):
                if at_key > key:
                    return found
                if at_key == key:
                    found.append(np.frombuffer(value, self.kind))
        return found


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes shards in ascending order of identifier and returns their manifest (a row per shard, in order). Each attempt of a task writes a
    file of its own, and the manifest names those that counted. Texts are dealt by ranges, not their ids, which are hardly fewer bytes."""
    common.small_batches(docs.sparkSession)
    at, root = common.filesystem(folder)
    at.create_dir(root, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encode.encoder(tokenizer)
        parts = (part for batch in batches for part in common.slices(batch, "text"))
        if (first := next(parts, None)) is None:
            return
        end, part_id = np.array([END_ID], enc.kind).tobytes(), TaskContext.get().partitionId()
        with common.attempt(folder, f"shard-{part_id:06d}", ".sst") as (path, sink):
            out = Writer(sink, enc.kind.itemsize)
            for part in chain([first], parts):
                for doc, raw in zip(part.column("doc_id").to_pylist(), enc.ids(common.texts_of(part.column("text"))), strict=True):
                    out.add(key_of(doc), raw + end)
            out.close()
        yield pa.RecordBatch.from_pydict({"part": [part_id], "path": [path], "entries": [out.entries], "tokens": [out.tokens]}, schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("entries", pa.int64()), ("tokens", pa.int64())]))

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The hash of the text orders repeated identifiers and lets a range boundary fall among them.
    keyed = narrow.withColumn("_h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    rows = dealt.mapInArrow(put, "part long, path string, entries long, tokens long").collect()  # one per shard
    common.tidy(folder, [r["path"] for r in rows])
    return [r.asDict() for r in sorted(rows, key=lambda r: r["part"])]


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Per document from the shards: doc_id, start, n_tokens, ids_crc32."""
    bases = np.concatenate([[0], np.cumsum([m["tokens"] for m in manifest])]).tolist()
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, where = common.filesystem(path)
                with store.open_input_file(where) as file:
                    rows: list[tuple] = []
                    for doc, ids in Reader(file).scan():
                        rows.append((doc, base, len(ids), encode.crc(ids.astype("<u4"))))
                        base += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    shards = spark.createDataFrame([(m["path"], b) for m, b in zip(manifest, bases, strict=False)], "path string, base long")
    return shards.repartition(max(1, len(manifest))).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")
