"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order. Layout: blocks, each zstandard-compressed; a sparse index with the last
key and place of each block; a Bloom filter over keys; a footer of fixed size. In a block a key is stored as the length
of what it shares with the key before, and the rest; a block starts afresh. A lookup asks the Bloom filter, finds its
block by binary search of the index, and decodes one block.

Defined cases: null text is empty (only the end id); a null doc_id sorts first and has the empty key; repeated rows and
equal doc_ids keep one entry each; an empty table gives no shard; extra columns are ignored.
"""

from __future__ import annotations

from array import array
import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from plinth.llm import common, tokens

MAGIC = b"PLSST001"
BLOCK_BYTES = 1 << 16
BLOOM_BITS_PER_KEY = 10
BLOOM_PROBES = 7
_FOOTER = struct.Struct("<QQQQQQB8s")  # index offset, length, Bloom offset, length, keys, ids, id width, magic


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def key_of(doc_id: int | None) -> bytes:
    """Eight bytes that sort as the signed number does; null first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _probes(key_hash: np.ndarray, bits: int) -> np.ndarray:
    low, high = key_hash & np.uint64(0xFFFFFFFF), key_hash >> np.uint64(32) | np.uint64(1)
    return (low[:, None] + np.arange(BLOOM_PROBES, dtype=np.uint64) * high[:, None]) % np.uint64(bits)


class Writer:
    """Streams entries in key order to a file; in memory are one block, the index, 8 bytes a key and the filter."""

    def __init__(self, out, id_width: int):
        self.out, self.width, self.at = out, id_width, 0
        self.block, self.last, self.in_block = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes = array("Q")
        self.ids = 0
        self.squeeze = zstandard.ZstdCompressor(level=1)

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.in_block:
            for a, b in zip(key, self.last):
                if a != b:
                    break
                shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.in_block += 1
        self.ids += len(ids)
        self.hashes.append(xxhash.xxh3_64_intdigest(key))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            at, size = self._put(self.squeeze.compress(bytes(self.block)))
            self.index.append((self.last, at, size, self.in_block))
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(s) + _varint(n) for k, a, s, n in self.index)
        where = self._put(index)
        bits = max(64, -(-len(self.hashes) * BLOOM_BITS_PER_KEY // 64) * 64)
        flags = np.zeros(bits // 8, np.uint8)
        hashes = np.frombuffer(self.hashes, np.uint64) if self.hashes else np.zeros(0, np.uint64)
        for part in np.array_split(hashes, len(hashes) // 100_000 + 1):
            at = _probes(part, bits).ravel()
            np.bitwise_or.at(flags, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        bloom = self._put(flags.tobytes())
        self._put(_FOOTER.pack(*where, *bloom, len(self.hashes), self.ids, self.width, MAGIC))


class Reader:
    """Scans a shard in key order or looks one key up."""

    def __init__(self, path: str):
        fs, inner = common.filesystem(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        *places, self.keys, self.ids, self.width, magic = _FOOTER.unpack(self._get(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard of this format")
        buf, at, self.index = self._get(places[0], places[1]), 0, []
        while at < len(buf):
            n, at = _read_varint(buf, at)
            key, at = buf[at : at + n], at + n
            numbers = []
            for _ in range(3):
                x, at = _read_varint(buf, at)
                numbers.append(x)
            self.index.append((key, *numbers))
        self.bloom = np.frombuffer(self._get(places[2], places[3]), np.uint8)
        self.last_keys = [x[0] for x in self.index]

    def _get(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def _block(self, entry: tuple) -> Iterator[tuple[bytes, np.ndarray]]:
        buf = zstandard.ZstdDecompressor().decompress(self._get(entry[1], entry[2]))
        at, key = 0, b""
        while at < len(buf):
            shared, at = _read_varint(buf, at)
            rest, at = _read_varint(buf, at)
            size, at = _read_varint(buf, at)
            key, at = key[:shared] + buf[at : at + rest], at + rest
            yield key, np.frombuffer(buf, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for entry in self.index:
            yield from self._block(entry)

    def may_hold(self, key: bytes) -> bool:
        at = _probes(np.array([xxhash.xxh3_64_intdigest(key)], np.uint64), len(self.bloom) * 8)[0]
        return bool(np.all(self.bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1))

    def get(self, key: bytes) -> np.ndarray | None:
        if not self.may_hold(key):
            return None
        i = bisect.bisect_left(self.last_keys, key)
        if i == len(self.index):
            return None
        return next((ids for k, ids in self._block(self.index[i]) if k == key), None)


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = tokens.END_ID) -> list[dict]:
    """Encode docs (doc_id, text) and write one shard per range of doc_id under path.

    Returns the manifest, a row per shard in key order: shard, path, keys, ids (its number of ids) and start (the ids in
    the shards before). It has as many rows as there are shards, not documents.
    """
    model = tokenizer or tokens.tokenizer_path()

    def write(batches):
        from pyspark import TaskContext

        shard, writer = TaskContext.get().partitionId(), None
        name = f"{path}/shard-{shard:06d}.sst"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        from itertools import chain

        width = 2 if tokens.Encoder.of(model).library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        with common.published(name) as out:
            writer = Writer(out, width)
            for batch in chain([first], batches):
                for doc_id, text in zip(common.column(batch, "doc_id"), common.column(batch, "text")):
                    writer.add(key_of(doc_id), np.frombuffer(tokens.document_ids(text, model, end_id), "<u4"))
            writer.close()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "keys": len(writer.hashes), "ids": writer.ids}])

    spark = docs.sparkSession
    ranged = common.texts(docs).repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = sorted(ranged.mapInArrow(common.tidy(write), "shard long, path string, keys long, ids long").collect(), key=lambda r: r.shard)
    manifest, start = [], 0
    for r in rows:
        manifest.append(r.asDict() | {"start": start})
        start += r.ids
    return manifest


def read_shards(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Per document, from the shard files: doc_id, start (ids of all documents before), n_tokens, ids (little-endian u32)."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not manifest:
        return spark.createDataFrame([], schema)
    shards = [(m["path"], m["start"]) for m in manifest]

    def read(batches):
        out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for k in common.column(batch, "id"):
                path, at = shards[k]
                rows, held = [], 0
                for key, ids in Reader(path):
                    rows.append({"doc_id": id_of(key), "start": at, "n_tokens": len(ids), "ids": ids.astype("<u4").tobytes()})
                    at += len(ids)
                    held += len(ids)
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_pylist(rows, out)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, out)

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(common.tidy(read), schema)
