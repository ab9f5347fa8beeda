"""Token ids in sorted-string-table shards.

Documents are encoded where they are read, so two bytes a token move and no text.
Then they are range-partitioned by id and sorted, and each task streams its range into
one shard file; so the shards in order hold all documents in ascending id order.  A shard is

    blocks | block index | Bloom filter | footer

* A block holds entries in key order: shared length with the key before, rest
  length, value length (LEB128), the rest of the key, the value.  It is
  zstandard-compressed and followed by a crc32.
* The index has each block's first key, place and size: sparse, so a lookup
  bisects it and decodes one block.
* The Bloom filter (10 bits a key, 7 probes) answers most absent keys without a read.
* The footer has the places of both, counts and a magic word.

A key is the 64-bit id, sign flipped, big-endian: byte order is id order.  A null id
has the empty key and stands first.  Values are ids of ``width`` bytes, little-endian.

A file's name carries a random part and is only announced when it is complete,
so a task that runs twice leaves a stray file but no wrong result.  Files are
written through ``pyarrow.fs`` to the shared folder, whatever store it is in.

Cases: null text is empty (only the end id); null ids come first; ids that are no
integers are refused; repeated ids are kept, next to each other, ordered by their token
ids; other columns are not read; an empty table has no shards.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import WordEncoder
from .shared import arrow_map, held, integer_ids, materialize, new_folder, partitions, scratch, slices
from .words import mix

_FOOTER = struct.Struct("<QQQQQQB7x8s")
_MAGIC = b"WFSSTAB1"
_PROBES = 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = mix(np.frombuffer(b"".join([k.rjust(8, b"\0") for k in keys]), ">u8"))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(_PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class ShardWriter:
    """Streams sorted (key, value) entries into a shard."""

    def __init__(self, out: BinaryIO, width: int, block_bytes: int = 64 << 10):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.place = self.entries = self.ids = 0
        self.block, self.first, self.last = [], None, b""
        self.held = 0
        self.index, self.keys = [], []
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.first is None:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(self.last, key, strict=False)) if a != b), min(len(self.last), len(key)))
        self.block += (_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value)
        self.held += len(value) + 12
        self.last = key
        self.entries += 1
        self.ids += len(value) // self.width
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.held >= self.block_bytes:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.place += len(data)
        return self.place - len(data), len(data)

    def _flush(self) -> None:
        if self.first is None:
            return
        body = self.zstd.compress(b"".join(self.block))
        self.index.append((self.first, *self._write(body + struct.pack("<I", zlib.crc32(body)))))
        self.block, self.first, self.last, self.held = [], None, b"", 0

    def close(self) -> None:
        self._flush()
        index = self._write(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index))
        bits = max(64, 10 * len(self.keys) + 7 & ~7)
        filled = np.zeros(bits, bool)
        for i in range(0, len(self.keys), 1 << 16):
            filled[_probes(self.keys[i : i + (1 << 16)], bits).ravel()] = True
        bloom = self._write(np.packbits(filled, bitorder="little").tobytes())
        self._write(_FOOTER.pack(*index, *bloom, self.entries, self.ids, self.width, _MAGIC))
        self.out.close()


class ShardReader:
    """Looks up keys in a shard, or walks through it."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        *places, self.entries, self.ids, self.width, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no shard, or not a whole one")
        data, at, self.index = self._at(*places[:2]), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.index.append((key, place, length))
        self.bloom = np.frombuffer(self._at(*places[2:]), np.uint8)

    def _at(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, bytes]]:
        raw = self._at(*block[1:])
        body, (crc,) = raw[:-4], struct.unpack("<I", raw[-4:])
        if zlib.crc32(body) != crc:
            raise ValueError("a block's checksum is wrong")
        data, at, key = zstandard.ZstdDecompressor().decompress(body), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in self.index:
            yield from self._entries(block)

    def may_have(self, key: bytes) -> bool:
        p = _probes([key], len(self.bloom) * 8)[0]
        return bool((self.bloom[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).all())

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key: by the Bloom filter, then a bisection of the index."""
        if not self.index or not self.may_have(key):
            return []
        starts, found = [x[0] for x in self.index], []
        for block in self.index[max(0, bisect.bisect_left(starts, key) - 1) : bisect.bisect_right(starts, key)]:
            found += [v for k, v in self._entries(block) if k == key]
        return found


MANIFEST = "shard long, path string, n_docs long, n_tokens long, first_id long, last_id long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every document and write the shards; the manifest: ``shard, path, n_docs, n_tokens, first_id, last_id, start``, a row a shard."""
    spark = docs.sparkSession
    integer_ids(docs, id_col)
    folder = folder or new_folder(spark, "sstable")
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held(WordEncoder, tokenizer)
        for batch in slices(batches, "text", 8 << 20, 1 << 16):
            ids, bounds = enc.encode(batch.column("text"))
            if end_id is not None:
                ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
            raw = [None, pa.py_buffer((bounds * enc.width).astype(np.int32)), pa.py_buffer(ids.astype(enc.dtype))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([enc.width] * batch.num_rows, pa.int32()), pa.Array.from_buffers(pa.binary(), batch.num_rows, raw)], names=["id", "width", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first, last = None, None, None
        store, root = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if writer is None:
                writer = ShardWriter(store.open_output_stream(path, compression=None), batch.column("width")[0].as_py())
                first = batch.column("id")[0].as_py()
            for doc, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                writer.add(key_of(doc), ids)
                last = doc
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": writer.entries, "n_tokens": writer.ids, "first_id": first, "last_id": last}], schema=arrow)

    arrow = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with scratch(spark):
        # written once: the range partitioner reads its input twice, which would encode twice
        encoded = materialize(arrow_map(rows, encode, "id long, width int, ids binary", holds=True), "encoded")
        ordered = encoded.repartitionByRange(shards or partitions(spark), "id").sortWithinPartitions("id", "ids")
        manifest, start = [], 0
        for row in sorted(arrow_map(ordered, write, MANIFEST).collect()):  # a row a shard
            manifest.append((*row, start))
            start += row["n_tokens"]
    return spark.createDataFrame(manifest, MANIFEST + ", start long").repartition(max(1, len(manifest)), "shard")


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32`` and, with ``keep_ids``, ``ids``."""
    uri = folder or new_folder(spark, "any")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for row in batch.to_pylist():
                shard, place = ShardReader(store, row["path"]), row["start"]
                out = []
                for key, value in shard:
                    ids = np.frombuffer(value, f"<u{shard.width}").astype("<u4")
                    out.append((id_of(key), place, len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if keep_ids else None))
                    place += len(ids)
                    if len(out) >= (256 if keep_ids else 8192):
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    def batch_of(out: list) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=False)]
        return pa.RecordBatch.from_arrays(columns[: 4 + keep_ids], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + keep_ids])

    types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return arrow_map(manifest.select("path", "start"), read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def lookup(spark: SparkSession, manifest: DataFrame, ids: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` of the asked documents, also of a null id: a bisection of the shards' first ids (a row a shard), then one binary search an id and shard."""
    integer_ids(ids, id_col)
    shards = sorted((r["first_id"] if r["first_id"] is not None else -(1 << 63), r["shard"], r["path"]) for r in manifest.select("first_id", "shard", "path").collect())
    firsts, paths = np.array([x[0] for x in shards], np.int64), [x[2] for x in shards]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(firsts, np.asarray(batch.column("id").fill_null(-(1 << 63))), "right") - 1
            there = pa.array(at >= 0)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(there), pa.array(at[at >= 0].astype(np.int32))], names=["id", "at"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        now, shard = None, None
        for batch in batches:
            out = []
            for doc, at in zip(batch.column("id").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if at != now:
                    now, shard = at, ShardReader(store, paths[at])
                out += [{"doc_id": doc, "ids": np.frombuffer(v, f"<u{shard.width}").tolist()} for v in shard.get(key_of(doc))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    hits = arrow_map(ids.select(F.col(id_col).cast("long").alias("id")), place, "id long, at int")
    return arrow_map(hits.repartition(partitions(spark), "at").sortWithinPartitions("at"), find, "doc_id long, ids array<long>")
