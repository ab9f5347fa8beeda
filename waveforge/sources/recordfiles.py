"""Binary spike files as a Spark source and sink: ``spark.read.format("spikefile")``.

A folder is one recording; its files follow one another in the order of their names.  A file is a header of 16,384 bytes of text
and records of fixed size, little-endian: time (unsigned 64 bits, microseconds), acquisition number and cell number (unsigned 32 bits each), eight 32-bit features, and 32 samples
of 16 bits for each wire, sample by sample.  ``.nse``, ``.nst`` and ``.ntt`` have one, two and four wires; ``.nts`` has times alone.

Reading: splits end between records; a task reads its split in blocks and decodes the asked ``fields`` of the records it keeps.  Ranges of ``idx`` (the place in the recording, from
1) leave whole splits unread; ranges of ``ts_us`` are tested on the undecoded block.  Both come as options (``first``, ``last``, ``from_ts``, ``to_ts``: inclusive) and, with the option
``push`` in sessions that have ``spark.sql.python.filterPushdown.enabled`` on, from filters.  What is left of an incomplete last record isn't read.

Writing: each task writes a file of its own under another name; the commit gives the files their names, an abort removes them.  Sort rows by range to keep an order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

HEADER_BYTES, SAMPLES, FEATURES = 16_384, 32, 8
WIRES = {"nts": 0, "nse": 1, "nst": 2, "ntt": 4}
FIELDS = {"idx": "long", "ts_us": "long", "sc": "int", "cell": "int", "features": "array<int>", "waves": "array<array<short>>"}
ARROW = {"idx": pa.int64(), "ts_us": pa.int64(), "sc": pa.int32(), "cell": pa.int32(), "features": pa.list_(pa.int32()), "waves": pa.list_(pa.list_(pa.int16()))}
BLOCK = 1 << 14  # records of a block


def layout(wires: int) -> np.dtype:
    if not wires:
        return np.dtype([("ts_us", "<u8")])
    return np.dtype([("ts_us", "<u8"), ("sc", "<u4"), ("cell", "<u4"), ("features", "<i4", (FEATURES,)), ("waves", "<i2", (SAMPLES, wires))])


def listed(folder: str) -> tuple[fs.FileSystem, str, list[fs.FileInfo]]:
    """The file system, the folder's path in it, and its spike files by name."""
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("/") else fs.FileSystem.from_uri(f"file:///{folder}")
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return store, root, sorted((x for x in found if x.is_file and x.extension in WIRES and not x.base_name.startswith((".", "_"))), key=lambda x: x.base_name)


@dataclass
class Split(InputPartition):
    path: str
    wires: int
    first: int  # record of the file
    many: int
    before: int  # records of the recording before this file


class Reader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.folder, self.fields = options["path"], fields
        self.split = int(options.get("split", 1 << 17))
        limit = lambda name, default: int(options.get(name, default))
        self.idx = [limit("first", 1), limit("last", 1 << 62)]
        self.ts = [limit("from_ts", 0), limit("to_ts", (1 << 63) - 1)]

    def partitions(self) -> list[Split]:
        _, _, files = listed(self.folder)
        out, before = [], 0
        for file in files:
            wires = WIRES[file.extension]
            many = max(0, file.size - HEADER_BYTES) // layout(wires).itemsize
            for first in range(0, many, self.split):
                part = Split(file.path, wires, first, min(self.split, many - first), before)
                if before + first < self.idx[1] and before + first + part.many >= self.idx[0]:
                    out.append(part)
            before += many
        return out

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:  # no file, or none in the range
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        kind = layout(split.wires)
        with store.open_input_file(split.path) as file:
            for at in range(split.first, split.first + split.many, BLOCK):
                many = min(BLOCK, split.first + split.many - at)
                block = np.frombuffer(file.read_at(many * kind.itemsize, HEADER_BYTES + at * kind.itemsize), kind)
                idx = np.arange(split.before + at + 1, split.before + at + 1 + many)
                ts = block["ts_us"].astype(np.int64)
                keep = (idx >= self.idx[0]) & (idx <= self.idx[1]) & (ts >= self.ts[0]) & (ts <= self.ts[1])
                if keep.any():
                    yield pa.RecordBatch.from_arrays([self.decoded(x, block[keep], idx[keep]) for x in self.fields], names=self.fields)

    def decoded(self, field: str, block: np.ndarray, idx: np.ndarray) -> pa.Array:
        if field == "idx":
            return pa.array(idx)
        if field not in block.dtype.names:
            return pa.nulls(len(block), ARROW[field])
        values = block[field]
        if field == "features":
            return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FEATURES).cast(ARROW[field])
        if field == "waves":
            wires = values.shape[2]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(values.transpose(0, 2, 1)).ravel()), SAMPLES)
            return pa.FixedSizeListArray.from_arrays(flat, wires).cast(ARROW[field])
        return pa.array(values.astype(np.int64)).cast(ARROW[field])


class PushedReader(Reader):
    """For sessions with ``spark.sql.python.filterPushdown.enabled``: takes ranges of ``idx`` and ``ts_us`` from filters too."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            bounds = {"idx": self.idx, "ts_us": self.ts}.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if bounds is None or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                bounds[0] = max(bounds[0], f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                bounds[1] = min(bounds[1], f.value - isinstance(f, LessThan))


class HeaderReader(DataSourceReader):
    """``file, line_no, line`` of the headers, a task a file."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x.path) for x in listed(self.folder)[2]]

    def read(self, split: InputPartition | None) -> Iterator[tuple]:
        if split is None:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(split.value) as file:
            text = file.read_at(HEADER_BYTES, 0).split(b"\0", 1)[0].decode("latin-1")
        for i, line in enumerate(text.splitlines()):
            yield split.value.rsplit("/", 1)[-1], i, line


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    name: str


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.folder, self.overwrite, self.header = options["path"], overwrite, options.get("header", "")
        self.kind = options.get("kind", "ntt")
        if self.kind not in WIRES:
            raise ValueError(f"{self.kind} is no kind of spike file: {', '.join(WIRES)}")
        if "ts_us" not in schema.names or (WIRES[self.kind] and "waves" not in schema.names):
            raise ValueError("records need ts_us, and waves where the kind has wires")
        if len(self.header.encode("latin-1")) > HEADER_BYTES:
            raise ValueError(f"a header has {HEADER_BYTES} bytes at most")
        _, _, there = listed(self.folder)
        self.run = max((int(x.base_name.split("-")[0]) for x in there if x.base_name.split("-")[0].isdigit()), default=-1) + 1
        self.old = [x.path for x in there] if overwrite else []
        self.tag = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        hidden = f"{root}/_{self.tag}-{task.partitionId()}-{task.taskAttemptId()}"
        kind, wires = layout(WIRES[self.kind]), WIRES[self.kind]
        with store.open_output_stream(hidden, compression=None) as out:
            out.write(self.header.encode("latin-1").ljust(HEADER_BYTES, b"\0"))
            for batch in batches:
                block = np.zeros(batch.num_rows, kind)
                for name in kind.names:
                    if name in batch.schema.names:
                        block[name] = self.encoded(name, batch.column(name), wires)
                out.write(block.tobytes())
        return Written(hidden, f"{root}/{self.run:05d}-{task.partitionId():06d}.{self.kind}")

    def encoded(self, name: str, values: pa.Array, wires: int) -> np.ndarray:
        if name not in ("waves", "features"):
            return np.asarray(values.fill_null(0)).astype(np.int64)
        rows = values.to_pylist()
        shape = (wires, SAMPLES) if name == "waves" else (FEATURES,)
        for row in rows:
            if row is None or len(row) != shape[0] or (name == "waves" and any(w is None or len(w) != SAMPLES for w in row)):
                raise ValueError(f"{name} must hold {' x '.join(map(str, shape))} values")
        made = np.array(rows, np.int64).reshape(len(rows), *shape)
        size = 1 << (15 if name == "waves" else 31)
        if made.size and (made.min() < -size or made.max() >= size):
            raise ValueError(f"{name} hold values beyond their width")
        return made.transpose(0, 2, 1) if name == "waves" else made

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.folder)
        for path in self.old:
            store.delete_file(path)
        for m in messages:
            if m is not None:
                store.move(m.hidden, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(f"_{self.tag}"):
                store.delete_file(x.path)


class SpikeFiles(DataSource):
    """Options: ``path``; reading ``fields`` (comma-separated), ``first``, ``last``, ``from_ts``, ``to_ts``, ``split`` (records), ``push`` = ``true``, ``content`` = ``header``; writing ``kind``, ``header``."""

    @classmethod
    def name(cls) -> str:
        return "spikefile"

    @property
    def fields(self) -> list[str]:
        asked = self.options.get("fields")
        names = [x.strip() for x in asked.split(",")] if asked else list(FIELDS)
        if unknown := [x for x in names if x not in FIELDS]:
            raise ValueError(f"records have no fields {unknown}")
        return names

    def schema(self) -> str:
        if self.options.get("content") == "header":
            return "file string, line_no int, line string"
        return ", ".join(f"{x} {FIELDS[x]}" for x in self.fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        if self.options.get("content") == "header":
            return HeaderReader(self.options)
        return (PushedReader if self.options.get("push") == "true" else Reader)(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def read(spark: SparkSession, folder: str, mode: str = "all", values: list[int] | None = None, fields: list[str] | None = None) -> DataFrame:
    """The records of a mode, with ``ord``: ``all``, ``range`` and ``ts_range`` (both ends inclusive) read no more than they must; ``list`` keeps the order and repeats of its places and skips absent ones; ``ts_list`` is a set of times."""
    from .records import select_records

    spark.dataSource.register(SpikeFiles)
    names = fields or list(FIELDS)
    options = {"fields": ",".join(dict.fromkeys([*names, "idx", *(["ts_us"] if mode.startswith("ts") else [])]))}
    if mode == "range":
        options |= {"first": values[0], "last": values[1]}
    elif mode == "ts_range":
        options |= {"from_ts": max(0, values[0]), "to_ts": values[1]}
    found = spark.read.format("spikefile").options(**options).load(folder)
    return select_records(found, mode if mode in ("list", "ts_list") else "all", values, names)


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """``file, line_no, line``, as :func:`.records.parse_headers` takes them."""
    spark.dataSource.register(SpikeFiles)
    return spark.read.format("spikefile").option("content", "header").load(folder)


def write(rows: DataFrame, folder: str, kind: str, order: list[str], header: str = "", append: bool = False) -> None:
    """``rows`` (``ts_us``, ``waves``, and optionally ``sc, cell, features``) as a recording in the given order, cut into files by range."""
    rows.sparkSession.dataSource.register(SpikeFiles)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    known = [x for x in FIELDS if x in rows.columns and x != "idx"]
    ordered.select(*known).write.format("spikefile").mode("append" if append else "overwrite").options(kind=kind, header=header).save(folder)


def legacy_selection(records: DataFrame, mode: str, values: list[int] | None = None, most: int | None = None) -> DataFrame:
    """The records that a writer of the older kind takes: places count from 0, a list must rise, and ``most`` bounds their number; with ``ord``."""
    from .records import select_records

    if mode in ("list", "ts_list") and any(a >= b for a, b in zip(values, values[1:], strict=False)):
        raise ValueError("a list of the older kind must rise")
    shifted = [v + 1 for v in values] if mode in ("range", "list") else values
    found = select_records(records, mode, shifted)
    return found if most is None else found.orderBy(F.col("idx")).limit(most)
