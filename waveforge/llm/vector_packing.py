"""Vector bin packing of training examples under limits on tokens, segments and loss-bearing tokens.

A sequence holds at most ``capacity`` tokens, ``max_segments`` pieces and ``max_loss`` tokens that bear loss.
An example's demand is a vector of the three; its loss-bearing tokens come from ``parts`` (a conversation's
answers), or are all of its tokens where a plain text is packed.

Each task packs what it reads, in one pass and without a shuffle.  It holds a pool of open items, of bounded size:

* An example over a limit is first cut into longest runs within the limits.
* *Dot product*: one sequence is filled at a time with the open item that fits and has the largest weighted
  dot product of its demand and the sequence's free room.  A dimension's weight is the pool's total demand
  for it, so the scarce one decides.  Items of equal demand are one class; a placement looks at classes.
* Where no item fits whole, the one with most tokens is cut to fill the sequence.
* A sequence that ends below ``capacity`` all the same (limits on segments or loss, or the end of the task) gives its tail back to the pool, down to a power of
  two: such lengths need no padding.  So no sequence has padding, whatever the limits.

A task fills sequences while its pool is over the low mark and reads on below it, so small examples have large ones to go with.  A lost executor costs
its tasks alone, and a task packs the same rows alike.  Sequence ids hold the task's number, so they are unique.

Cases: null text is empty (the end id alone); null parts are empty and a null flag bears no loss; null ids stay null; repeated rows are packed as
often as they occur; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .encoding import ByteEncoder, segments
from .shared import arrow_map, held

#: The pool is packed down to half when it holds so many tokens or items.
POOL_TOKENS, POOL_ITEMS = 4 << 20, 1 << 14
#: Texts of about so many bytes are encoded in one call, longer ones in parts of so many characters.
CALL_BYTES, PART_CHARS = 2 << 20, 1 << 16
_TASK_BITS = 33


class Run(NamedTuple):
    """A run of an example's ids; ``loss``: the loss-bearing tokens before each place (one more than ids), None where all bear loss."""

    doc: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None
    doc_tokens: int

    @property
    def demand(self) -> tuple[int, int]:
        return len(self.ids), len(self.ids) if self.loss is None else int(self.loss[-1] - self.loss[0])

    def split(self, at: int) -> tuple[Run, Run]:
        loss = (None, None) if self.loss is None else (self.loss[: at + 1], self.loss[at:])
        return self._replace(ids=self.ids[:at], loss=loss[0]), self._replace(start=self.start + at, ids=self.ids[at:], loss=loss[1])

    def reach(self, tokens: int, loss: int) -> int:
        """Length of the longest prefix within the two limits."""
        if self.loss is None:
            return min(len(self.ids), tokens, loss)
        return min(len(self.ids), tokens, int(np.searchsorted(self.loss, self.loss[0] + loss, "right")) - 1)


class Pool:
    """Open items by class of demand, and the sequences made of them."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int):
        if min(capacity, max_segments, max_loss) < 1:
            raise ValueError("capacity, max_segments and max_loss must be at least 1")
        self.limits = np.array([capacity, max_segments, max_loss], float)
        self.capacity, self.max_segments, self.max_loss = capacity, max_segments, max_loss
        self.classes: dict[tuple[int, int], int] = {}
        self.items: list[list[Run]] = []
        self.table = np.empty((3, 256))  # of each class: tokens, 1, loss; tokens are infinite where no item is open
        self.total = np.zeros(3)

    def add(self, run: Run) -> None:
        while len(run.ids):
            part, run = run.split(run.reach(self.capacity, self.max_loss))
            self._put(part)

    def _put(self, run: Run) -> None:
        demand = run.demand
        k = self.classes.get(demand)
        if k is None:
            k = self.classes[demand] = len(self.items)
            self.items.append([])
            if k == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.empty_like(self.table)], axis=1)
            self.table[1:, k] = 1, demand[1]
        self.table[0, k] = demand[0]
        self.items[k].append(run)
        self.total += (demand[0], 1, demand[1])

    def _take(self, k: int) -> Run:
        run = self.items[k].pop()
        if not self.items[k]:
            self.table[0, k] = np.inf
        tokens, loss = run.demand
        self.total -= (tokens, 1, loss)
        return run

    def _tidy(self) -> None:
        """Forgets classes without items, where they are most."""
        if len(self.items) > 1024 and np.isinf(self.table[0, : len(self.items)]).mean() > 0.5:
            runs = [x for k in self.items for x in k]
            self.classes, self.items, self.total = {}, [], np.zeros(3)
            for run in runs:
                self._put(run)

    def next_sequence(self) -> list[Run]:
        self._tidy()
        sequence: list[Run] = []
        room = [self.capacity, self.max_segments, self.max_loss]
        weight = self.total / self.limits**3  # the pool's demand, and both factors as shares of the limits
        while self.total[0] and min(room[:2]):
            tokens, ones, loss = self.table[:, : len(self.items)]
            fits = np.flatnonzero((tokens <= room[0]) & (loss <= room[2]))
            if len(fits):
                gain = tokens[fits] * (weight[0] * room[0]) + ones[fits] * (weight[1] * room[1]) + loss[fits] * (weight[2] * room[2])
                run = self._take(int(fits[np.argmax(gain)]))
            else:
                run = self._cut(np.where(np.isinf(tokens), -1, tokens), room)
                if run is None:
                    break
            used = run.demand
            room = [room[0] - used[0], room[1] - 1, room[2] - used[1]]
            sequence.append(run)
        if room[0]:
            self._give_back(sequence, self.capacity - room[0])
        return sequence

    def _cut(self, tokens: np.ndarray, room: list[int]) -> Run | None:
        """A head of the open item with most tokens, or else of one with least loss, that fills the room as far as the limits let it."""
        for k in (int(np.argmax(tokens)), int(np.argmin(np.where(tokens < 0, np.inf, self.table[2, : len(tokens)] / np.maximum(tokens, 1))))):
            at = self.items[k][-1].reach(room[0], room[2])
            if at:
                head, tail = self._take(k).split(at)
                self._put(tail)
                return head
        return None

    def _give_back(self, sequence: list[Run], size: int) -> None:
        over = size - (1 << (size.bit_length() - 1))
        while over:
            run = sequence.pop()
            head, tail = run.split(max(0, len(run.ids) - over))
            over -= len(tail.ids)
            self._put(tail)
            if len(head.ids):
                sequence.append(head)


def _encoded(batches: Iterator[pa.RecordBatch], enc: ByteEncoder, end_id: int) -> Iterator[Run]:
    def runs(rows: list[tuple]) -> Iterator[Run]:
        cut = [[(x, bears) for text, bears in parts for x in ([text] if any(t in text for t in enc.added) else segments(text, PART_CHARS))] for _, parts in rows]
        ids = iter(enc.encode_all([x for parts in cut for x, _ in parts]))
        for (doc, parts), pieces in zip(rows, cut, strict=True):
            own = [(next(ids), bears) for _, bears in pieces] + [(np.array([end_id], np.uint32), parts[-1][1] if parts else True)]
            whole = np.concatenate([x for x, _ in own]).astype("<u4")
            loss = None if all(bears for _, bears in own) else np.concatenate([[0], np.cumsum(np.repeat([bears for _, bears in own], [len(x) for x, _ in own]))]).astype(np.int32)
            yield Run(doc, 0, whole, loss, len(whole))

    rows, n_bytes = [], 0
    for batch in batches:
        for doc, texts, bears in zip(*(batch.column(x).to_pylist() for x in ("id", "texts", "bears")), strict=True):
            rows.append((doc, [(t or "", bool(b)) for t, b in zip(texts or [], bears or [], strict=True)]))
            n_bytes += sum(len(t) for t, _ in rows[-1][1])
            if n_bytes > CALL_BYTES or len(rows) == 4096:
                yield from runs(rows)
                rows, n_bytes = [], 0
    yield from runs(rows)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, max_segments: int = 64, max_loss: int | None = None, end_id: int = 1,
    id_col: str = "doc_id", text_col: str | None = "text", parts_col: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens[, ids]``.

    ``parts_col`` (in place of ``text_col``): an array of structs ``text, bears_loss``, encoded one by one; the end id goes with the last of them.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"][: 8 + keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, out = Pool(capacity, max_segments, max_loss or capacity), []
        sequence_id = TaskContext.get().partitionId() << _TASK_BITS

        def fill(down_to: float) -> Iterator[pa.RecordBatch]:
            nonlocal sequence_id, out
            while pool.total[0] and (pool.total[0] > POOL_TOKENS * down_to or pool.total[1] > POOL_ITEMS * down_to):
                offset = 0
                for x in pool.next_sequence():
                    raw = x.ids.tobytes()
                    out.append((x.doc, x.start, len(x.ids), zlib.crc32(raw), x.doc_tokens, sequence_id, offset, x.demand[1], raw if keep_ids else None))
                    offset += len(x.ids)
                sequence_id += 1
                if len(out) >= (256 if keep_ids else 8192):
                    yield batch_of(out)
                    out = []

        for item in _encoded(batches, held(ByteEncoder, tokenizer), end_id):
            pool.add(item)
            if pool.total[0] > POOL_TOKENS or pool.total[1] > POOL_ITEMS:
                yield from fill(0.5)
        yield from fill(0)
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=False)][: len(names)], names=names)

    bears = F.array(F.lit(True)) if parts_col is None else F.transform(F.col(f"`{parts_col}`"), lambda x: x["bears_loss"])
    texts = F.array(F.col(f"`{text_col}`")) if parts_col is None else F.transform(F.col(f"`{parts_col}`"), lambda x: x["text"])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), texts.alias("texts"), bears.alias("bears"))
    kind = rows.schema["id"].dataType
    types = [to_arrow_type(kind), *[pa.int64()] * 7, pa.binary()]
    return arrow_map(rows, run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{x} long" for x in names[1:8]) + ", ids binary" * keep_ids, holds=True)


def conversation_examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", answers: str = "assistant") -> DataFrame:
    """``id_col, parts``: a conversation's turns in order; the answers' tokens bear loss."""
    part = F.struct(F.col(turn_col).alias("at"), F.col(text_col).alias("text"), F.coalesce(F.col(role_col) == answers, F.lit(False)).alias("bears_loss"))
    return turns.groupBy(id_col).agg(F.array_sort(F.collect_list(part)).alias("parts"))
