"""Best-fit packing of documents into token sequences, after dominance reduction.

Pieces matter to a packing by their length alone, so the instance is a table of
at most ``capacity`` lengths with counts, whatever the number of documents; only
that table reaches the driver.  There:

1. *Dominance* (Martello and Toth): for the longest open length, a set that
   dominates all others with it is fixed for good: alone where not even the
   shortest fits beside it; with its exact complement; with the longest that
   fits where at most one more piece does, or where that one is at least as long
   as the best pair.  Each fix keeps some optimal packing reachable, holds for as many
   pieces as both lengths have, and shrinks the instance; so there are at most two
   fixes a length, whatever the counts.
2. *Best fit, longest first*, packs the rest: lengths go to the fullest open
   sequences that take them, whole counts at a time.

The outcome is a table of patterns with multiplicities (at most a few for each pair of
lengths).  Pieces get a rank within their length, dealt out over salted sub-groups, one
for every ``SALTED`` pieces or partition, so that a length shared by a third of all rows
is no hot task, and rank ranges map to sequence and offset: a row a length, with its ranges.

Cases: null text is empty (one end id); null ids stay null; repeated rows are
packed as often as they occur; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import ByteEncoder
from .shared import arrow_map, held, materialize, partitions, slices

Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first
#: Rows of the slot table up to which it is broadcast (about 60 bytes each).
MAX_BROADCAST_SLOTS = 50_000
SALTED = 500_000


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed (pattern, multiplicity) and the lengths that stay open."""
    left = {k: v for k, v in counts.items() if v}
    order = sorted(left)
    fixed: list[tuple[Pattern, int]] = []

    def take(*lengths: int, times: int) -> None:
        pattern: dict[int, int] = defaultdict(int)
        for x in lengths:
            pattern[x] += 1
        fixed.append((tuple(sorted(pattern.items(), reverse=True)), times))
        for x, n in pattern.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
                order.pop(bisect_left(order, x))

    def smallest(n: int, without: int) -> list[int]:
        """The n shortest open pieces when one of length ``without`` is taken away."""
        out: list[int] = []
        for x in order:
            out += [x] * min(n - len(out), left[x] - (x == without))
            if len(out) == n:
                break
        return out

    changed = True
    while changed:
        changed = False
        for w in sorted(order, reverse=True):
            while left.get(w):
                room = capacity - w
                low = smallest(3, w)
                if not low or low[0] > room:
                    take(w, times=left[w])  # what is left is w or longer, or doesn't fit: so for every piece of w
                elif left.get(room, 0) > (room == w):
                    take(w, room, times=left[w] // 2 if room == w else min(left[w], left[room]))
                else:
                    best = next(x for x in reversed(order[: bisect_left(order, room + 1)]) if left[x] > (x == w))
                    pair = len(low) > 1 and low[0] + low[1] <= room
                    if pair and not (len(low) < 3 or sum(low) > room) or pair and _best_pair(order, left, w, room) > best:
                        break
                    # taking both away shrinks the pairs and raises the least sums, so the same fix holds until one length is used up
                    take(w, best, times=left[w] // 2 if best == w else min(left[w], left[best]))
                changed = True
    return fixed, left


def _best_pair(order: list[int], left: dict[int, int], w: int, room: int) -> int:
    """Largest sum of two open pieces besides one of length w that fits into ``room``."""
    best, i, j = 0, 0, bisect_left(order, room + 1) - 1
    have = lambda x: left[x] - (x == w)
    while 0 <= i <= j:
        total = order[i] + order[j]
        if total > room or not have(order[j]):
            j -= 1
        elif not have(order[i]) or (i == j and have(order[i]) < 2):
            i += 1
        else:
            best, i = max(best, total), i + 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, over whole counts; (pattern, multiplicity)."""
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((pattern, times))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, pattern, times = capacity, (), -(-n // (capacity // w))
            each = room // w
            full = min(times, n // each)
            put(room - each * w, (*pattern, (w, each)), full)
            n -= full * each
            times -= full
            if n and times:
                put(room - n * w, (*pattern, (w, n)), 1)
                n, times = 0, times - 1
            put(room, pattern, times) if pattern else None
    return [x for room in rooms for x in open_[room]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, left = reduce_by_dominance(counts, capacity)
    times: dict[Pattern, int] = defaultdict(int)
    for pattern, n in fixed + best_fit(left, capacity):
        times[pattern] += n
    return list(times.items())


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``; only documents over ``capacity`` are cut, the first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held(ByteEncoder, tokenizer)
        for batch in slices(batches, "text", 2 << 20):
            out = []
            for doc, ids in zip(batch.column("id").to_pylist(), enc.encode_all(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start, end = 0, (len(ids) - 1) % capacity + 1
                piece = 0
                while start < len(ids):
                    part = ids[start:end].tobytes()
                    out.append((doc, piece, start, end - start, zlib.crc32(part), part if keep_ids else None))
                    start, end, piece = end, end + capacity, piece + 1
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays(columns[: 5 + keep_ids], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids, holds=True)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    salts = max(partitions(spark), pieces.count() // SALTED)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    slots, next_rank, sequence = [], defaultdict(int), 0
    for pattern, times in plan(counts, capacity):
        place = 0
        for length, each in pattern:
            slots.append((length, next_rank[length], next_rank[length] + each * times, each, sequence, place))
            next_rank[length] += each * times
            place += each * length
        sequence += times
    if dict(next_rank) != counts:
        raise AssertionError("the plan doesn't hold every piece once")
    ranges = F.array_sort(F.collect_list(F.struct("low", "high", "each", "base", "place"))).alias("ranges")
    table = spark.createDataFrame(slots, "length long, low long, high long, each long, base long, place long").groupBy("length").agg(ranges)
    if len(slots) <= MAX_BROADCAST_SLOTS:
        table = F.broadcast(table)

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(within) - 1).join(shifts, ["length", "salt"]).withColumn("rank", F.col("shift") + F.col("r"))
    slot = F.get(F.filter("ranges", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"])), 0)
    placed = ranked.join(table, "length").withColumn("slot", slot)
    at = F.col("rank") - F.col("slot.low")
    return placed.select(
        *["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids],
        (F.col("slot.base") + F.floor(at / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (F.col("slot.place") + at % F.col("slot.each") * F.col("length")).cast("long").alias("offset"),
    )
