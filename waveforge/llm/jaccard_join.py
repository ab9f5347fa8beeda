"""N-gram Jaccard join by parity sketches.

**Sketch.**  The shingles of a document are dealt into ``B`` blocks by a hash and
XOR-ed inside each block, so a block's value is the parity of the bits of its
shingles.  A shingle that only one of two documents has changes one block, so
the number of blocks that differ (the Hamming distance over blocks) is at most
the symmetric difference of the sets; the same holds bit by bit for a 512-bit
parity sketch with one bit a shingle.

**Pigeonhole.**  At Jaccard >= t, a document of n shingles differs from a partner
by at most d = n (1 - t) / t / ... = n (1 / t - 1) shingles (n / 3 at t = 3/4).
Of its non-empty blocks, in the order of their hashes, the first d + 1 must hold
one that the partner has among its own first d + 1: they are the join keys.  Some
further blocks (``slack``) are added so that keys held by very many documents
may be left aside.  Blocks are made per size band; a document stands in the
band of its size and, where partners may be smaller, in the one below.  A document
whose non-empty blocks are too few for the argument is 11 standard deviations off in
the smallest band with blocks and further in larger ones; should there be one, its
band, and no other, gets more blocks.

**Shuffle.**  Keys travel packed: a task sorts them by bucket and emits one row of
13 bytes a key for each bucket and batch, so 100 million keys are some ten thousand rows.

**Candidates.**  Documents with the same set of shingles are one node.  By the
same argument a linked pair shares not one key but slack + 1 of them, less those
that are *hot*, held by over ``HOT`` nodes; keys of up to ``ALL_PAIRS_UP_TO`` nodes
give all pairs with counts, and pairs of too few shared keys go.  Keys of up to
``HOT`` nodes give links from the first node and along the order, and are kept: where
their nodes are in several components after these have been verified, pairs across
components are tried too, but for the longest lists of a node, which may be left aside as
far as they hold a third of its spare keys.  Hot keys are tried only for *tight* nodes, those with
more hot keys than slack: first the key's first tight node against all others,
then pairs across components.  Every other linked pair shares a key that is not hot.
The bit sketches rule most pairs out before any set is moved: 512 bits for all, and
for larger sets wide ones with a bit or more a shingle, of which the longer is folded.  So a group of
thousands of near copies costs a few links a member, and no link that would join
two components is lost.

**Verification** is exact: the intersection of the full sorted shingle sets.

Hashes have 64 bits: two different shingles or sets in n agree with probability
n^2 / 2^65.

Cases: null and empty texts have no shingles and link with nothing; fewer than k
words form one shingle; repeated rows are nodes of the same set; null ids take
part but give no component id; ties in ids do not matter, the smallest wins; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .shared import arrow_map, materialize, partitions, runs, scratch, slices, small_or_shuffled
from .words import mix, shingles, word_hashes

BAND = 4  # ratio of a size band
SINGLE_UP_TO = 128  # below this size every shingle is a block of its own
DENSITY = 0.55  # blocks for each shingle of a band's largest document
SLACK = 0.1  # further keys, as a share of the size
ALL_PAIRS_UP_TO = 6
HOT = 32
FIRST_LISTS = 32  # list ids of a node by which repeated pairs are seen; further ones only cost repeats
ENOUGH = 1 << 20  # stands for the shared keys of a pair that is to be verified in any case
SKETCH_WORDS = 8
MAX_BROADCAST_IDS = 100_000  # nodes asked for (16 bytes each) up to which texts are not shuffled to them


def _blocks(band: int, percent: int, levels: dict[int, int]) -> int:
    largest = math.ceil(BAND ** (band + 1) * 100 / percent)
    return 0 if largest <= SINGLE_UP_TO else int(largest * DENSITY * 1.5 ** levels.get(band, 0))


def _bands(n: int, percent: int) -> list[int]:
    own, low = (int(math.log(x, BAND) + 1e-9) for x in (n, max(1, -(-n * percent // 100))))
    return sorted({own, low})


def _keys(one: np.ndarray, band: int, percent: int, levels: dict[int, int]) -> tuple[np.ndarray, int]:
    """The keys of a set in a band and how many of them may be left aside; -1 where the blocks are too few."""
    n, b = len(one), _blocks(band, percent, levels)
    seed = np.uint64((band + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
    if b == 0:
        found = mix(one ^ seed)
    else:
        at = mix(one + seed)
        block = (at >> np.uint64(32)) % np.uint64(b)
        order = np.argsort(block, kind="stable")
        block, value = block[order], mix(one ^ seed)[order]
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        found = mix(np.bitwise_xor.reduceat(value, starts) + block[starts] * np.uint64(0x9E3779B97F4A7C15))
    most = n * (100 - percent) // percent
    if len(found) <= most:
        return found, -1
    want = min(len(found), most + 1 + math.ceil(SLACK * n))
    if want < len(found):
        found = np.partition(found, want - 1)[:want]
    return found, len(found) - most - 1


def _sketch(one: np.ndarray) -> list[int]:
    bits = (one >> np.uint64(20)) & np.uint64(64 * SKETCH_WORDS - 1)
    odd = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _wide(one: np.ndarray) -> bytes | None:
    """A sketch of a bit or more a shingle for the sets that the narrow sketch is too short for."""
    if len(one) <= 64 * SKETCH_WORDS:
        return None
    size = 1 << (len(one) - 1).bit_length()
    odd = np.bincount(((one >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _wide_distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two wide sketches; the longer is folded, which keeps it a parity sketch."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _node(one: np.ndarray) -> int:
    total = mix(np.array([np.add.reduce(mix(one)), np.bitwise_xor.reduce(one)], np.uint64))
    return int(mix(total[:1] + total[1:] * np.uint64(3) + np.uint64(len(one))).view(np.int64)[0])


def signatures(docs: DataFrame, k: int, percent: int, levels: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """``doc, n, node, slack, lack, s0.., wide`` of each document; lack: a band with too few blocks for it, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, node, slack, lack, sketch, wide = [], [], [], [], [], []
            for one in shingles(*word_hashes(batch.column("text")), k):
                n.append(len(one))
                node.append(_node(one) if len(one) else None)
                spare = {b: _keys(one, b, percent, levels)[1] for b in _bands(len(one), percent)} if len(one) else {}
                slack.append(min(spare.values(), default=0))
                lack.append(next((b for b, x in spare.items() if x < 0), None))
                sketch.append(_sketch(one))
                wide.append(_wide(one))
            columns = [pa.array(x, pa.int64()) for x in (n, node, slack, lack, *zip(*sketch, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns, pa.array(wide, pa.binary())], names=[*names, "wide"])

    names = ["doc", "n", "node", "slack", "lack", *(f"s{i}" for i in range(SKETCH_WORDS))]
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, f"doc {rows.schema['doc'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names[1:]) + ", wide binary")


def _packed_keys(docs: DataFrame, k: int, percent: int, levels: dict[int, int], buckets: int, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "text"):
            keys, nodes, seen = [], [], set()
            for one in shingles(*word_hashes(batch.column("text")), k):
                if not len(one) or (node := _node(one)) in seen:
                    continue
                seen.add(node)
                for band in _bands(len(one), percent):
                    found, _ = _keys(one, band, percent, levels)
                    keys.append(found)
                    nodes.append(np.full(len(found), node, np.int64))
            if not keys:
                continue
            key, node = np.concatenate(keys), np.concatenate(nodes)
            bucket = (key >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, key, node = bucket[order], key[order], node[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            low = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :5])
            spans = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([low[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([node[i:j].tobytes() for i, j in spans], pa.binary())],
                names=["bucket", "keys", "nodes"],
            )

    return arrow_map(docs.select(F.col(text_col).alias("text")), run, "bucket int, keys binary, nodes binary")


def _candidates(packed: DataFrame) -> DataFrame:
    """``a, b, shared`` for pairs and the keys they share; ``nodes, shared`` for keys that over ALL_PAIRS_UP_TO nodes have."""

    def of_bucket(keys: list[bytes], nodes: list[bytes]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 5)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :5] = raw
        key, node = key.view(np.uint64).ravel(), np.frombuffer(b"".join(nodes), np.int64)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        key, node = key[new], node[new]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        pairs, near, lists = [], [], {}
        for size in range(2, ALL_PAIRS_UP_TO + 1):
            at = starts[sizes == size]
            for i in range(size if len(at) else 0):
                pairs += [np.stack((node[at + i], node[at + j])) for j in range(i + 1, size)]
        for start, size in zip(*(x[sizes > ALL_PAIRS_UP_TO].tolist() for x in (starts, sizes)), strict=True):
            members = node[start : start + size]
            name = members.tobytes()
            lists[name] = (members, lists.get(name, (None, 0))[1] + 1)
            if size <= HOT:
                near += [np.stack((np.full(size - 1, members[0]), members[1:])), np.stack((members[:-1], members[1:]))]
        few, shared = np.unique(np.concatenate(pairs, axis=1), axis=1, return_counts=True) if pairs else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
        some = np.unique(np.concatenate(near, axis=1), axis=1) if near else np.empty((2, 0), np.int64)
        both, count = np.concatenate((few, some), axis=1), np.concatenate((shared, np.full(some.shape[1], ENOUGH)))
        n, m = both.shape[1], len(lists)
        held = pa.array([None] * n + [x.tolist() for x, _ in lists.values()], pa.list_(pa.int64()))
        ends = [pa.concat_arrays([pa.array(x), pa.nulls(m, pa.int64())]) for x in both]
        count = pa.array(np.concatenate((count, [t for _, t in lists.values()])).astype(np.int64))
        return pa.RecordBatch.from_arrays([*ends, count, held], names=["a", "b", "shared", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, nodes = None, [], []
        for batch in batches:
            for bucket, key, node in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if bucket != now and keys:
                    yield of_bucket(keys, nodes)
                    keys, nodes = [], []
                now = bucket
                keys.append(key)
                nodes.append(node)
        if keys:
            yield of_bucket(keys, nodes)

    n = partitions(packed.sparkSession)
    return arrow_map(packed.repartition(n, "bucket").sortWithinPartitions("bucket"), run, "a long, b long, shared long, nodes array<long>")


def _distance() -> Column:
    """Hamming distance of a pair's bit sketches: a lower bound of the symmetric difference."""
    return sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))


def _big() -> Column:
    """Whether both sets of a pair have a wide sketch."""
    return (F.least("n", "m") > 64 * SKETCH_WORDS).alias("big")


def _may_link(percent: int) -> Column:
    """Sizes and bit sketches of a pair allow the similarity: 100 |A and B| >= percent |A or B|."""
    return _sizes_may_link(percent) & (_distance() * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("m")))


def _sizes_may_link(percent: int) -> Column:
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _sieved(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs``, without ``big``, whose wide sketches allow the similarity; those that are not big have none, stay and are not joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, total = (batch.column(c).to_pylist() for c in ("x", "y", "total"))
            keep = [p is None or q is None or _wide_distance(p, q) * (100 + percent) <= (100 - percent) * t for p, q, t in zip(x, y, total, strict=True)]
            yield batch.select(pairs_schema).filter(pa.array(keep, pa.bool_()))

    tried = materialize(pairs, "tried")
    small, pairs = tried.where("not big").drop("big"), tried.where("big").drop("big")
    pairs_schema = pairs.columns
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("wide").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("total", F.col("na") + F.col("nb")).select(*pairs_schema, "x", "y", "total")
    return small.union(arrow_map(both, run, pairs.schema))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)  # distinct and sorted
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return arrow_map(pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y"), run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``id_col, n_shingles, component_id``: documents linked at Jaccard >= percent / 100, directly or through others."""
    with scratch(docs.sparkSession) as keep:
        return keep(_components(docs, k, percent, id_col, text_col), "jaccard")


def _components(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    levels: dict[int, int] = {}
    while True:
        sigs = materialize(signatures(docs, k, percent, levels, id_col, text_col), "signatures")
        short = [r["lack"] for r in sigs.where("lack is not null").select("lack").distinct().collect()]  # a dozen bands at most
        if not short:
            break
        levels |= {b: levels.get(b, 0) + 1 for b in short}
    found = materialize(_candidates(_packed_keys(docs, k, percent, levels, 8 * partitions(spark), text_col)), "candidates")
    lists = found.where("nodes is not null").groupBy(F.xxhash64("nodes").alias("list")).agg(F.first("nodes").alias("nodes"), F.sum("shared").alias("keys"))
    members = lists.select(F.explode("nodes").alias("node"), "list", "keys", F.size("nodes").alias("size"))
    hot = members.where(F.col("size") > HOT).groupBy("node").agg(F.sum("keys").alias("held"))
    sketch = [f"s{i}" for i in range(SKETCH_WORDS)]
    nodes = sigs.where("node is not null").groupBy("node").agg(F.min("doc").alias("doc"), *(F.first(x).alias(x) for x in ("n", "slack", *sketch, "wide")))
    nodes = nodes.join(hot, "node", "left").withColumn("held", F.coalesce("held", F.lit(0))).withColumn("tight", F.col("held") > F.col("slack"))
    nodes = materialize(nodes, "nodes")
    members = materialize(_thinned(members, nodes), "members")

    # a linked pair shares slack + 1 keys; some may be among the hot keys of either, and keys of more nodes are tried below.
    # Counts and sizes are looked up first and sketches only for the pairs that stay; the rows are dealt by ``a`` once for
    # the sums and the first look-up, and by ``b`` once for the second and the sketches of ``b``.
    renamed = {"node": "b", "n": "m", "slack": "slack2", "held": "held2", "tight": "tight2", **{f"s{i}": f"t{i}" for i in range(SKETCH_WORDS)}}
    few = nodes.select("node", "n", "slack", "held")
    pairs = found.where("a is not null").select("a", "b", "shared").repartition(partitions(spark), "a").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    least = F.greatest(F.lit(1), F.ceil((F.least("slack", "slack2") + 1 - F.least("held", "held2")) / 3))
    pairs = pairs.join(few.withColumnRenamed("node", "a"), "a").join(few.withColumnsRenamed(renamed), "b")
    pairs = pairs.where((F.col("shared") >= least) & _sizes_may_link(percent)).select("a", "b", "n", "m")
    pairs = pairs.join(nodes.select("node", *sketch).withColumnsRenamed(renamed), "b").join(nodes.select(F.col("node").alias("a"), *sketch), "a")
    pairs = pairs.where(_may_link(percent)).select("a", "b", _distance().alias("distance"), _big())
    pairs = materialize(_sieved(pairs, nodes, percent), "pairs")

    # first each node's closest partner
    closest = pairs.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = materialize(_sets(docs, asked.join(nodes.select("node", "doc"), "node"), k, id_col, text_col), "sets")
    links = materialize(_verified(closest, sets, percent), "verified")
    labels = connected_components(links)
    # then the pairs still in two components
    apart = _apart(pairs, labels).join(closest, ["a", "b"], "left_anti")
    links = materialize(links.union(_verified(apart, sets, percent)), "verified")
    labels = connected_components(links)

    def rows_apart() -> DataFrame:
        """The members, with component, of larger keys whose members are in several components; of hot keys those with a tight member."""
        info = nodes.drop("doc", "slack", "held", "wide").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = members.join(info, "node")
        lists = rows.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("tight").alias("any"), F.max("size").alias("s"), F.min(F.when(F.col("tight"), F.col("node"))).alias("pivot"))
        lists = lists.where((F.col("lo") < F.col("hi")) & ((F.col("s") <= HOT) | F.col("any"))).select("list", "pivot")
        return materialize(rows.join(lists, "list"), "apart")

    def joined(more: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = materialize(_sieved(more.join(pairs, ["a", "b"], "left_anti"), nodes, percent), "more")
        asked = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
        sets = materialize(_sets(docs, asked.join(nodes.select("node", "doc"), "node"), k, id_col, text_col), "sets")
        links = materialize(links.union(_verified(more, sets, percent)), "verified")
        return links, connected_components(links)

    two = {**renamed, "component": "component2"}
    # hot keys: their first tight member against the others, so that a large group of near copies becomes one component
    rows = rows_apart()
    stars = rows.where(F.col("size") > HOT)
    if not stars.isEmpty():
        pivots = stars.where("node = pivot").drop("size", "keys", "pivot").withColumnRenamed("node", "a")
        others = stars.drop("size", "keys", "pivot").withColumnsRenamed(two)
        tried = pivots.join(others, "list").where((F.col("component") != F.col("component2")) & _may_link(percent))
        links, labels = joined(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), _big()).distinct(), links)
        rows = rows_apart()
    # what is still apart: pairs across the components of a key
    if not rows.isEmpty():
        # a pair that shares several lists is made in the first of them, as far as both know it among their first;
        # a hot list makes no pair of two nodes that are not tight, so it doesn't count among theirs
        open_ = F.when((F.col("size") <= HOT) | F.col("tight"), F.col("list"))
        firsts = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(open_)), 1, FIRST_LISTS).alias("firsts"))
        rows = rows.join(firsts, "node")
        one = rows.drop("keys", "pivot").withColumnRenamed("node", "a")
        other = rows.drop("size", "keys", "pivot").withColumnsRenamed({**two, "list": "list2", "firsts": "firsts2"})
        earlier = F.coalesce(F.array_min(F.array_intersect("firsts", "firsts2")) < F.col("list"), F.lit(False))
        where = (F.col("list") == F.col("list2")) & (F.col("a") < F.col("b")) & (F.col("component") != F.col("component2")) & ((F.col("size") <= HOT) | F.col("tight") | F.col("tight2")) & _may_link(percent) & ~earlier
        links, labels = joined(one.join(other, where).select("a", "b", _big()).distinct(), links)

    named = nodes.join(labels, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = named.join(names, "component").select("node", "component_id")
    out = sigs.select("doc", "n", "node").join(named, "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"))


def _thinned(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``members`` without each node's longest lists, as far as they hold no more than a third of its spare keys.

    A node that is not tight has spared its hot keys already: those lists stay for tight
    partners, and a third of what is left of its slack may go from the others.  Of a linked
    pair's shared keys M + 1, M at least either slack, at most 2 M / 3 are so left aside:
    another shared list stays, or over M / 3 are keys of few nodes, for which a third of the
    shared keys is asked.
    """
    spare = F.floor(F.when(F.col("tight"), F.col("slack")).otherwise(F.col("slack") - F.col("held")) / 3)
    open_ = F.when(F.col("tight") | (F.col("size") <= HOT), F.col("keys")).otherwise(0)
    longest = Window.partitionBy("node").orderBy(F.when(open_ > 0, 0).otherwise(1), F.col("size").desc(), "list").rowsBetween(Window.unboundedPreceding, 0)
    rows = members.join(nodes.select("node", "slack", "held", "tight"), "node").withColumn("_open", open_).withColumn("_past", F.sum("_open").over(longest))
    return rows.where((F.col("_open") == 0) | (F.col("_past") > spare)).select(*members.columns)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in two components."""
    for end, name in (("a", "ca"), ("b", "cb")):
        of = labels.select(F.col("node").alias(end), F.col("component").alias(name))
        pairs = pairs.join(of, end, "left").withColumn(name, F.coalesce(name, end))
    return pairs.where("ca <> cb").select("a", "b")


def _sets(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``node, set`` (sorted hashes) of the documents that stand for the asked nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            # ids may repeat, so only a text with the node's own set stands for it
            sets = [x.tobytes() if len(x) and _node(x) == n else None for x, n in zip(shingles(*word_hashes(batch.column("text")), k), batch.column("node").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])

    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    asked = materialize(asked, "asked")
    if asked.count() <= MAX_BROADCAST_IDS:
        asked = F.broadcast(asked)  # else both sides are shuffled
    found = asked.join(texts, F.col("text").isNotNull() & asked["doc"].eqNullSafe(texts["doc"])).select("node", "text")
    return arrow_map(found, run, "node long, set binary").where(F.col("set").isNotNull())


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each linked group: the one of the smallest id (all rows of that id).

    Rows without an id can't be named by a component and stay.
    """
    found = jaccard_components(docs, k, percent, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone_id")).distinct()
    gone = small_or_shuffled(materialize(gone, "gone"))
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
