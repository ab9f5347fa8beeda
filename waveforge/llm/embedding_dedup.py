"""Near-duplicate embeddings by sorted projection passes.

Each pass orders a label's vectors by concatenated random hashes, so that vectors a small angle apart come to stand close, and
compares every vector with the ones near it: the order is cut into chunks of ``CHUNK`` rows, and a chunk meets itself and the chunk
before it.  So a label of up to two chunks is compared wholly, in one pass.  What moves through a pass is an id, the hash and
the vector rounded to 16-bit integers: its cosines are off by less than a known bound, so all
but a thin band around the threshold is decided there, and the pairs in the band are looked up
once and computed in double precision.  Links of all passes are united.

*Hashes.*  Even passes take signs of random projections of the vectors less their label's mean: these part a label that is spread out.
Odd passes take levels of random projections, ``LEVEL`` wide: these part tight groups inside a label as well, wherever the mean lies.

*Passes.*  A label of N vectors needs about b = log2(N / 1.5 chunks) common bits for a pair to stand in one window, which one pass gives with probability
``AGREE``^b or more in a label that is spread out; the first round has as many passes as miss a pair with probability ``miss`` then.  Tight groups need
more.  So rounds of ``MORE`` passes go on for every label until a whole round joins no two of its components any more; there is no upper limit.

A pair that reaches the threshold lies inside one component, so the number of links of a
vector is counted exactly inside its component: blocks of its members meet each other, streamed;
no pair is emitted.  A component of m vectors has 16 blocks of at least 256 and at most 65,536, so
it costs 32 m row copies (2 m^2 / 65,536 for the largest) over 256 or more groups of tasks.

Equal vectors of a label are one vector with a weight before anything is compared.

Cases: null, empty or zero vectors, vectors with null or non-finite components,
null labels and null ids link with nothing: n_links 0, their own component, kept.
Vectors of different lengths are never compared; ids that are no integers are refused.
Repeated rows count as copies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .shared import arrow_map, integer_ids, materialize, partitions, scratch, small_or_shuffled

CHUNK = 4096  # rows of a pass's order that meet themselves and the chunk before
BITS = 48  # of a key of signs
LEVEL, LEVELS, DIGITS = 0.5, 16, 12  # width and number of the levels of a projection, and projections of a key
AGREE = 0.85  # assumed probability that a linked pair of a spread-out label agrees on a bit
MORE = 8  # passes of a further round


def passes_for(n: int, miss: float) -> int:
    """Passes of the first round for a label of ``n`` vectors."""
    if n <= 2 * CHUNK:
        return 1
    once = AGREE ** math.log2(n / (1.5 * CHUNK))
    return max(2, math.ceil(math.log(miss) / math.log1p(-once)))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-4, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per vector ``id_col, n_links, component_id, kept``."""
    integer_ids(vectors, id_col)
    with scratch(vectors.sparkSession) as keep:
        return keep(_labelled(vectors, threshold, miss, seed, id_col, vector_col, label_col), "near-vectors")


def _labelled(vectors: DataFrame, threshold: float, miss: float, seed: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    distinct = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    distinct = materialize(distinct.withColumn("dim", F.size("v")), "vectors")

    links = materialize(_links(distinct, threshold, miss, seed), "links")
    labels = materialize(connected_components(links), "components")
    members = distinct.join(labels.withColumnRenamed("node", "rep"), "rep")
    counted = _links_inside(members, threshold)

    info = distinct.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(counted, "rep", "left")
    info = info.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(info, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # before squaring: no overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _groups(column: pa.Array) -> list[tuple[int, np.ndarray]]:
    """(value, places) of each value of an integer column."""
    values = np.asarray(column)
    return [(int(v), np.flatnonzero(values == v)) for v in np.unique(values)]


def _means(distinct: DataFrame) -> DataFrame:
    """``label, dim, n, mean``: mean direction of each label, from sums that each batch makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in _groups(batch.column("dim")):
                part = batch.take(pa.array(at))
                u, code = _unit(_matrix(part.column("v"), dim)), part.column("label").dictionary_encode()
                index = np.asarray(code.indices)
                sums = np.zeros((len(code.dictionary), dim))
                np.add.at(sums, index, u)
                n = np.bincount(index, minlength=len(sums))
                yield pa.RecordBatch.from_arrays([code.dictionary, pa.array([dim] * len(sums), pa.int32()), pa.array(n), pa.array(list(sums), pa.list_(pa.float64()))], names=["label", "dim", "n", "sums"])

    parts = arrow_map(distinct.select("label", "dim", "v"), run, "label string, dim int, n long, sums array<double>")
    places = parts.select("label", "dim", "n", F.posexplode("sums").alias("pos", "s")).groupBy("label", "dim", "pos").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    return places.groupBy("label", "dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("ordered")).select("label", "dim", "n", F.transform("ordered", lambda x: x["m"]).alias("mean"))


def _links(distinct: DataFrame, threshold: float, miss: float, seed: int) -> DataFrame:
    """``a, b``: pairs at the threshold that some pass holds in one window, thinned to a spanning forest of each window."""
    means = materialize(_means(distinct), "means")
    largest = means.agg(F.max("n")).first()[0] or 0
    first = passes_for(largest, miss)
    vectors = distinct.select("rep", "label", "dim", "v")
    links = None
    for p in range(first):
        # a smaller label has fewer passes in its first round
        rows = means if p == 0 else means.where(F.col("n") >= min(n for n in _sizes(largest) if passes_for(n, miss) > p))
        found = _one_pass(vectors, rows, threshold, seed, p)
        links = found if links is None else links.union(found)
    open_ = means.where(F.col("n") > 2 * CHUNK)
    p = first
    while largest > 2 * CHUNK and open_.take(1):
        known = materialize(connected_components(links), "components")
        new = None
        for _ in range(MORE):
            found = _one_pass(vectors, open_, threshold, seed, p)
            new, p = found if new is None else new.union(found), p + 1
        side = lambda x: known.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
        joined = new.join(side("a"), "a", "left").join(side("b"), "b", "left")
        joins = joined.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(F.col("a").alias("rep"))
        still = joins.join(distinct.select("rep", "label", "dim"), "rep").select("label", "dim").distinct()
        open_ = materialize(open_.join(still, ["label", "dim"], "left_semi"), "open")
        links = links.union(new)
    return links.distinct()


def _sizes(largest: int) -> list[int]:
    """Sizes up to ``largest``, a hundredth apart, to find the least one with a number of passes."""
    out, n = [], 2.0 * CHUNK
    while n < largest:
        n *= 1.01
        out.append(min(largest, math.floor(n)))
    return out or [largest]


def _keys(u: np.ndarray, mean: np.ndarray, dim: int, seed: int, p: int) -> np.ndarray:
    random = np.random.default_rng((seed, dim, p))
    if p % 2 == 0:
        weights = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)).astype(np.int64)
        return ((u - mean) @ random.standard_normal((dim, BITS)) > 0).astype(np.int64) @ weights
    levels = u @ random.standard_normal((dim, DIGITS)) / LEVEL + random.uniform(0, 1, DIGITS) + LEVELS / 2
    return np.clip(np.floor(levels), 0, LEVELS - 1).astype(np.int64) @ (LEVELS ** np.arange(DIGITS - 1, -1, -1, dtype=np.int64))


def _one_pass(vectors: DataFrame, labels: DataFrame, threshold: float, seed: int, p: int) -> DataFrame:
    """``a, b`` of pass ``p`` over the labels in ``labels`` (``label, dim, mean``), written; what else it has written is gone."""
    with scratch(vectors.sparkSession) as keep:
        return keep(_pass_links(vectors, labels, threshold, seed, p), "links")


def _pass_links(vectors: DataFrame, labels: DataFrame, threshold: float, seed: int, p: int) -> DataFrame:
    spark = vectors.sparkSession

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in _groups(batch.column("dim")):
                part = batch.take(pa.array(at))
                u = _unit(_matrix(part.column("v"), dim))
                keys = _keys(u, _matrix(part.column("mean"), dim), dim, seed, p)
                q = np.rint(u / np.abs(u).max(axis=1, keepdims=True) * 32767).astype("<i2")
                packed = pa.array([row.tobytes() for row in q], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), pa.array(keys), part.column("rep"), packed], names=["label", "dim", "key", "rep", "q"])

    keyed = arrow_map(vectors.join(labels.select("label", "dim", "mean"), ["label", "dim"]), project, "label string, dim int, key long, rep long, q binary")
    order = ["label", "dim", "key", "rep"]
    ordered = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = materialize(ordered.select("label", "dim", "rep", "q", F.monotonically_increasing_id().alias("at")), "ordered").withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("label", "dim", "part").agg(F.min("at").alias("low"), F.count("*").alias("many"))
    of = Window.partitionBy("label", "dim")
    shifts = runs.select("label", "dim", "part", (F.sum("many").over(of.orderBy("part")) - F.col("many") - F.col("low")).alias("shift"), F.sum("many").over(of).alias("whole"))
    placed = placed.join(small_or_shuffled(materialize(shifts, "shifts")), ["label", "dim", "part"]).withColumn("place", F.col("at") + F.col("shift"))
    chunk = F.floor(F.col("place") / CHUNK)
    following = F.when((chunk + 1) * CHUNK < F.col("whole"), F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("old")))
    both = F.filter(F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("old")), following), lambda x: x.isNotNull())
    sent = placed.select("label", "dim", "place", "rep", "q", F.inline(both))
    key = ["label", "dim", "chunk"]
    windows = sent.repartition(partitions(spark), *key).sortWithinPartitions(*key, "place")
    pairs = materialize(arrow_map(windows.select(*key, "old", "rep", "q"), _compared(threshold), "a long, b long, sure boolean").distinct(), "pairs")

    # pairs in the band around the threshold: once in double precision
    left, right = vectors.select(F.col("rep").alias("a"), F.col("v").alias("x")), vectors.select(F.col("rep").alias("b"), F.col("v").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    scaled = lambda v: F.transform(v, lambda t: t / F.array_max(F.transform(v, F.abs)))
    band = pairs.where("not sure").join(left, "a").join(right, "b").select("a", "b", scaled(F.col("x")).alias("x"), scaled(F.col("y")).alias("y"))
    band = band.where(dot(F.col("x"), F.col("y")) >= threshold * F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y")))).select("a", "b")
    return pairs.where("sure").select("a", "b").union(band)


def _pairs_near(x: np.ndarray, old: int, threshold: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Places of linked rows of ``x``, of which the first ``old`` meet the others only: pairs over the band as a spanning forest, and pairs in the band that join two of its trees."""
    x = x.astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    band = 2 * math.sqrt(x.shape[1]) / 32767 + 1e-5  # rounding turns a vector by less than half of this; the rest is for single precision
    parent = np.arange(len(x))

    def roots(at: np.ndarray) -> np.ndarray:
        up = parent[at]
        while (parent[up] != up).any():
            up = parent[up]
        parent[at] = up
        return up

    sure, open_ = [], []
    for lo in range(old, len(x), 512):
        hi = min(lo + 512, len(x))
        cosine = x[lo:hi] @ x[:hi].T
        near = cosine >= threshold - band
        near &= np.arange(hi)[None, :] < np.arange(lo, hi)[:, None]
        if not near.any():
            continue
        over = near & (cosine >= threshold + band)
        for i in np.flatnonzero(over.any(axis=1)).tolist():
            js = np.flatnonzero(over[i])
            trees, at = np.unique(roots(js), return_index=True)
            own = int(roots(np.array([lo + i]))[0])
            for tree, j in zip(trees.tolist(), js[at].tolist(), strict=True):
                if tree != own:
                    parent[tree] = own
                    sure.append((lo + i, j))
        if (left := np.argwhere(near & ~over)).size:
            left[:, 0] += lo
            open_.append(left)
    if not open_:
        return sure, np.empty((0, 2), np.int64)
    rest = np.concatenate(open_)
    return sure, rest[roots(rest[:, 0]) != roots(rest[:, 1])]


def _compared(threshold: float):
    """Links of each chunk's rows among themselves and with the ones before."""

    def result(reps: np.ndarray, old: np.ndarray, q: list[bytes]) -> Iterator[pa.RecordBatch]:
        x = np.frombuffer(b"".join(q), "<i2").reshape(len(q), -1)
        sure, rest = _pairs_near(x, int(old.sum()), threshold)
        for pairs, known in ((np.array(sure, np.int64).reshape(-1, 2), True), (rest, False)):
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(reps[pairs[:, 0]]), pa.array(reps[pairs[:, 1]]), pa.array([known] * len(pairs))], names=["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, old, q = None, [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "chunk")), strict=True))
            rep, before, packed = np.asarray(batch.column("rep")), np.asarray(batch.column("old")), batch.column("q")
            lo = 0
            for hi in range(1, len(keys) + 1):
                if hi < len(keys) and keys[hi] == keys[lo]:
                    continue
                if keys[lo] != now:
                    if now is not None:
                        yield from result(np.concatenate(reps), np.concatenate(old), q)
                    now, reps, old, q = keys[lo], [], [], []
                reps.append(rep[lo:hi])
                old.append(before[lo:hi])
                q += packed.slice(lo, hi - lo).to_pylist()
                lo = hi
        if now is not None:
            yield from result(np.concatenate(reps), np.concatenate(old), q)

    return run


def _links_inside(members: DataFrame, threshold: float) -> DataFrame:
    """``rep, links``: the weight of the other vectors of its component at the threshold or above."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, x, total = None, [], [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("component", "target", "source", "mine")), strict=True))
            rep, weight, dims = np.asarray(batch.column("rep")), np.asarray(batch.column("weight")), batch.column("dim").to_pylist()
            u = _unit(_matrix(batch.column("v"), dims[0])) if len(set(dims)) == 1 else None
            lo = 0
            for hi in range(1, len(keys) + 1):
                if hi < len(keys) and keys[hi] == keys[lo]:
                    continue
                if keys[lo][:3] != now:
                    if now is not None:
                        yield result(reps, total)
                    now, reps, x, total = keys[lo][:3], [], [], None
                part = u[lo:hi] if u is not None else _unit(_matrix(batch.column("v").slice(lo, hi - lo), dims[lo]))
                if keys[lo][3]:
                    reps.append(rep[lo:hi])
                    x.append(part)
                else:
                    if total is None:
                        reps, x = np.concatenate(reps), np.concatenate(x)
                        total = np.zeros(len(x), np.int64)
                    for i in range(0, len(part), 1024):
                        y, w, r = part[i : i + 1024], weight[lo + i : min(lo + i + 1024, hi)], rep[lo + i : min(lo + i + 1024, hi)]
                        for j in range(0, len(x), 4096):
                            near = (x[j : j + 4096] @ y.T >= threshold) & (reps[j : j + 4096, None] != r[None, :])
                            total[j : j + 4096] += near @ w
                lo = hi
        if now is not None:
            yield result(reps, total)

    def result(reps: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(total)], names=["rep", "links"])

    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    block = F.least(F.lit(65536), F.greatest(F.lit(256), F.ceil(F.col("m") / 16)))
    split = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    split = split.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a vector meets every block: first as one that is counted for, then as a partner
    both = F.array(F.struct(F.lit(True).alias("mine"), F.col("own").alias("target"), F.col("other").alias("source")), F.struct(F.lit(False).alias("mine"), F.col("other").alias("target"), F.col("own").alias("source")))
    sent = split.select("component", "rep", "weight", "dim", "v", F.inline(both)).select("component", "target", "source", "mine", "rep", "weight", "dim", "v")
    key = ["component", "target", "source"]
    ordered = sent.repartition(partitions(members.sparkSession), *key).sortWithinPartitions(*key, F.col("mine").desc())
    return arrow_map(ordered, count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
