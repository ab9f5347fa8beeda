"""Recursive fuzzy clustering of all recordings at once: best numbers of clusters, weights of dimensions, sub-clusters.

A level of the recursion is one grouped fit over all clusters that are still open, in all recordings.  A group of up to
``LOCAL_ROWS`` rows (a recording of the usual size) is fitted in one task, in NumPy.  A larger one is fitted step by step
over all of its rows: its centres are a row of a table that the rows are joined with, a step is a sum by group and centre that every task adds up for itself first,
and the state is written after each step.  Both give the same partition.  In a task the values of a single dimension are fitted once each, with the number of rows that have them.

The features of a row are an array of doubles, in the same order in all rows of a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import waveform as W
from .steps import Stages, small

#: Rows of a group up to which one task fits it.
LOCAL_ROWS = 200_000
MAX_ITER, EPSILON = 50, 1e-5
FIT = "k int, validity double, weights array<double>, centers array<array<double>>"


# -- in a task -------------------------------------------------------------------------------------


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)


def degrees(d2: np.ndarray) -> np.ndarray:
    """Degrees of membership (fuzzifier 2); a row on a centre is wholly its, shared between equal centres."""
    on = d2 == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        u = 1 / d2
        u /= u.sum(axis=1, keepdims=True)
    at = on.any(axis=1)
    u[at] = on[at] / on[at].sum(axis=1, keepdims=True)
    return u


def fit_centers(x: np.ndarray, centers: np.ndarray, max_iter: int = MAX_ITER, epsilon: float = EPSILON) -> tuple[np.ndarray, float]:
    """Centres and partition coefficient; ends after a step that changes the objective by less than ``epsilon``."""
    before = None
    for _ in range(max_iter):
        d2 = _distances(x, centers)
        u2 = degrees(d2) ** 2
        mass = u2.sum(axis=0)
        new = np.where(mass[:, None] > 0, u2.T @ x / np.where(mass > 0, mass, 1)[:, None], centers)
        # what the same degrees give around the new centres
        objective = (u2 * d2).sum() - (mass * ((new - centers) ** 2).sum(axis=1)).sum()
        centers = new
        if before is not None and abs(objective - before) < epsilon:
            break
        before = objective
    return centers, float((degrees(_distances(x, centers)) ** 2).sum() / len(x))


def validity(coefficient: float, k: int) -> float:
    return 1 - k / (k - 1) * (1 - coefficient)


def best_centers(x: np.ndarray, k_max: int, max_iter: int = MAX_ITER) -> tuple[np.ndarray, float]:
    """Centres of the most valid partition in 2 to ``k_max`` clusters; one centre and 0 where none is better than none, and where all rows are equal.

    Starts from the mean; each further centre is the first row with the least sum of distances to the centres so far, moved by ``EPSILON``.
    """
    centers = x.mean(axis=0)[None]
    best = (centers, 0.0)
    if (x == x[0]).all():
        return best
    if x.shape[1] == 1:
        return _best_of_values(x[:, 0], centers[0], k_max, max_iter)
    for k in range(2, k_max + 1):
        near = x[_distances(x, centers).sum(axis=1).argmin()]
        centers, coefficient = fit_centers(x, np.vstack([centers, near + EPSILON]), max_iter)
        if (got := validity(coefficient, k)) > best[1]:
            best = (centers, got)
    return best


def _shares(d2: np.ndarray) -> np.ndarray:
    """:func:`degrees` with a row a centre."""
    u = 1 / d2
    u /= u.sum(axis=0)
    if not d2.all():
        on = d2 == 0
        at = on.any(axis=0)
        u[:, at] = on[:, at] / on[:, at].sum(axis=0)
    return u


def _best_of_values(x: np.ndarray, centers: np.ndarray, k_max: int, max_iter: int) -> tuple[np.ndarray, float]:
    """:func:`best_centers` of one dimension: each value once, in the order of their first rows."""
    values, first, n = np.unique(x, return_index=True, return_counts=True)
    order = np.argsort(first)
    values, n = values[order], n[order].astype(float)
    best = (centers[:, None], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(2, k_max + 1):
            away = values - centers[:, None]
            centers = np.append(centers, values[(away * away).sum(axis=0).argmin()] + EPSILON)
            before = None
            for _ in range(max_iter):
                away = values - centers[:, None]
                d2 = away * away
                u2 = _shares(d2)
                u2 *= u2
                u2 *= n
                mass = u2.sum(axis=1)
                new = np.where(mass > 0, u2 @ values / mass, centers)
                objective = np.vdot(u2, d2) - np.dot(mass, (new - centers) ** 2)
                centers = new
                if before is not None and abs(objective - before) < EPSILON:
                    break
                before = objective
            away = values - centers[:, None]
            u = _shares(away * away)
            if (got := validity(float((u * u @ n).sum() / len(x)), k)) > best[1]:
                best = (centers[:, None], got)
    return best


def _repeated(x: np.ndarray, fits: list[tuple[np.ndarray, float]], least_overlap: float = 0.9) -> set[int]:
    """What :func:`redundant` finds in one group; ``fits``: centres and validity of each dimension, one centre where it doesn't divide."""
    dims = [d for d, (centers, _) in enumerate(fits) if len(centers) > 1]
    held = {}
    for d in dims:
        d2 = _distances(x[:, d : d + 1], fits[d][0])
        held[d] = (d2 == d2.min(axis=1, keepdims=True)).astype(float)
    gone: set[int] = set()
    for d in sorted(dims, key=lambda d: (len(fits[d][0]), d)):
        if d in gone:
            continue
        for e in dims:
            if e <= d or len(fits[e][0]) != len(fits[d][0]):
                continue
            common, own, theirs = held[d].T @ held[e], held[d].sum(axis=0), held[e].sum(axis=0)
            if not theirs.all():  # a cluster without a row fits into none
                continue
            of_first = (common / np.where(own > 0, own, 1)[:, None]).max(axis=0)
            if min(of_first.min(), (common / theirs).max(axis=0).min()) <= least_overlap:
                continue
            if fits[d][1] < fits[e][1]:
                gone.add(d)
                break
            gone.add(e)
    return gone


def core_partition(x: np.ndarray, k_max: int, k_weight: int, least_validity: float, drop_redundant: bool = False) -> tuple[int, float, list, list]:
    """``k, validity, weights, centers``: a dimension that divides into k clusters by itself weighs (k - 1)^2; without one the rows are one cluster (k = 1); k = 0 where the weighted rows have no valid partition."""
    fits = [best_centers(x[:, d : d + 1], k_weight) for d in range(x.shape[1])]
    fits = [(centers, valid) if valid >= least_validity else (centers[:1], 0.0) for centers, valid in fits]
    gone = _repeated(x, fits) if drop_redundant else set()
    weights = np.array([0.0 if d in gone else (len(centers) - 1.0) ** 2 for d, (centers, _) in enumerate(fits)])
    if not weights.any():
        return 1, 0.0, weights.tolist(), []
    centers, valid = best_centers(x * weights, k_max)
    return len(centers) if len(centers) > 1 else 0, valid, weights.tolist(), centers.tolist()


# -- over all tasks --------------------------------------------------------------------------------


def _d2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _degrees(x: str, centers: str) -> Column:
    """Structs ``pos, u, d2`` of a row's degrees."""
    d2 = F.transform(centers, lambda c: _d2(F.col(x), c))

    def share(all_: Column) -> Column:
        on = F.size(F.filter(all_, lambda d: d == 0))
        inverse = F.aggregate(all_, F.lit(0.0), lambda s, d: s + 1.0 / F.nullif(d, F.lit(0.0)))  # null, and not used, where a distance is 0
        return W.let(inverse, lambda total: F.transform(all_, lambda d, i: F.struct(i.alias("pos"), F.when(on > 0, F.when(d == 0, 1.0 / on).otherwise(0.0)).otherwise(1.0 / F.nullif(d, F.lit(0.0)) / total).alias("u"), d.alias("d2"))))

    return W.let(d2, share)


def fit_large(rows: DataFrame, keys: list[str], item: str, k_max: int, n_dims: int, stages: Stages, max_iter: int = MAX_ITER) -> DataFrame:
    """``keys, k, validity, centers`` of :func:`best_centers` for groups of any size; ``rows`` (``keys, item, x``) are written."""
    means = rows.groupBy(*keys).agg(F.array(*(F.avg(F.get("x", F.lit(i))) for i in range(n_dims))).alias("mean"), F.count("*").alias("n"), (F.min("x") == F.max("x")).alias("equal"))
    state = stages(means.select(*keys, "n", F.array("mean").alias("centers"), F.array("mean").alias("best"), F.lit(0.0).alias("validity"), "equal"), "state").where("not equal")
    done = means.where("equal").select(*keys, F.lit(1).alias("k"), F.lit(0.0).alias("validity"), F.array("mean").alias("centers"))
    for k in range(2, k_max + 1):
        summed = F.aggregate(F.transform("centers", lambda c: _d2(F.col("x"), c)), F.lit(0.0), lambda s, v: s + v)
        near = rows.join(small(state.select(*keys, "centers")), keys).groupBy(*keys).agg(F.min(F.struct(summed.alias("d"), F.col(item), F.col("x")))["x"].alias("near"))
        more = F.concat("centers", F.array(F.transform("near", lambda v: v + EPSILON)))
        state = stages(state.join(near, keys).select(*keys, "n", more.alias("centers"), "best", "validity", F.lit(None).cast("double").alias("objective"), F.lit(True).alias("moves")), "state")
        for _ in range(max_iter):
            moving = state.where("moves")
            if not moving.take(1):
                break
            state = stages(state.where("not moves").unionByName(_step(rows, moving, keys, n_dims)), "state")
        parts = rows.join(small(state.select(*keys, "centers")), keys).select(*keys, F.aggregate(_degrees("x", "centers"), F.lit(0.0), lambda s, c: s + c["u"] * c["u"]).alias("p"))
        valid = parts.groupBy(*keys).agg((1 - F.lit(k / (k - 1)) * (1 - F.avg("p"))).alias("got"))
        better = F.col("got") > F.col("validity")
        state = stages(state.join(valid, keys).select(*keys, "n", "centers", F.when(better, F.col("centers")).otherwise(F.col("best")).alias("best"), F.greatest("got", "validity").alias("validity")), "state")
    return state.select(*keys, F.size("best").alias("k"), "validity", F.col("best").alias("centers")).union(done)


def _step(rows: DataFrame, state: DataFrame, keys: list[str], n_dims: int) -> DataFrame:
    """One step of every group in ``state``: new centres, objective, and whether it still moves."""
    each = rows.join(small(state.select(*keys, "centers")), keys).select(*keys, "x", F.inline(_degrees("x", "centers")))
    w = F.col("u") * F.col("u")
    sums = each.groupBy(*keys, "pos").agg(F.sum(w).alias("mass"), F.sum(w * F.col("d2")).alias("spread"), F.array(*(F.sum(w * F.get("x", F.lit(i))) for i in range(n_dims))).alias("sums"))
    old = sums.join(state.select(*keys, "centers"), keys).withColumn("old", F.get("centers", F.col("pos")))
    new = old.withColumn("new", F.when(F.col("mass") > 0, F.transform("sums", lambda v: v / F.col("mass"))).otherwise(F.col("old")))
    moved = new.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda s: s["new"]).alias("centers"),
        F.sum(F.col("spread") - F.col("mass") * _d2(F.col("new"), F.col("old"))).alias("now"),
    )
    still = F.coalesce(F.abs(F.col("now") - F.col("objective")) >= EPSILON, F.lit(True))
    return moved.join(state.drop("centers"), keys).select(*keys, "n", "centers", "best", "validity", F.col("now").alias("objective"), still.alias("moves"))


def _by_size(rows: DataFrame, keys: list[str], least: int, stages: Stages) -> tuple[DataFrame, DataFrame, bool]:
    """Rows of groups that one task takes, rows of larger groups, and whether there are any; groups of under ``least`` rows are left out."""
    sizes = stages(rows.groupBy(*keys).agg(F.count("*").alias("size")), "sizes")
    near = rows.join(small(sizes.where((F.col("size") >= least) & (F.col("size") <= LOCAL_ROWS)).drop("size")), keys)
    many = sizes.where((F.col("size") >= least) & (F.col("size") > LOCAL_ROWS))
    return near, rows.join(small(many.drop("size")), keys), bool(many.take(1))


def _in_tasks(rows: DataFrame, keys: list[str], item: str, fit: Callable[[np.ndarray], tuple]) -> DataFrame:
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    centers = pa.list_(pa.list_(pa.float64()))

    def one(key: tuple, group: pa.Table) -> pa.Table:
        x = group.sort_by(item)["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        k, valid, weights, found = fit(x)
        columns = [*(pa.array([v.as_py()], v.type) for v in key), pa.array([k], pa.int32()), pa.array([valid], pa.float64()), pa.array([weights], pa.list_(pa.float64())), pa.array([found], centers)]
        return pa.table(columns, names=[*keys, "k", "validity", "weights", "centers"])

    return rows.select(*keys, item, "x").groupBy(*keys).applyInArrow(one, f"{kinds}, {FIT}")


def fit_groups(rows: DataFrame, keys: list[str], item: str, k_max: int, n_dims: int, stages: Stages, max_iter: int = MAX_ITER) -> DataFrame:
    """``keys, k, validity, centers`` of the best partition of each group; ``rows`` (``keys, item, x``) are written."""
    near, far, any_far = _by_size(rows, keys, 1, stages)

    def fit(x: np.ndarray) -> tuple:
        centers, valid = best_centers(x, k_max, max_iter)
        return len(centers), valid, [], centers.tolist()

    found = _in_tasks(near, keys, item, fit).select(*keys, "k", "validity", "centers")
    return found.union(fit_large(stages(far, "large"), keys, item, k_max, n_dims, stages, max_iter).select(*keys, "k", "validity", "centers")) if any_far else found


def by_dimension(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """A row for each dimension: ``keys, dim, item, x`` with an array of one value."""
    return rows.select(*keys, item, F.posexplode("x").alias("dim", "v")).select(*keys, "dim", item, F.array("v").alias("x"))


def redundant(labels: DataFrame, quality: DataFrame, keys: list[str], item: str, least_overlap: float = 0.9) -> DataFrame:
    """``keys, dim`` of the dimensions that repeat another one.

    ``labels``: ``keys, dim, item, cluster`` (a row a membership); ``quality``: ``keys, dim, k, validity`` of the dimensions that divide.  Dimensions of the same k are compared in
    their order; of two whose clusters fit into each other (in either direction, each cluster of the second overlaps with one of the first by more than ``least_overlap``)
    the less valid one goes, the second in a tie.  Only counts meet: a contingency table for every two dimensions, and the greedy choice reads a row a pair.
    """
    some = quality.where("k > 1").select(*keys, "dim", "k", "validity")
    held = labels.join(some, [*keys, "dim"])
    right = held.select(*keys, item, "k", F.col("dim").alias("dim2"), F.col("cluster").alias("cluster2"))
    both = held.join(right, [*keys, item, "k"]).where("dim < dim2").groupBy(*keys, "k", "dim", "dim2", "cluster", "cluster2").agg(F.count("*").alias("common"))
    sizes = held.groupBy(*keys, "dim", "cluster").agg(F.count("*").alias("n"))
    both = both.join(sizes, [*keys, "dim", "cluster"]).join(sizes.select(*keys, F.col("dim").alias("dim2"), F.col("cluster").alias("cluster2"), F.col("n").alias("n2")), [*keys, "dim2", "cluster2"])
    best = both.groupBy(*keys, "k", "dim", "dim2", "cluster2").agg(F.max(F.col("common") / F.col("n")).alias("of_first"), F.max(F.col("common") / F.col("n2")).alias("of_second"))
    fits = best.groupBy(*keys, "k", "dim", "dim2").agg(F.min(F.least("of_first", "of_second")).alias("fit"), F.count("*").alias("seen")).where((F.col("fit") > least_overlap) & (F.col("seen") == F.col("k")))
    pairs = fits.join(some.drop("k"), [*keys, "dim"]).join(some.select(*keys, F.col("dim").alias("dim2"), F.col("validity").alias("validity2")), [*keys, "dim2"])
    kinds = ", ".join(f"`{k}` {labels.schema[k].dataType.simpleString()}" for k in keys)

    def greedy(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        for (_, dim), others in group.sort_values(["k", "dim", "dim2"]).groupby(["k", "dim"]):
            if dim in gone:
                continue
            for r in others.itertuples():
                if r.validity < r.validity2:
                    gone.add(dim)
                    break
                gone.add(r.dim2)
        return pd.DataFrame([[*key, d] for d in sorted(gone)], columns=[*keys, "dim"])

    return pairs.groupBy(*keys).applyInPandas(greedy, f"{kinds}, dim int")


def core_fits(rows: DataFrame, keys: list[str], item: str, n_dims: int, k_max: int, stages: Stages, k_weight: int = 4, least: int = 50, least_validity: float = 0.75, drop_redundant: bool = False) -> DataFrame:
    """``keys, k, weights, centers`` of :func:`core_partition` for each group of ``least`` rows or more; ``rows`` (``keys, item, x``) are written."""
    near, far, any_far = _by_size(rows, keys, least, stages)
    columns = [*keys, "k", "weights", "centers"]
    local = _in_tasks(near, keys, item, lambda x: core_partition(x, k_max, k_weight, least_validity, drop_redundant)).select(*columns)
    if not any_far:
        return local
    far = stages(far, "large")
    long = stages(by_dimension(far, keys, item), "dimensions")
    alone = stages(fit_groups(long, [*keys, "dim"], item, k_weight, 1, stages), "dimension_fits")
    alone = alone.withColumn("k", F.when(F.col("validity") >= least_validity, F.col("k")).otherwise(1))
    weight = F.col("k") - 1
    if drop_redundant:
        labels = assigned(long, alone.where("k > 1").withColumn("weights", F.array(F.lit(1.0))), [*keys, "dim"]).select(*keys, "dim", item, F.col("child").alias("cluster"))
        gone = redundant(labels, alone, keys, item).withColumn("gone", F.lit(True))
        alone = alone.join(gone, [*keys, "dim"], "left")
        weight = F.when(F.col("gone"), 0).otherwise(weight)
    weights = alone.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", (weight * weight).cast("double").alias("w")))), lambda s: s["w"]).alias("weights"))
    weights = stages(weights, "weights").withColumn("any", F.exists("weights", lambda w: w > 0))
    scaled = stages(far.join(small(weights.where("any").drop("any")), keys).select(*keys, item, F.zip_with("x", "weights", lambda v, w: v * w).alias("x")), "weighted")
    fits = fit_groups(scaled, keys, item, k_max, n_dims, stages).join(weights, keys).select(*keys, F.when(F.col("k") > 1, F.col("k")).otherwise(0).alias("k"), "weights", "centers")
    whole = weights.where("not any").select(*keys, F.lit(1).alias("k"), "weights", F.array().cast("array<array<double>>").alias("centers"))
    return local.union(fits).union(whole)


def assigned(rows: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``child``, the number (from 0) of the centre of largest degree: a row for each in a tie; one child 0 where a group is a single cluster; groups without a fit, or with none valid, go."""
    near = rows.join(fits.where("k > 0").select(*keys, "k", "weights", "centers"), keys)
    scaled = F.zip_with("x", "weights", lambda v, w: v * w)
    d2 = W.let(scaled, lambda x: F.transform("centers", lambda c: _d2(x, c)))
    ties = W.let(d2, lambda all_: W.let(F.array_min(all_), lambda low: F.filter(F.transform(all_, lambda d, i: F.when(d == low, i)), lambda i: i.isNotNull())))
    return near.withColumn("child", F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(ties))).drop("weights", "centers")


def core_loop(
    members: DataFrame, by: list[str], item: str, features: Callable[[DataFrame, str], DataFrame], n_dims: int, k_first: int = 6, k_next: int = 4,
    k_weight: int = 4, depth: int = 5, least: int = 50, least_validity: float = 0.75, drop_redundant: bool = False,
) -> DataFrame:
    """``by, item, cluster`` (from 1) after up to ``depth`` levels of partitions: every row that is still in a cluster, once for each of its clusters.

    ``members``: ``by, item``.  ``features(members, group)`` gives ``group, item, x`` for members with a column ``group``, one value a cluster; they are made anew
    for each level, from the cluster's rows alone.  Clusters of under ``least`` rows go with their rows; one that doesn't divide, or whose
    only child is itself, is final.  Clusters are numbered in the order of their first levels' children.
    """
    stages = Stages(members.sparkSession)
    columns = [*by, item, "path", "open"]
    state = stages(members.select(*by, item, F.lit("").alias("path"), F.lit(True).alias("open")), "members")
    for level in range(depth):
        now = state.where("open")
        if not now.take(1):
            break
        group = F.to_json(F.struct(*by, "path"))
        now = now.withColumn("group", group)
        x = stages(features(now.select("group", *by, item), "group").select("group", item, F.col("x")), "features")
        fits = small(stages(core_fits(x, ["group"], item, n_dims, k_next if level else k_first, stages, k_weight, least, least_validity, drop_redundant), "fits"))
        placed = stages(now.join(assigned(x, fits, ["group"]).select("group", item, "k", "child"), ["group", item]), "children")
        sizes = placed.groupBy("group", "child").agg(F.count("*").alias("size")).join(now.groupBy("group").agg(F.count("*").alias("parent")), "group")
        large = sizes.where((F.col("size") >= least)).select("group", "child", (F.col("size") < F.col("parent")).alias("smaller"))
        single = F.col("k") == 1
        path = F.when(single, F.col("path")).otherwise(F.concat("path", F.char(F.col("child") + 97)))
        kept = placed.join(small(stages(large, "large_children")), ["group", "child"]).select(*by, item, path.alias("path"), (~single & F.col("smaller")).alias("open"))
        state = stages(state.where("not open").select(*columns).union(kept.select(*columns)), "members")
    order = state.select(*by, "path").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy(*by).orderBy("path")))
    out = stages(state.join(order, [*by, "path"]).select(*by, item, "cluster"), "clusters")
    stages.drop(keep=1)
    return out
