"""Operators over wires, scores and memberships that several stages of sorting share; all of built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waveform as W
from . import geometry, selection
from .moments import moments


def pending(files: DataFrame, done: DataFrame, ending: str = ".ntt") -> DataFrame:
    """Paths with the ending, in any case, outside hidden folders, that have no result yet."""
    open_ = files.where(F.lower("path").endswith(ending) & ~F.col("path").startswith(".") & ~F.col("path").contains("/."))
    return open_.join(done.select("path"), "path", "left_anti")


def overlapping(members: DataFrame, key: str, item: str, share: float) -> DataFrame:
    """``a, b, common, merge`` for the pairs of clusters with common items; ``merge``: they hold more than ``share`` of the smaller one.

    Pairs are made by item: an item is in a few clusters, whatever their sizes.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("n"))
    both = members.select(F.col(key).alias("a"), item).join(members.select(F.col(key).alias("b"), item), item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    for end in "ab":
        both = both.join(sizes.select(F.col(key).alias(end), F.col("n").alias(f"n{end}")), end)
    return both.select("a", "b", "common", (F.col("common") > share * F.least("na", "nb")).alias("merge"))


def rep_wire(wires: list[str], thresholds: list[float], ranges: list[float]) -> Column:
    """Number (from 1) of the wire that stands for a spike.

    The wire of the highest peak that isn't at its input range; but where a valley precedes that peak, the next
    wire that peaks at its threshold or above within a twentieth of the samples of the last such valley.
    """
    n = F.size(wires[0])
    one = lambda w, t, r, i: F.struct((-F.when(F.array_max(w) >= r - 0.1, float("-inf")).otherwise(F.array_max(w))).alias("low"), F.lit(i + 1).alias("wire"), F.lit(t - 0.1).alias("limit"), W.first_argmax(F.col(w)).alias("at"), F.col(w).alias("wf"))
    order = F.array_sort(F.array(*(one(w, t, r, i) for i, (w, t, r) in enumerate(zip(wires, thresholds, ranges, strict=True)))))
    reach = F.round(0.05 * n)

    def chosen(o: Column) -> Column:
        first = F.get(o, F.lit(0))
        valley = W.let(first["wf"], lambda w: F.array_max(F.filter(W.local_valleys(w), lambda i: i < W.first_argmax(w))))
        other = lambda v: F.get(F.filter(F.slice(o, 2, len(wires)), lambda x: (-x["low"] >= x["limit"]) & (F.abs(x["at"] - v) <= reach)), F.lit(0))["wire"]
        return W.let(valley, lambda v: F.coalesce(F.when(v.isNotNull(), other(v)), first["wire"]))

    return W.let(order, chosen)


def peaks_near(wires: list[str], wire: str, reach: int) -> list[Column]:
    """The largest sample of each wire within ``reach`` of the peak of the wire whose number is in ``wire``."""
    own = F.get(F.array(*wires), F.col(wire) - 1)
    at = W.first_argmax(own)
    start = F.greatest(F.lit(0), at - reach)
    return [F.array_max(F.slice(w, start + 1, F.least(F.size(w) - 1, at + reach) - start + 1)) for w in wires]


def zscored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their mean, over their deviation; a constant column becomes 0."""
    stats = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev(c).alias(f"s_{c}") for c in columns))  # one row
    z = {c: F.when(F.col(f"s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0))) for c in columns}
    return rows.crossJoin(stats).withColumns(z).select(*rows.columns)


def pass_thresholds(n_passes: int) -> list[float]:
    if n_passes <= 1:
        return []
    fixed = {2: [0.0], 3: [1.0, 0.0], 4: [1.5, 1.0, 0.0]}
    return fixed.get(n_passes) or [2.0 - 2.0 * i / (n_passes - 2) for i in range(n_passes - 1)]


def passes(rows: DataFrame, score: str, n_passes: int, least: int = 600, least_rows: int = 10_000) -> DataFrame:
    """``rows`` of each pass with its number: falling thresholds, then everything.  Passes of under ``least`` rows go; small tables have the last one only."""
    limits = pass_thresholds(n_passes) if rows.count() > least_rows else []
    number = F.array(*(F.when(F.col(score) > t, F.lit(i + 1)) for i, t in enumerate(limits)), F.lit(n_passes))
    long = rows.withColumn("pass", F.explode(F.filter(number, lambda x: x.isNotNull())))
    enough = long.groupBy("pass").agg(F.count("*").alias("n")).where((F.col("n") >= least) | (F.col("pass") == n_passes)).select("pass")
    return long.join(enough, "pass", "left_semi")


def first_valley(wave: str, threshold: float, only_left: bool = False) -> Column:
    """``valley, peak`` (places from 1, 0 for none): of the first three valleys after the first peak the first one under the threshold that a later peak follows."""
    w = F.col(wave)
    peaks, valleys = W.local_peaks(w), W.local_valleys(w)
    start = F.when((F.size(peaks) == 0) | F.coalesce(F.get(valleys, F.lit(0)) < F.get(peaks, F.lit(0)), F.lit(False)), 0).otherwise(F.get(peaks, F.lit(0)))

    def found(s: Column) -> Column:
        near = F.slice(F.filter(valleys, lambda i: i > s), 1, 3)
        fits = F.filter(near, lambda i: (F.get(w, i) < threshold) & (F.lit(only_left) | F.coalesce(F.array_max(peaks) > i, F.lit(False))))
        return F.struct(F.coalesce(F.get(fits, F.lit(0)) + 1, F.lit(0)).alias("valley"), (s + 1).alias("peak"))

    return W.let(start, found)


def smoothed(counts: DataFrame, key: str, at: str, value: str, reach: int = 2) -> DataFrame:
    """``key, at, smooth``: moving average whose span shrinks towards both ends; absent places between the ends count 0."""
    ends = counts.groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    filled = ends.select(key, "lo", "hi", F.explode(F.sequence("lo", "hi")).alias(at)).join(counts, [key, at], "left")
    filled = filled.select(key, at, "lo", "hi", F.coalesce(value, F.lit(0)).alias("v"))
    sent = filled.select(key, "v", F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)).alias("to"), F.col(at).alias("from"))
    near = filled.select(key, F.col(at).alias("to"), F.least(F.lit(reach), F.col(at) - F.col("lo"), F.col("hi") - F.col(at)).alias("r")).join(sent, [key, "to"])
    return near.where(F.abs(F.col("from") - F.col("to")) <= F.col("r")).groupBy(key, F.col("to").alias(at)).agg(F.avg("v").alias("smooth"))


def chi2_limit(share: float, dims: int) -> float:
    """The value that a chi-squared variable stays under with probability ``share``; the tail by its recurrence, the inverse by bisection."""

    def tail(x: float) -> float:
        n, out = (2, math.exp(-x / 2)) if dims % 2 == 0 else (1, math.erfc(math.sqrt(x / 2)))
        while n < dims:
            out += math.exp(n / 2 * math.log(x / 2) - x / 2 - math.lgamma(n / 2 + 1)) if x else 0.0
            n += 2
        return out

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 1 - share else (lo, mid)
    return (lo + hi) / 2


def overlap_test(rows: DataFrame, keys: list[str], value: str, points: int = 100) -> DataFrame:
    """``keys, passed, good``: whether the values of a group have more than one mode.

    A kernel density at ``points`` places, 3 widths beyond both ends; its sums are one aggregate
    each, so no row is multiplied.  A group passes where the density between two peaks falls under .75 of the
    higher one and more than min(.25 n, 500) values lie on the lower one's side; in groups of over 5,000 also where a
    plateau of over half the peak lies off it.  ``good``: the fall is to .35, or both peaks are of like height.
    """
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev(value).alias("s"), F.count("*").alias("n"))
    z = rows.join(stats, keys).select(*keys, "n", ((F.col(value) - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("z"), (0.75 * F.pow(4 / (3.0 * F.col("n")), F.lit(0.2))).alias("h"))
    ends = z.groupBy(*keys).agg((F.min("z") - 3 * F.first("h")).alias("lo"), (F.max("z") + 3 * F.first("h")).alias("hi"))
    placed = z.join(ends, keys)
    x = lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1)
    kernel = lambda i: F.sum(F.exp(-F.pow((F.col("z") - x(i)) / F.col("h"), F.lit(2)) / 2))
    density = placed.groupBy(*keys, "n", "h", "lo", "hi").agg(F.array(*(kernel(F.lit(i)) for i in range(points))).alias("sums"))
    density = density.select(*keys, "n", "lo", "hi", F.transform("sums", lambda v: v / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("f"))
    f = F.col("f")
    density = density.withColumns({"pk": W.local_peaks(f), "vl": W.local_valleys(f)})
    top = F.get(F.filter("pk", lambda i: F.get(f, i) == F.array_max(F.transform("pk", lambda j: F.get(f, j)))), F.lit(0))
    flat = lambda p: F.exists(F.sequence(F.lit(0), F.lit(points - 2)), lambda i: (F.abs(F.get(f, i + 1) - F.get(f, i)) < 1e-3) & (F.abs(i - p) > 10) & (F.get(f, i) > 0.5 * F.get(f, p)))
    density = density.withColumn("plateau", (F.size("pk") > 0) & (F.col("n") > 5000) & F.coalesce(W.let(top, flat), F.lit(False)))
    best = lambda part: F.array_max(F.transform(part, lambda i: F.get(f, i)))
    dips = density.select(*keys, "n", "lo", "hi", "f", "pk", F.explode("vl").alias("at")).select(*keys, "n", "at", (F.col("lo") + F.col("at") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"), F.get(f, F.col("at")).alias("val"), best(F.filter("pk", lambda i: i < F.col("at"))).alias("before"), best(F.filter("pk", lambda i: i > F.col("at"))).alias("after"))
    dips = dips.where("before is not null and after is not null")
    # one join of a group's values with its few dips
    sides = dips.join(z.select(*keys, "z"), keys).groupBy(*keys, "at", "n", "val", "before", "after").agg(F.sum((F.col("z") < F.col("x")).cast("int")).alias("under"), F.sum((F.col("z") > F.col("x")).cast("int")).alias("over"))
    low, high = F.least("before", "after"), F.greatest("before", "after")
    hit = (F.col("val") < 0.75 * high) & (F.when(F.col("before") <= F.col("after"), F.col("under")).otherwise(F.col("over")) > F.least(0.25 * F.col("n"), F.lit(500.0)))
    fine = (F.col("val") < 0.35 * high) | ((low > 0.7 * high) & (F.col("val") < 0.7 * high))
    found = sides.where(hit).groupBy(*keys).agg(F.min_by(fine, "at").alias("fine"))
    return density.join(found, keys, "left").select(*keys, (F.col("plateau") | F.col("fine").isNotNull()).alias("passed"), (~F.col("plateau") & F.coalesce("fine", F.lit(False))).alias("good"))


def output_rows(rows: DataFrame, item: str, ts: str, key: str, wires: list[str]) -> DataFrame:
    """``ts_s, cluster_id, wf``: one row an item, the highest of its clusters, its wires one after another."""
    got = rows.groupBy(item, ts).agg(F.max(key).alias("cluster_id"), F.first(F.concat(*wires)).alias("wf"))
    return got.select((F.col(ts) / 1e6).alias("ts_s"), "cluster_id", "wf")


def classified(members: DataFrame, new: DataFrame, key: str, item: str | list[str], dims: list[str], n_std: float, by: list[str] | None = None) -> DataFrame:
    """``by, item, key``: the highest cluster whose members' median distance plus ``n_std`` deviations takes the row; 0 for none.

    Rows meet the clusters of their recording (``by``; one recording where it is left out), a row a cluster.
    """
    keys, items = [*(by or []), key], [item] if isinstance(item, str) else item
    fit = geometry.factored(moments(members, keys, dims), dims)
    own = members.join(fit, keys).withColumn("d", geometry.mahalanobis(dims))
    clusters = fit.join(selection.limits(own, keys, "d", n_std), keys)
    near = (new.join(clusters, by, "left") if by else new.crossJoin(clusters)).withColumn("d", geometry.mahalanobis(dims))
    return near.groupBy(*(by or []), *items).agg(F.coalesce(F.max(F.when(F.col("d") < F.col("limit"), F.col(key))), F.lit(0)).cast("int").alias(key))
