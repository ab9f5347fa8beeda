"""All grades of all clusters of all recordings: isolation, timing, shape, validity, and the final grade.

A recording's rows meet its clusters once where distances to a cluster are asked for; everything else is a sum by cluster, or a table of clusters, of which
two meet for each pair of clusters in a recording.  Groups may hold any share of the rows: medians are selected, fits go by size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waveform as W
from . import cores, geometry, grading, refinement, selection, trains
from .moments import moments
from .steps import Stages, small

SPLINE_POINTS = 5000


@lru_cache(maxsize=8)
def spline_matrix(n: int, points: int) -> np.ndarray:
    """What turns ``n`` samples into ``points`` evenly spaced values of the cubic spline through them, whose third derivative doesn't jump at the second and the last but one sample.

    Two samples give a line, three a parabola.
    """
    place = np.linspace(0, n - 1, points)
    if n < 4:
        return np.vander(place, n) @ np.linalg.inv(np.vander(np.arange(n), n))
    left, right = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        left[i, i - 1 : i + 2], right[i, i - 1 : i + 2] = (1, 4, 1), (6, -12, 6)
    left[0, :3], left[-1, -3:] = (1, -2, 1), (1, -2, 1)
    bend = np.linalg.solve(left, right)  # second derivatives at the samples
    low = np.minimum(place.astype(int), n - 2)
    t = (place - low)[:, None]
    one = np.eye(n)
    return (1 - t) * one[low] + t * one[low + 1] + (((1 - t) ** 3 - (1 - t)) * bend[low] + (t**3 - t) * bend[low + 1]) / 6


def run_over(s: np.ndarray, percent: float) -> int | None:
    """Length less one of the run around the largest value in which values reach ``percent`` of it, as :func:`.grading.half_peak_range` has it; None without a positive peak."""
    top = int(s.argmax())
    if s[top] <= 0:
        return None
    inner = np.arange(1, len(s) - 1)
    falls = inner[(s[1:-1] < s[:-2]) & (s[1:-1] <= s[2:])]
    low = int(falls[falls < top].max(initial=0))
    under = np.flatnonzero(s < s[low])
    high = int(under[under > low].min(initial=len(s))) - 1
    short = np.flatnonzero(s < s[top] * percent)
    return min(high, int(short[short > top].min(initial=len(s))) - 1) - max(low, int(short[short < top].max(initial=-1)) + 1)


def widths(means: DataFrame, wave: str, microseconds: float = 1250.0, percent: float = 0.25) -> DataFrame:
    """``means`` with ``width``: how long the splined wave stays over ``percent`` of its peak; 0 without a positive peak, null for a null wave or one of under two samples.  A row is a mean wave, one a cluster."""
    names = means.columns
    at = names.index(wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for w in batch.column(at).to_pylist():
                length = run_over(spline_matrix(len(w), SPLINE_POINTS) @ np.array(w, float), percent) if w and len(w) > 1 else None
                made.append((microseconds * length / SPLINE_POINTS if length is not None else 0.0) if w and len(w) > 1 else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*names, "width"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in means.schema.fields)
    return means.mapInArrow(run, f"{kinds}, width double")


def mean_waves(rows: DataFrame, keys: list[str], wave: str) -> DataFrame:
    """``keys, mean``: the mean wave of each group."""
    each = rows.select(*keys, F.posexplode(wave).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("mean"))


def bhattacharyya(pairs: DataFrame, dims: list[str], other: str = "o_") -> DataFrame:
    """``pairs`` (moments and ``use_<d>`` beside those named ``other``...) with ``bhat`` over the dimensions that both use, and ``shared``, their number; null without one."""
    use = lambda d: F.col(f"use_{d}") & F.col(f"{other}use_{d}")
    own, theirs = lambda a, b: F.col(f"c_{a}_{b}"), lambda a, b: F.col(f"{other}c_{a}_{b}")
    out = geometry.factored(pairs, dims, geometry.chosen(own, use), "x_")
    out = geometry.factored(out, dims, geometry.chosen(theirs, use), "y_")
    out = geometry.factored(out, dims, geometry.chosen(lambda a, b: (own(a, b) + theirs(a, b)) / 2, use), "z_")
    n = len(dims)
    apart = geometry.quadratic([F.when(use(d), F.col(f"mu_{d}") - F.col(f"{other}mu_{d}")).otherwise(0.0) for d in dims], "z_") / 8
    both = geometry.determinant(n, "x_") * geometry.determinant(n, "y_")
    shared = geometry.total([use(d).cast("int") for d in dims])
    bhat = apart + F.log(geometry.determinant(n, "z_") / F.nullif(F.sqrt(both), F.lit(0.0))) / 2
    return out.withColumn("shared", shared).withColumn("bhat", F.when(shared > 0, bhat))


def described_by(rows: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """``keys``, moments and ``use_<d>``."""
    return moments(rows, keys, dims).join(geometry.usable(rows, keys, dims), keys)


def graded(
    spikes: DataFrame, members: DataFrame, by: list[str], key: str, item: str, ts: str, wires: list[str], peaks: list[str], thresholds: list[float], template: list[float],
    short_isi: float = 1e-3, few_wires: int = 2,
) -> DataFrame:
    """A row a cluster (``by, key``) with its size ``n`` and the grades, ``final_grade`` and ``confidence`` of :func:`.grading.final_grades`.

    ``spikes``: ``by, item, ts`` (microseconds), waves ``wires`` and ``peaks`` of all rows; ``members``: ``by, key, item``.  A cluster's own wire is the one on which most of its
    rows have their highest peak (the first in a tie).  Rows in no cluster are unsorted; distances to them are null where there are none, and the one to the unsorted
    rows nearby is infinite where these are under a fifth of the cluster.

    Cases: a cluster of one row has no fit and no wave grades (0); undefined grades are null, which no rule takes; an empty table of members gives an empty result.
    """
    stages = Stages(spikes.sparkSession)
    spikes = stages(spikes.select(*by, item, ts, *wires, *peaks), "spikes")
    own = stages(members.select(*by, key, item).distinct().withColumn("g", refinement.group(by, key)).join(spikes, [*by, item]), "own")
    names = own.select(*by, key, "g").distinct()
    loose = stages(spikes.join(members.select(*by, item).distinct(), [*by, item], "left_anti").select(*by, item, *peaks), "loose")
    span = spikes.groupBy(*by).agg((F.max(ts) - F.min(ts)).alias("span"), F.avg(ts).alias("t_mean"), F.stddev(ts).alias("t_std"))

    best = F.array_position(F.array(*peaks), F.greatest(*peaks) if len(peaks) > 1 else F.col(peaks[0])).cast("int")
    wire = stages(own.groupBy("g").agg(F.mode(best, True).alias("wire"), F.count("*").alias("n")), "wires")
    limit = F.get(F.array(*(F.lit(float(t)) for t in thresholds)), F.col("wire") - 1)
    on_wire = own.join(small(wire.select("g", "wire")), "g").select("g", F.get(F.array(*wires), F.col("wire") - 1).alias("wave"), F.get(F.array(*peaks), F.col("wire") - 1).alias("v"), limit.alias("limit"))
    on_wire = stages(on_wire, "on_wire")

    described = stages(names.join(described_by(own, ["g"], peaks), "g"), "described")
    outside = refinement.complement(spikes, own, by, peaks).join(refinement.usable_outside(spikes, own, by, peaks), "g")
    lratio = geometry.lratio(own.select("g", *peaks), outside, ["g"], peaks)
    cv = lambda p: F.stddev(p) / F.nullif(F.avg(p), F.lit(0.0))
    first = F.array_position(F.array(*(F.avg(p) for p in peaks)), F.greatest(*(F.avg(p) for p in peaks)) if len(peaks) > 1 else F.avg(peaks[0])).cast("int")
    cvs = own.groupBy("g").agg(F.get(F.array(*(cv(p) for p in peaks)), first - 1).alias("cv"))
    short = trains.intervals(own.select("g", ts, item), "g", ts, item).groupBy("g").agg(F.avg((F.col("isi") < short_isi).cast("int")).alias("short_isi"), trains.share(F.col("isi") < 7.5e-3, F.col("isi") < 0.1).alias("burst"))
    below = grading.incompleteness(on_wire, "g", "v", F.col("limit"))
    iso = on_wire.groupBy("g").agg((F.pow(F.avg("v") - F.first("limit"), F.lit(2)) / F.nullif(F.var_samp("v"), F.lit(0.0))).alias("iso"))
    middle = selection.medians(own, ["g"], ts).withColumnRenamed("median", "t_median")
    times = own.groupBy(*by, "g").agg(F.stddev(ts).alias("t_own")).join(span, by).join(wire, "g").join(middle, "g")
    times = times.select(*by, "g", "n", (2 * F.col("t_own") / F.nullif(F.col("span"), F.lit(0))).alias("share"), (F.col("n") * 1e6 / F.nullif(F.col("span"), F.lit(0))).alias("rate"), (F.abs(F.col("t_median") - F.col("t_mean")) > F.col("t_std")).alias("non_stationary"))
    many = geometry.usable(own, ["g"], peaks, tolerance=0.5).select("g", geometry.total([F.col(f"use_{p}").cast("int") for p in peaks]).alias("wires"))

    other = geometry.named_other(described.drop(key), by)
    near = bhattacharyya(described.join(other, by).where("g <> o_g"), peaks).groupBy("g").agg(F.min("bhat").alias("min_bhat"))
    unsorted = geometry.named_other(described_by(loose, by, peaks), by)
    far = bhattacharyya(described.join(unsorted, by), peaks).select("g", F.col("bhat").alias("bhat_unsorted"))
    low = loose.where(geometry.total([(F.col(p) < 1.5 * t).cast("int") for p, t in zip(peaks, thresholds, strict=True)]) == len(peaks))
    mua = bhattacharyya(described.join(geometry.named_other(described_by(low, by, peaks), by), by), peaks).where((F.col("shared") > 1) & (F.col("o_n") > 0.5 * F.col("n"))).select("g", F.col("bhat").alias("bhat_mua"))
    nearby = _nearby(own, loose, described, by, item, peaks, stages)

    fits = cores.fit_groups(stages(own.select("g", item, F.array(*peaks).alias("x")), "points"), ["g"], item, 2, len(peaks), stages).select("g", F.col("validity").alias("mpc"))
    waves = stages(mean_waves(on_wire, ["g"], "wave"), "waves")
    centred = W.let(F.aggregate("mean", F.lit(0.0), lambda a, v: a + v) / F.size("mean"), lambda m: F.transform("mean", lambda v: v - m))
    shapes_ = widths(waves, "mean").select("g", "width", grading.valley_after_peak("mean").alias("valley"), W.template_snr(centred, template).alias("template"))
    part = waves.where(F.array_max("mean") > 0).withColumn("h", grading.half_peak_range("mean", 0.25)).select("g", "mean", "h.*")
    spread = grading.half_peak_spread(on_wire.join(small(stages(part, "ranges")), "g"), "g", "wave", "mean", "start", "end").select("g", F.col("low_share").alias("snr"))

    out = names.join(times.drop(*by), "g")
    for one in (lratio, cvs, short, below, iso, many, near, far, mua, nearby, fits, shapes_, spread):
        out = out.join(stages(one, "grades"), "g", "left")
    single = F.col("n") == 1
    out = out.withColumns({c: F.when(single, 0.0).otherwise(F.col(c)) for c in ("mpc", "width", "template")} | {"wires": F.when(single, 0).otherwise(F.col("wires")), "min_bhat": F.coalesce("min_bhat", F.lit(float("inf")))})
    result = stages(grading.final_grades(out, few_wires).drop("g"), "graded")
    stages.drop(keep=1)
    return result


def _nearby(own: DataFrame, loose: DataFrame, described: DataFrame, by: list[str], item: str, peaks: list[str], stages: Stages) -> DataFrame:
    """``g, n_near, bhat_near``: the unsorted rows within median + 5 deviations of the cluster's own distances."""
    plain: Column = geometry.mahalanobis(peaks)
    fit = stages(geometry.factored(described, peaks), "nearby_fits")
    far = own.select("g", *peaks).join(small(fit.drop(*by)), "g").select("g", plain.alias("_d"))
    reach = selection.limits(stages(far, "own_distances"), ["g"], "_d", 5.0)
    met = loose.join(small(stages(fit.join(reach, "g"), "reach")), by)
    near = stages(met.where(plain < F.col("limit")).select("g", *peaks), "near")
    with_loose = described.join(loose.select(*by).distinct(), by, "left_semi").select("g", "n")
    pairs = bhattacharyya(described.join(geometry.named_other(described_by(near, ["g"], peaks), ["g"]), "g"), peaks).select("g", F.col("o_n").alias("n_near"), "bhat")
    found = with_loose.join(pairs, "g", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    return found.select("g", "n_near", F.when(F.col("n_near") > 0.2 * F.col("n"), F.col("bhat")).otherwise(float("inf")).alias("bhat_near"))
