"""Refinement of clusters: cores, expansion in scaled features, a second round on peaks with the first as backup, and the final fill.

All clusters of all recordings go through each step at once.  A cluster is a value of ``g`` (recording and cluster as one text), its description a row of moments
with a flag and a scale for each dimension: dimensions that a cluster doesn't use add nothing to its distances, so clusters that use different ones share one plan.
Rows meet the clusters of their own recording only.  What a cluster's complement looks like follows from the recording's moments and its own.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features as P
from . import geometry, grading, selection, shapes
from .moments import moments
from .steps import Stages, small

CORE_STD, PEAK_STD = 1.0, 2.5
GOOD_RATING = 0.05


def group(by: list[str], key: str) -> Column:
    return F.to_json(F.struct(*by, key))


def complement(rows: DataFrame, inside: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    """``g, n, mu_<d>, c_<d>_<e>`` of the recording's rows outside each cluster, from the moments of both: no pass over the rows outside."""
    pairs = list(combinations_with_replacement(dims, 2))
    whole = moments(rows, by, dims)
    whole = whole.select(*by, *(F.col(c).alias(f"t_{c}") for c in whole.columns if c not in by))
    own = moments(inside, [*by, "g"], dims).join(whole, by)
    n, many = F.col("n"), F.col("t_n")
    rest = many - n
    mean = {d: (many * F.col(f"t_mu_{d}") - n * F.col(f"mu_{d}")) / F.nullif(rest, F.lit(0)) for d in dims}
    away = {d: F.col(f"mu_{d}") - mean[d] for d in dims}
    scatter = lambda a, b: F.coalesce((many - 1) * F.col(f"t_c_{a}_{b}"), F.lit(0.0)) - F.coalesce((n - 1) * F.col(f"c_{a}_{b}"), F.lit(0.0)) - n * rest / many * away[a] * away[b]
    return own.select("g", rest.alias("n"), *(v.alias(f"mu_{d}") for d, v in mean.items()), *((scatter(a, b) / F.nullif(rest - 1, F.lit(0))).alias(f"c_{a}_{b}") for a, b in pairs))


def usable_outside(rows: DataFrame, inside: DataFrame, by: list[str], dims: list[str], tolerance: float = 0.05) -> DataFrame:
    """``g, use_<d>``: as :func:`.geometry.usable`, of the rows outside each cluster: a value is missing there if the cluster has all rows with it."""
    long = lambda frame, keys: frame.select(*keys, F.inline(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(d).cast("double").alias("v")) for i, d in enumerate(dims)))))
    everywhere = long(rows, by).groupBy(*by, "dim", "v").agg(F.count("*").alias("all"))
    here = long(inside, [*by, "g"]).groupBy(*by, "g", "dim", "v").agg(F.count("*").alias("own"))
    gone = here.join(everywhere, [*by, "dim", "v"]).groupBy(*by, "g", "dim").agg(F.count_if(F.col("own") == F.col("all")).alias("gone"), F.sum("own").alias("n"))
    whole = everywhere.groupBy(*by, "dim").agg(F.count("v").alias("distinct"), F.sum("all").alias("many"))
    left = gone.join(whole, [*by, "dim"]).select("g", "dim", (F.col("distinct") - F.col("gone") >= tolerance * (F.col("many") - F.col("n"))).alias("use"))
    return left.groupBy("g").agg(*(F.max(F.when(F.col("dim") == i, F.col("use"))).alias(f"use_{d}") for i, d in enumerate(dims)))


def scaling(rows: DataFrame, cores: DataFrame, by: list[str], dims: list[str], only_peaks: bool) -> DataFrame:
    """``g, use_<d>, keep_<d>``: a dimension is scaled by 1 less the core's L-ratio in it, and used where that is positive and it is usable in the core and (unless ``only_peaks``) outside it."""
    use = geometry.usable(cores, ["g"], dims)
    outside = complement(rows, cores, by, dims).withColumnRenamed("n", "rest")
    tail = lambda d: geometry.chi2_tail((F.col(d) - F.col(f"mu_{d}")) * (F.col(d) - F.col(f"mu_{d}")) / F.nullif(F.col(f"c_{d}_{d}"), F.lit(0.0)), 1)
    rates = cores.select("g", *dims).join(outside, "g").groupBy("g").agg(*(F.when(F.max("rest") == 0, 1.0).otherwise(1 - F.avg(tail(d))).alias(f"keep_{d}") for d in dims))
    out = use.join(rates, "g")
    if not only_peaks:
        beyond = usable_outside(rows, cores, by, dims)
        out = out.join(beyond.select("g", *(F.col(f"use_{d}").alias(f"out_{d}") for d in dims)), "g")
    used = {f"use_{d}": F.col(f"use_{d}") & F.coalesce(F.col(f"keep_{d}") > 0, F.lit(False)) & (F.lit(True) if only_peaks else F.col(f"out_{d}")) for d in dims}
    return out.withColumns(used).select("g", *used, *(f"keep_{d}" for d in dims))


def fitted(inside: DataFrame, masks: DataFrame, dims: list[str]) -> DataFrame:
    """``masks`` with the factored moments of each cluster's scaled dimensions, its size ``n`` and the number ``degrees`` of dimensions in use."""
    table = moments(inside, ["g"], dims).join(masks, "g").withColumn("degrees", geometry.total([F.col(f"use_{d}").cast("int") for d in dims]))
    return geometry.factored(table, dims, geometry.chosen(lambda a, b: F.col(f"keep_{a}") * F.col(f"keep_{b}") * F.col(f"c_{a}_{b}"), lambda d: F.col(f"use_{d}")))


def distance(dims: list[str]) -> Column:
    return geometry.quadratic([F.when(F.col(f"use_{d}"), F.col(f"keep_{d}") * (F.col(d) - F.col(f"mu_{d}"))).otherwise(0.0) for d in dims])


def plain(masks: DataFrame, dims: list[str]) -> DataFrame:
    return masks.select("g", *(f"use_{d}" for d in dims), *(F.lit(1.0).alias(f"keep_{d}") for d in dims))


def extracted(inside: DataFrame, item: str, dims: list[str]) -> DataFrame:
    """The rows of each cluster's core: its nearest ones to its own distribution over its usable dimensions."""
    fit = fitted(inside, plain(geometry.usable(inside, ["g"], dims), dims), dims)
    far = inside.join(small(fit.select("g", *(c for c in fit.columns if c[:2] in ("mu", "us", "ke", "d_", "l_")))), "g").withColumn("_d", distance(dims)).select(*inside.columns, "_d")
    return grading.core_rows(far, "g", "_d", item).drop("_d")


def expanded(rows: DataFrame, cores: DataFrame, masks: DataFrame, by: list[str], item: str, dims: list[str], stages: Stages, clean: bool = True, n_std: float = CORE_STD, bins_per_unit: float = 0.25) -> DataFrame:
    """``g, item``: the recording's rows around each core up to the first valley of the smoothed counts of their distances to it.

    Distances up to ``chi2(.99) * 15`` (20 unless ``clean``) are counted in bins of equal width.  Without a valley a clean expansion is empty, another
    reaches to the last bin.  A clean one keeps rows within median + ``n_std`` deviations of their own distribution, or is the core where there are too few for one.
    """
    tails = F.array(F.lit(0.0), *(F.lit(shapes.chi2_limit(0.99, d) * (15.0 if clean else 20.0)) for d in range(1, len(dims) + 1)))
    fit = fitted(cores, masks, dims).where((F.col("n") >= F.col("degrees")) & (F.col("degrees") > 0))
    fit = fit.withColumn("reach", F.get(tails, F.col("degrees"))).withColumn("bins", F.round(F.col("reach") * bins_per_unit).cast("int"))
    fit = stages(fit.join(cores.select(*by, "g").distinct(), "g"), "fits")
    near = rows.select(*by, item, *dims).join(small(fit.drop("n")), by).withColumn("_m", distance(dims)).where(F.col("_m") < F.col("reach"))
    near = stages(near.select("g", item, *dims, "_m", "bins"), "near")
    ends = near.groupBy("g").agg(F.min("_m").alias("lo"), F.max("_m").alias("hi"), F.first("bins").alias("many")).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / F.col("many")
    counts = near.join(ends, "g").withColumn("bin", F.least(F.col("many") - 1, F.floor((F.col("_m") - F.col("lo")) / width)).cast("int")).groupBy("g", "bin").agg(F.count("*").alias("n"))
    smooth = shapes.smoothed(counts, "g", "bin", "n").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("bin", "smooth"))).alias("s"))
    valley = smooth.select("g", F.transform("s", lambda x: x["smooth"]).alias("f")).select("g", (shapes.first_valley("f", float("inf"), only_left=True)["valley"] - 1).alias("valley"))
    at = F.when(F.col("valley") >= 0, F.col("valley")).otherwise(F.lit(None) if clean else F.col("many") - 1)
    threshold = small(stages(ends.join(valley, "g").select("g", (F.col("lo") + (at + 0.5) * width).alias("threshold")).where("threshold is not null"), "thresholds"))
    inside = stages(near.join(threshold, "g").where(F.col("_m") < F.col("threshold")).select("g", item, *dims), "inside")
    if not clean:
        return inside.select("g", item)
    own = stages(fitted(inside, masks, dims), "own")
    few = own.where(F.col("n") < F.col("degrees")).select("g")
    far = stages(inside.join(small(own.where(F.col("n") >= F.col("degrees")).drop("n")), "g").withColumn("_d", distance(dims)).select("g", item, "_d"), "far")
    kept = far.join(small(selection.limits(far, ["g"], "_d", n_std)), "g").where(F.col("_d") < F.col("limit")).select("g", item)
    return kept.union(cores.select("g", item).join(few, "g", "left_semi"))


def bad_clusters(inside: DataFrame, peaks: list[str]) -> DataFrame:
    """``g, bad``: whether a peak, or a principal component of the peaks but the last, has more than one mode in the cluster."""
    axes = P.components(P.scatter(inside.select("g", F.array(*peaks).alias("peaks")), ["g"], "peaks", by_row=False), ["g"], max(1, len(peaks) - 1), centred=True)
    held = inside.select("g", F.array(*peaks).alias("peaks")).join(small(axes), "g")
    away = F.zip_with("peaks", "mean", lambda x, m: x - m)
    scores = F.transform("axes", lambda a: P.projected(away, a)) if len(peaks) > 1 else F.array().cast("array<double>")
    long = held.select("g", F.posexplode(F.concat("peaks", scores)).alias("dim", "v"))
    return shapes.overlap_test(long, ["g", "dim"], "v").groupBy("g").agg(F.max(F.coalesce("passed", F.lit(False))).alias("bad"))


def refined(rows: DataFrame, members: DataFrame, by: list[str], key: str, item: str, features: list[str], peaks: list[str], stages: Stages, still_bad: Callable[[DataFrame, list[str]], DataFrame] = bad_clusters) -> DataFrame:
    """``by, key, item, branch``: the members of each cluster after refinement among ``rows`` (``by, item``, features and peaks of the recordings).

    A cluster's core is expanded in the features.  Where the outcome is well apart in the peaks (L-ratio under ``GOOD_RATING``; ``branch`` ``peaks``), the core of its core is expanded in
    the peaks in its place, and if that has several modes the first outcome stays (``backup``).  Others keep the first (``features``).

    Clusters go with all members where no peak is usable, or an expansion finds nothing.  An item may be in several clusters.
    """
    rows = stages(rows.select(*by, item, *dict.fromkeys([*features, *peaks])), "rows")
    joined = lambda found, names: names.join(found, "g").join(rows, [*by, item])
    data = stages(members.select(*by, key, item, group(by, key).alias("g")).join(rows, [*by, item]), "members")
    use = geometry.usable(data, ["g"], peaks)
    names = stages(data.select(*by, key, "g").distinct().join(use.where(" or ".join(f"use_{p}" for p in peaks)).select("g"), "g"), "names")
    data = data.join(small(names.select("g")), "g")
    core = stages(extracted(data.drop(key), item, features), "core")
    first = expanded(rows, core, stages(scaling(rows, core, by, features, False), "scales"), by, item, features, stages)
    first = stages(joined(first, names).drop(key), "first")
    outside = complement(rows, first, by, peaks)
    degrees = len(peaks)
    rating = geometry.lratio(first.select("g", *peaks), outside.where(F.col("n") >= degrees), ["g"], peaks)
    rating = outside.select("g", "n").join(rating, "g", "left").select("g", F.when(F.col("n") == 0, 0.0).otherwise(F.coalesce("lratio", F.lit(float("inf")))).alias("rating"))
    good = small(stages(rating.where(F.col("rating") < GOOD_RATING).select("g"), "good"))
    inner = extracted(stages(extracted(first.join(good, "g", "left_semi"), item, features), "half"), item, features)
    inner = stages(inner, "inner")
    second = expanded(rows, inner, stages(scaling(rows, inner, by, peaks, True), "scales"), by, item, peaks, stages, n_std=PEAK_STD)
    second = stages(joined(second, names).drop(key), "second")
    verdict = small(stages(second.select("g").distinct().join(still_bad(second, peaks), "g", "left").select("g", F.coalesce("bad", F.lit(False)).alias("bad")), "verdicts"))
    labelled = lambda frame, branch: frame.select("g", item, F.lit(branch).alias("branch"))
    out = labelled(first.join(good, "g", "left_anti"), "features")
    out = out.union(labelled(second.join(verdict.where("not bad"), "g", "left_semi"), "peaks")).union(labelled(first.join(verdict.where("bad"), "g", "left_semi"), "backup"))
    return stages(names.join(out, "g").select(*by, key, item, "branch"), "refined")


def finalized(rows: DataFrame, members: DataFrame, by: list[str], key: str, item: str, peaks: list[str], stages: Stages, least: int = 25) -> DataFrame:
    """``by, key, item``: clusters of ``least`` rows or more, with all rows of the recording within median + 1 deviation of the cluster's distances to its own distribution."""
    data = members.select(*by, key, item, group(by, key).alias("g")).join(rows.select(*by, item, *peaks), [*by, item])
    sizes = data.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    data = stages(data.join(small(sizes.select("g")), "g"), "members")
    table = moments(data, ["g"], peaks, sample=False).join(plain(geometry.usable(data, ["g"], peaks), peaks), "g")
    fit = geometry.factored(table, peaks, geometry.chosen(lambda a, b: F.col(f"c_{a}_{b}"), lambda d: F.col(f"use_{d}")))
    names = data.select(*by, key, "g").distinct()
    fit = stages(names.join(fit, "g"), "fits")
    far = stages(data.select("g", *peaks).join(small(fit.drop(*by, key)), "g").select("g", distance(peaks).alias("_d")), "far")
    reach = stages(fit.join(selection.limits(far, ["g"], "_d", 1.0), "g"), "reach")
    near = rows.select(*by, item, *peaks).join(small(reach), by).where(distance(peaks) < F.col("limit")).select(*by, key, item)
    return stages(data.select(*by, key, item).union(near).distinct(), "finalized")
