"""Sorting spikes into clusters: expansion and refinement of cores.

Every step is an aggregation or an equi-join with a table of clusters; cluster tables, centres and thresholds are
all that is small.  Steps that are read several times are written, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry, selection, shapes
from .moments import moments
from .steps import Stages


def expanded(rows: DataFrame, cores: DataFrame, key: str, item: str, dims: list[str], clean: bool = True, n_std: float = 1.0, scale: float = 15.0, bins_per_unit: float = 0.25, by: list[str] | None = None) -> DataFrame:
    """``by, key, item``: the rows around each core up to the first valley of the smoothed counts of their distances to it.

    Distances are to the core's distribution, up to ``chi2(.99) * scale``, in bins of equal width.  Without a valley a
    clean expansion is empty, another takes the last bin.  A clean one keeps rows within median + ``n_std``
    deviations of their own distribution.  Rows meet the cores of their recording (``by``; one recording where it is left out), a row a cluster;
    ``key`` tells the clusters of all recordings apart.
    """
    stages = Stages(rows.sparkSession)
    of = by or []
    limit = shapes.chi2_limit(0.99, len(dims)) * scale
    bins = int(limit * bins_per_unit + 0.5)
    fit = geometry.factored(moments(cores, [*of, key], dims), dims).where(F.col("n") > len(dims))
    met = rows.select(*of, item, *dims).join(fit, of) if of else rows.select(item, *dims).crossJoin(fit)
    near = stages(met.withColumn("m", geometry.mahalanobis(dims)).where(F.col("m") < limit).select(*of, key, item, *dims, "m"), "near")
    ends = near.groupBy(key).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = near.join(ends, key).where("hi > lo").withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("m") - F.col("lo")) / width)).cast("int"))
    # both ends count, so that the average shrinks at the ends of the histogram
    counts = binned.groupBy(key, "bin").agg(F.count("*").alias("n"))
    smooth = shapes.smoothed(counts, key, "bin", "n").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", "smooth"))).alias("s"))
    valley = smooth.select(key, F.transform("s", lambda x: x["smooth"]).alias("f")).select(key, (shapes.first_valley("f", float("inf"), only_left=True)["valley"] - 1).alias("valley"))
    at = F.when(F.col("valley") >= 0, F.col("valley")).otherwise(F.lit(None) if clean else F.lit(bins - 1))
    threshold = ends.where("hi > lo").join(valley, key).select(key, (F.col("lo") + (at + 0.5) * width).alias("threshold"))
    inside = near.join(threshold, key).where(F.col("m") < F.col("threshold")).select(*of, key, item, *dims)
    if not clean:
        return inside.select(*of, key, item)
    own = inside.join(geometry.factored(moments(inside, [key], dims), dims).where(F.col("n") > len(dims)), key).withColumn("d", geometry.mahalanobis(dims)).select(*of, key, item, "d")
    limits = selection.limits(own, [key], "d", n_std)
    return own.join(limits, key).where(F.col("d") < F.col("limit")).select(*of, key, item)


def bad_clusters(rows: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """``key, bad``: clusters of which some dimension has more than one mode."""
    long = rows.select(key, F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("v")) for d in dims))))
    return shapes.overlap_test(long, [key, "dim"], "v").groupBy(key).agg(F.max("passed").alias("bad"))


def cleaned(rows: DataFrame, key: str, item: str, dims: list[str], rounds: int = 2, n_std: float = 2.0) -> DataFrame:
    """``rows`` after rounds that keep those within median + ``n_std`` deviations of their cluster's distances."""
    for _ in range(rounds):
        far = rows.join(geometry.factored(moments(rows, [key], dims), dims).select(key, *(f"mu_{d}" for d in dims), *(f"d_{i}" for i in range(len(dims))), *(f"l_{i}_{j}" for i in range(len(dims)) for j in range(i))), key).withColumn("distance", geometry.mahalanobis(dims)).select(*rows.columns, "distance")
        limits = selection.limits(far, [key], "distance", n_std)
        rows = far.join(limits, key).where(F.col("distance") < F.col("limit")).select(*rows.columns)
    return rows
