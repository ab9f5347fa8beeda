"""Clustering in passes: each pass clusters the rows that the clusters found so far leave over, and once more without the bad ones of the pass before.

A pass runs the recursion, the refinement, the test for several modes and the final fill for all recordings at once, and its outcome is written; the loop
is as long as the schedule of passes, whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cores, geometry, overlaps, refinement
from . import features as P
from .steps import Stages, small


@dataclass
class Recording:
    """What the passes need to know of the rows: ``rows`` has ``by, item``, the features of the refinement and the peaks."""

    rows: DataFrame
    by: list[str]
    item: str
    features: list[str]
    peaks: list[str]
    loop_features: Callable[[DataFrame, str], DataFrame]
    n_loop: int
    least: int = 50
    merge_share: float = 0.65


def schedule(passes: DataFrame, peaks: DataFrame, by: list[str], item: str, dims: list[str]) -> DataFrame:
    """``by, item, pass``: the rows of ``passes`` (``by, item, pass``) in dense cells, but all of a recording's last pass, unless that is its only one."""
    ends = passes.groupBy(*by).agg(F.max("pass").alias("last"), F.countDistinct("pass").alias("many"))
    held = passes.join(ends, by)
    whole = held.where((F.col("pass") == F.col("last")) & (F.col("many") > 1)).select(*by, item, "pass")
    thin = held.where((F.col("pass") < F.col("last")) | (F.col("many") == 1)).join(peaks.select(*by, item, *dims), [*by, item])
    return whole.union(geometry.density(thin.select(*by, item, "pass", *dims), dims, by=[*by, "pass"]).select(*by, item, "pass"))


def outside_boxes(candidates: DataFrame, rows: DataFrame, members: DataFrame, by: list[str], key: str, item: str, peaks: list[str], stages: Stages, n_std: float = 3.0) -> DataFrame:
    """``candidates`` (``by, item``) that are in no cluster and in no cluster's box.

    A box holds, in every peak and in the projections on the first two principal components of the cluster's peaks, the values strictly between mean -+ ``n_std``
    deviations and the cluster's own ends, whichever are closer.  Rows meet the boxes of their recording.
    """
    values = rows.select(*by, item, F.array(*peaks).alias("peaks"))
    inside = stages(members.select(*by, key, item).join(values, [*by, item]).withColumn("g", refinement.group(by, key)), "members")
    axes = P.components(P.scatter(inside.select("g", "peaks"), ["g"], "peaks", by_row=False), ["g"], min(2, len(peaks)), centred=True).select("g", "axes")
    axes = stages(axes, "axes")
    data = lambda frame: F.concat("peaks", F.transform("axes", lambda a: P.projected(F.col("peaks"), a)))
    long = inside.join(small(axes), "g").select(*by, "g", F.posexplode(data(inside)).alias("dim", "v"))
    ends = long.groupBy(*by, "g", "dim").agg(F.min("v").alias("a"), F.max("v").alias("z"), F.avg("v").alias("m"), F.coalesce(F.stddev("v"), F.lit(0.0)).alias("s"))
    side = F.struct("dim", F.greatest(F.col("a"), F.col("m") - n_std * F.col("s")).alias("lo"), F.least(F.col("z"), F.col("m") + n_std * F.col("s")).alias("hi"))
    boxes = ends.groupBy(*by, "g").agg(F.array_sort(F.collect_list(side)).alias("box")).join(axes, "g").drop("g")
    near = candidates.join(values, [*by, item]).join(small(stages(boxes, "boxes")), by)
    fits = F.forall(F.zip_with(data(near), "box", lambda v, b: (b["lo"] < v) & (v < b["hi"])), lambda x: x)
    gone = near.where(fits).select(*by, item).union(members.select(*by, item)).distinct()
    return stages(candidates.join(gone, [*by, item], "left_anti"), "left")


def one_pass(rec: Recording, candidates: DataFrame, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """``by, cluster, item`` of the clusters found among ``candidates`` and expanded among all rows, and of the bad ones, which have several modes."""
    found = cores.core_loop(candidates, rec.by, rec.item, rec.loop_features, rec.n_loop, least=rec.least)
    better = refinement.refined(rec.rows, found, rec.by, "cluster", rec.item, rec.features, rec.peaks, stages).drop("branch")
    tagged = better.withColumn("g", refinement.group(rec.by, "cluster"))
    inside = tagged.join(rec.rows.select(*rec.by, rec.item, *rec.peaks), [*rec.by, rec.item])
    bad = small(stages(refinement.bad_clusters(inside, rec.peaks).where("bad").select("g"), "bad"))
    good = tagged.join(bad, "g", "left_anti").drop("g")
    return refinement.finalized(rec.rows, good, rec.by, "cluster", rec.item, rec.peaks, stages), tagged.join(bad, "g", "left_semi").drop("g")


def iterated(rec: Recording, passes: DataFrame, bad_round: bool = True) -> DataFrame:
    """``by, cluster, item, pass``: the clusters after all passes (``by, item, pass``), their overlaps settled, and the pass that found each of them.

    Clusters are numbered from 1 in the order in which they were found.
    """
    stages, by, item = Stages(rec.rows.sparkSession), rec.by, rec.item
    columns = [*by, "cluster", item, "pass"]
    passes = stages(passes.select(*by, item, "pass"), "passes")
    clusters = bad = None
    for now in sorted(r["pass"] for r in passes.select("pass").distinct().collect()):  # the schedule's few numbers
        candidates = passes.where(F.col("pass") == now).drop("pass")
        if clusters is not None:
            candidates = outside_boxes(candidates, rec.rows, clusters, by, "cluster", item, rec.peaks, stages)
        found, bad_now = one_pass(rec, candidates, stages)
        parts = [found.select(*by, F.lit(1).alias("source"), "cluster", item, F.lit(now).alias("pass"))]
        if bad_round and bad is not None and bad.take(1):
            left = outside_boxes(candidates.join(bad.select(*by).distinct(), by, "left_semi"), rec.rows, bad, by, "cluster", item, rec.peaks, stages)
            again, _ = one_pass(rec, left, stages)
            parts.append(again.select(*by, F.lit(2).alias("source"), "cluster", item, F.lit(now).alias("pass")))
        if clusters is not None:
            parts.append(clusters.select(*by, F.lit(0).alias("source"), "cluster", item, "pass"))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        whole = stages(whole, "found")
        order = whole.groupBy(*by, "source", "cluster").agg(F.first("pass").alias("pass")).withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("source", "cluster")))
        order = small(stages(order, "order"))
        numbers = whole.drop("pass").join(order, [*by, "source", "cluster"]).select(*by, F.col("number").alias("cluster"), item)
        settled = overlaps.settled(numbers.join(rec.rows.select(*by, item, *rec.peaks), [*by, item]), by, "cluster", item, rec.peaks, rec.merge_share)
        kept = settled.select(*by, "cluster").distinct().withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("cluster")))
        kept = kept.join(order.select(*by, F.col("number").alias("cluster"), "pass"), [*by, "cluster"])
        clusters = stages(settled.join(kept, [*by, "cluster"]).select(*by, F.col("number").alias("cluster"), item, "pass").select(*columns), "clusters")
        bad = stages(bad_now, "bad_clusters")
    return clusters if clusters is not None else passes.select(*by, F.lit(0).alias("cluster"), item, "pass").limit(0)
