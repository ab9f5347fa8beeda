"""Overlapping clusters are merged or parted, pair by pair in their order.

The outcome of a pair changes the pairs after it, so this is a fold; but a pair only reads and writes its own two clusters.
Clusters of one connected component of the overlap graph are ranked in their order, and the pairs whose ranks add up to the same number are
disjoint and depend on pairs of smaller sums only: one *wave* of joins and aggregations does all of them, in all recordings at once.  There are ``2 m - 3``
waves for the largest component of ``m`` clusters, whatever the number of rows, recordings or clusters elsewhere.

A wave reads an item once for each pair that it is in; what is small is a row a pair (counts, moments, rates, votes).
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import geometry
from .steps import Stages, small

#: What must be left of a dimension's variance beside the dimensions before it; less is the rounding of a singular distribution.
SINGULAR = 1e-10


def components(edges: DataFrame, by: list[str], stages: Stages) -> DataFrame:
    """``by, key, component`` of the clusters in ``edges`` (``by, a, b``): the smallest cluster that each one is linked to, by rounds over the table of clusters."""
    links = edges.select(*by, "a", "b").union(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    links = stages(links, "links")
    labels = stages(links.select(*by, F.col("a").alias("key")).distinct().withColumn("component", F.col("key")), "labels")
    while True:
        near = links.join(labels.withColumnRenamed("key", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("key")).agg(F.min("component").alias("near"))
        new = stages(labels.join(near, [*by, "key"]).select(*by, "key", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved")), "labels")
        if not new.where("moved").take(1):
            return new.drop("moved")
        labels = new.drop("moved")


def settled(members: DataFrame, by: list[str], key: str, item: str, dims: list[str], merge_share: float = 0.65) -> DataFrame:
    """``members`` (``by, key, item`` and ``dims``, a row a membership) after all pairs of clusters of a recording have been settled, in their order.

    For each pair with common items, both clusters are described by their other items, in the dimensions that are usable in both;
    a dimension of a cluster shrinks by the L-ratio of the common items in it alone.  A common item is nearer to the cluster of smaller
    Mahalanobis distance.  If the common items are more than ``merge_share`` of the smaller cluster, both become one cluster: the first if more of
    the common items are nearer to it than to the second, else the second.  Otherwise an item stays in the nearer cluster, and in none if neither is nearer.

    Cases: with fewer other items than dimensions, or a singular distribution, neither is nearer; clusters that have become empty meet no other; repeated memberships count once;
    rows with a null item or cluster are left out; an empty table stays empty.
    """
    stages = Stages(members.sparkSession)
    members = stages(members.select(*by, key, item, *dims).where(F.col(key).isNotNull() & F.col(item).isNotNull()).dropDuplicates([*by, key, item]), "members")
    pairs = members.select(*by, F.col(key).alias("a"), item).join(members.select(*by, F.col(key).alias("b"), item), [*by, item]).where("a < b")
    edges = stages(pairs.select(*by, "a", "b").distinct(), "edges")
    if not edges.take(1):
        return members
    found = components(edges, by, stages).withColumnRenamed("key", key)
    of = Window.partitionBy(*by, "component")
    ranked = stages(found.withColumns({"rank": F.row_number().over(of.orderBy(key)) - 1, "many": F.count("*").over(of).cast("int")}), "ranks")
    alone = members.join(ranked, [*by, key], "left_anti")
    open_ = stages(members.join(small(ranked), [*by, key]), "open")
    most = ranked.agg(F.max("many")).first()[0]
    for wave in range(1, 2 * most - 2):
        open_ = _wave(open_, wave, ranked, by, key, item, dims, merge_share, stages)
    out = stages(alone.select(*by, key, item, *dims).union(open_.select(*by, key, item, *dims)), "settled")
    stages.drop(keep=1)
    return out


def _wave(rows: DataFrame, wave: int, ranked: DataFrame, by: list[str], key: str, item: str, dims: list[str], merge_share: float, stages: Stages) -> DataFrame:
    """Settles the pairs of ranks that add up to ``wave``; the other rows pass."""
    other = F.lit(wave) - F.col("rank")
    paired = (other >= 0) & (other < F.col("many")) & (other != F.col("rank"))
    pair, side = [*by, "component", "low"], F.col("rank") < other
    active = rows.where(paired).withColumns({"low": F.least(F.col("rank"), other), "first": side})
    held = active.groupBy(*pair, item).agg(F.max("first").alias("in_a"), F.max(~F.col("first")).alias("in_b"), *(F.first(d).alias(d) for d in dims), F.max("many").alias("many"))
    held = stages(held.withColumn("both", F.col("in_a") & F.col("in_b")), "pairs")
    only = {"a": F.col("in_a") & ~F.col("both"), "b": F.col("in_b") & ~F.col("both")}
    part = lambda s, d: F.when(only[s], F.col(d))
    counts = [F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.count_if("both").alias("n_both"), *(F.count_if(only[s]).alias(f"own_{s}") for s in "ab")]
    sums = [F.avg(part(s, d)).alias(f"{s}mu_{d}") for s in "ab" for d in dims]
    sums += [F.covar_samp(part(s, d), part(s, e)).alias(f"{s}c_{d}_{e}") for s in "ab" for d, e in combinations_with_replacement(dims, 2)]
    stats = held.groupBy(*pair).agg(*counts, *sums).where("n_both > 0")
    for s in "ab":
        use = geometry.usable(held.where(only[s]), pair, dims)
        stats = stats.join(use.select(*pair, *(F.col(f"use_{d}").alias(f"{s}use_{d}") for d in dims)), pair, "left")
    # a cluster without other items is usable everywhere; its distance is undefined all the same
    stats = stats.withColumns({f"use_{d}": F.coalesce(F.col(f"ause_{d}"), F.lit(True)) & F.coalesce(F.col(f"buse_{d}"), F.lit(True)) for d in dims})
    stats = small(stages(stats, "stats"))
    if not stats.take(1):
        return rows
    common = held.where("both").join(stats, pair)
    tail = lambda s, d: geometry.chi2_tail((F.col(d) - F.col(f"{s}mu_{d}")) * (F.col(d) - F.col(f"{s}mu_{d}")) / F.nullif(F.col(f"{s}c_{d}_{d}"), F.lit(0.0)), 1)
    rates = common.groupBy(*pair).agg(*((1 - F.avg(tail(s, d))).alias(f"{s}keep_{d}") for s in "ab" for d in dims))
    fit = stats.join(rates, pair)
    for s in "ab":
        fit = geometry.factored(fit, dims, _scaled(s), f"{s}f_")
        fit = fit.withColumns({f"{s}f_d_{j}": F.when(F.col(f"{s}f_d_{j}") > SINGULAR * _scaled(s)(d, d), F.col(f"{s}f_d_{j}")) for j, d in enumerate(dims)})
    fit = small(stages(fit, "fits"))
    degrees = geometry.total([F.col(f"use_{d}").cast("int") for d in dims])
    enough = (F.col("own_a") >= degrees) & (F.col("own_b") >= degrees)
    apart = {s: F.when(enough, geometry.quadratic([F.when(F.col(f"use_{d}"), F.col(d) - F.col(f"{s}keep_{d}") * F.col(f"{s}mu_{d}")).otherwise(0.0) for d in dims], f"{s}f_")) for s in "ab"}
    near = held.where("both").join(fit, pair).select(*pair, item, F.coalesce(apart["a"] < apart["b"], F.lit(False)).alias("near_a"), F.coalesce(apart["b"] < apart["a"], F.lit(False)).alias("near_b"))
    near = stages(near, "near")
    votes = near.groupBy(*pair).agg(F.count_if("near_a").alias("votes_a"), F.count_if("near_b").alias("votes_b"))
    merge = F.col("n_both") > merge_share * F.least("n_a", "n_b")
    verdicts = small(stages(fit.join(votes, pair).select(*pair, F.when(merge, F.when(F.col("votes_a") > F.col("votes_b"), "a").otherwise("b")).otherwise("part").alias("verdict")), "verdicts"))
    judged = active.join(verdicts, pair, "left").join(near, [*pair, item], "left")
    low_wins, high_wins = F.col("verdict") == "a", F.col("verdict") == "b"
    parted = (F.col("verdict") == "part") & F.col("near_a").isNotNull()  # a common item of two clusters that stay apart
    stays = F.when(parted, (F.col("first") & F.col("near_a")) | (~F.col("first") & F.col("near_b"))).otherwise(True)
    # in a merger all items take the winner's number; a common one has a row of each cluster, of which the winner's stays
    loses = (low_wins & ~F.col("first")) | (high_wins & F.col("first"))
    kept = judged.where(F.coalesce(stays, F.lit(True)) & ~(F.coalesce(loses, F.lit(False)) & F.col("near_a").isNotNull()))
    winners = small(ranked.select(*by, "component", "rank", F.col(key).alias("winner")))
    moved = kept.where(loses).withColumn("rank", other).drop(key).join(winners, [*by, "component", "rank"]).withColumn(key, F.col("winner"))
    same = kept.where(~F.coalesce(loses, F.lit(False)))
    columns = [*by, "component", "rank", "many", key, item, *dims]
    return stages(rows.where(~paired).select(*columns).union(same.select(*columns)).union(moved.select(*columns)), "settled")


def _scaled(s: str):
    """Covariances of the scaled dimensions in use."""
    return geometry.chosen(lambda a, b: F.col(f"{s}keep_{a}") * F.col(f"{s}keep_{b}") * F.col(f"{s}c_{a}_{b}"), lambda d: F.col(f"use_{d}"))
