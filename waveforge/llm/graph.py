"""Connected components of a table of links, by joins only: no link, label or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b", jumps: int = 2) -> DataFrame:
    """``node, component`` for every node of a link; the component is its smallest node.

    Each round hooks a node to its smallest smaller neighbour, shortens the
    chains ``jumps`` times, and contracts the links; links inside a component
    vanish, so the table shrinks by a large factor each round (about log n
    rounds; a star takes one).  A node of very many links is split by Spark's
    adaptive skew handling in the joins and partially aggregated in the minimum.

    Cases: links with a null end and loops are ignored; repeated links count once;
    an empty table gives an empty result.
    """
    work = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    work = materialize(work, "links")
    nodes = work.select(F.col("x").alias("node")).union(work.select("y")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while not work.isEmpty():
        hook = work.groupBy("y").agg(F.min("x").alias("to")).withColumnRenamed("y", "from")
        for _ in range(jumps):
            hook = materialize(hook, "hooks")
            further = hook.select(F.col("from").alias("to"), F.col("to").alias("next"))
            hook = hook.join(further, "to", "left").select("from", F.coalesce("next", "to").alias("to"))
        hook = materialize(hook, "hooks")
        moved = work
        for end in ("x", "y"):
            to = hook.select(F.col("from").alias(end), F.col("to").alias("_to"))
            moved = moved.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        moved = moved.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        work = materialize(moved, "links")
        to = hook.select(F.col("from").alias("component"), F.col("to").alias("_to"))
        labels = materialize(labels.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "labels")
    return labels
