"""Order statistics and ordered neighbours of groups of any size.

Small groups go the direct way: Spark's own ``percentile`` and windows, one task a group.  Where some group has more than ``DIRECT`` rows, nothing
gathers it: the k-th value is found by narrowing histograms, and ranks come from one range partitioning of all rows.

*Narrowing*: a cell is a range of a group's values.  The open cells are cut into ``BINS`` bins of equal width; only counts and ends of the bins meet, and the bin
that holds the wanted rank becomes the next cell, of which the exact ends are known.  Rows outside the chosen bins are left behind, so the second pass
reads a thousandth of an even distribution.  A cell of equal values is done; one of at most ``GATHER`` values is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import Stages, dealt, small

DIRECT = 200_000
BINS = 1024
GATHER = 20_000
#: Rows of a group between two borders of :func:`with_previous`.
CHUNK = 100_000


def is_large(rows: DataFrame, keys: list[str]) -> bool:
    """Whether some group has more than ``DIRECT`` rows."""
    return bool(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > DIRECT).take(1))


def kth(rows: DataFrame, keys: list[str], value: str, ranks: DataFrame, stages: Stages) -> DataFrame:
    """``keys, which, value``: for each row ``keys, which, rank`` of ``ranks`` the value of that rank (from 0) among the group's finite values; none where the group has fewer."""
    v = F.col(value).cast("double")
    current = stages(rows.select(*keys, v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).withColumn("cell", F.lit("")), "values")
    whole = current.groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    targets = stages(ranks.join(whole, keys).where(F.col("rank") < F.col("n")).select(*keys, "which", F.col("rank").cast("long").alias("left"), "cell", "n", "lo", "hi"), "targets")
    open_ = (F.col("n") > GATHER) & (F.col("lo") < F.col("hi"))
    while targets.where(open_).take(1):
        cells = small(stages(targets.select(*keys, "cell", "lo", "hi", open_.alias("open")).distinct(), "cells"))
        held = current.join(cells, [*keys, "cell"])
        binned = held.where("open").withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).cast("int"))
        counts = binned.groupBy(*keys, "cell", "bin").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("c").over(Window.partitionBy(*keys, "cell").orderBy("bin")) - F.col("c")
        counts = stages(counts.withColumn("before", before), "counts")
        hit = targets.where(open_).drop("n", "lo", "hi").join(counts, [*keys, "cell"]).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("c")))
        narrowed = hit.select(*keys, "which", (F.col("left") - F.col("before")).alias("left"), F.concat_ws(".", "cell", "bin").alias("cell"), F.col("c").alias("n"), F.col("low").alias("lo"), F.col("high").alias("hi"))
        targets = stages(targets.where(~open_).union(narrowed), "targets")
        wanted = small(stages(targets.select(*keys, "cell").distinct(), "wanted"))
        moved = binned.withColumn("cell", F.concat_ws(".", "cell", "bin")).select(*keys, "v", "cell").union(held.where(~F.col("open")).select(*keys, "v", "cell"))
        current = stages(moved.join(wanted, [*keys, "cell"], "left_semi"), "values")
    rest = small(stages(targets.where("lo < hi").select(*keys, "cell").distinct(), "rest"))
    lists = current.join(rest, [*keys, "cell"], "left_semi").groupBy(*keys, "cell").agg(F.sort_array(F.collect_list("v")).alias("sorted"))
    found = targets.join(lists, [*keys, "cell"], "left")
    return found.select(*keys, "which", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.get("sorted", F.col("left").cast("int"))).alias("value"))


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, median`` of the finite values."""
    if not is_large(rows, keys):
        return rows.groupBy(*keys).agg(F.median(value).alias("median"))
    stages = Stages(rows.sparkSession)
    v = F.col(value).cast("double")
    sizes = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).groupBy(*keys).agg(F.count("*").alias("n"))
    middle = F.inline(F.array(*(F.struct(F.lit(i).alias("which"), F.floor((F.col("n") - 1 + i) / 2).alias("rank")) for i in (0, 1))))
    ranks = stages(sizes.select(*keys, middle), "ranks")
    out = stages(kth(rows, keys, value, ranks, stages).groupBy(*keys).agg(F.sum(F.col("value") * 0.5).alias("median")), "medians")
    stages.drop(keep=1)
    return out


def limits(rows: DataFrame, keys: list[str], value: str, n_std: float) -> DataFrame:
    """``keys, limit``: the median plus ``n_std`` sample deviations."""
    if not is_large(rows, keys):
        return rows.groupBy(*keys).agg((F.median(value) + n_std * F.stddev(value)).alias("limit"))
    spread = rows.groupBy(*keys).agg(F.stddev(value).alias("s"))
    return medians(rows, keys, value).join(spread, keys).select(*keys, (F.col("median") + n_std * F.col("s")).alias("limit"))


def lowest(rows: DataFrame, keys: list[str], value: str, tie: str, many: Column) -> DataFrame:
    """The ``many`` rows of each group with the lowest values, ties by the number in ``tie``; ``many`` is an expression over the group's size ``n``."""
    if not is_large(rows, keys):
        ranked = rows.withColumns({"_rank": F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie)), "n": F.count("*").over(Window.partitionBy(*keys))})
        return ranked.where(F.col("_rank") <= many).drop("_rank", "n")
    stages = Stages(rows.sparkSession)
    rows = stages(rows, "rows")
    wanted = stages(rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, many.cast("long").alias("many")).where("many > 0"), "wanted")
    ends = stages(kth(rows, keys, value, wanted.select(*keys, F.lit(0).alias("which"), (F.col("many") - 1).alias("rank")), stages).select(*keys, F.col("value").alias("end")), "ends")
    held = rows.join(small(ends), keys)
    under = held.where(F.col(value) < F.col("end")).groupBy(*keys).agg(F.count("*").alias("under"))
    still = wanted.join(under, keys, "left").select(*keys, F.lit(0).alias("which"), (F.col("many") - F.coalesce("under", F.lit(0)) - 1).alias("rank"))
    last = kth(held.where(F.col(value) == F.col("end")), keys, tie, still, stages).select(*keys, F.col("value").alias("last"))
    chosen = held.join(small(stages(last, "last")), keys)
    return chosen.where((F.col(value) < F.col("end")) | ((F.col(value) == F.col("end")) & (F.col(tie) <= F.col("last")))).drop("end", "last")


def numbered(rows: DataFrame, keys: list[str], order: list[str], stages: Stages, name: str = "place") -> DataFrame:
    """``rows`` with ``name``, the rank (from 0) within their group: positions after one range partitioning, and a prefix sum over a row a group and partition."""
    rows = stages(rows, "unordered")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = stages(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_many"))
    shift = F.sum("_many").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_many") - F.col("_low")
    shifts = small(stages(runs.select(*keys, "_part", shift.alias("_shift")), "shifts"))
    return placed.join(shifts, [*keys, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def with_neighbours(rows: DataFrame, keys: list[str], order: list[str], before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with new columns: the values of other columns in the group's row before (``before``) or after (``after``); null at its ends.

    Large groups are cut into runs of ``CHUNK`` rows, and the rows next to a border go to both sides of it.
    """
    before, after = before or {}, after or {}
    if not is_large(rows, keys):
        near = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumns({new: F.lag(old).over(near) for new, old in before.items()} | {new: F.lead(old).over(near) for new, old in after.items()})
    stages = Stages(rows.sparkSession)
    placed = numbered(rows, keys, order, stages, "_place").withColumn("_run", F.floor(F.col("_place") / CHUNK))
    sides = F.array(F.struct(F.col("_run").alias("_chunk"), F.lit(True).alias("_own")), *(F.struct(F.when(F.floor((F.col("_place") + d) / CHUNK) != F.col("_run"), F.col("_run") + d).alias("_chunk"), F.lit(False).alias("_own")) for d in (1, -1)))
    sent = placed.select(*rows.columns, "_place", F.inline(F.filter(sides, lambda x: x["_chunk"].isNotNull())))
    near = Window.partitionBy(*keys, "_chunk").orderBy("_place")
    out = sent.withColumns({new: F.lag(old).over(near) for new, old in before.items()} | {new: F.lead(old).over(near) for new, old in after.items()})
    return out.where("_own").drop("_place", "_chunk", "_own")


def sampled(rows: DataFrame, keys: list[str], item: str, most: int, seed: int = 0, salts: int = 64, many: int = 0) -> DataFrame:
    """Up to ``most`` rows of each group, without replacement: those of the smallest hashes of ``item`` (with the seed), so the same ones whatever the partitions.

    The smallest of parts of a group hold the smallest of the group: parts are cut first, by the hash itself, and no task gets more than ``salts * most`` rows of a group.  Of ``many`` rows in all a task sorts ``TASK_ROWS``.
    """
    lot = F.unhex(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string")), 256))  # bytes sort as their digits do
    marked = dealt(rows.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salts))), many, *keys, "_salt").withColumn("_lot", lot)
    part = marked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("_lot", item))).where(F.col("_rank") <= most)
    return part.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_lot", item))).where(F.col("_rank") <= most).drop("_lot", "_salt", "_rank")


def drawn(rows: DataFrame, keys: list[str], item: str, many: int, seed: int = 0) -> DataFrame:
    """``many`` rows of each group with replacement, with ``draw`` (from 0): draw j takes the row whose rank by ``item`` is a hash of group, seed and j, modulo the group's size."""
    stages = Stages(rows.sparkSession)
    placed = stages(numbered(rows, keys, [item], stages), "placed")
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    lot = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys), F.col("draw").cast("string")), 256), 1, 12), 16, 10).cast("long")
    return sizes.withColumn("place", lot % F.col("n")).join(placed, [*keys, "place"]).drop("place", "n")
