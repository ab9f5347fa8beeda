"""Operators over event trains: intervals, rates, bursts and nearest-time matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selection


def intervals(train: DataFrame, unit: str = "unit", ts: str = "ts_us", key: str = "event_id") -> DataFrame:
    """``train`` with ``isi``: seconds since the unit's event before (null for its first); a unit may hold any share of the events."""
    near = selection.with_neighbours(train, [unit], [ts, key], before={"_before": ts})
    return near.withColumn("isi", (F.col(ts) - F.col("_before")) / 1e6).drop("_before")


def share(condition: Column, among: Column) -> Column:
    """Share of the rows that meet ``condition`` among those that meet ``among``; null without one."""
    return F.sum(F.when(condition, 1).otherwise(0)) / F.nullif(F.sum(F.when(among, 1).otherwise(0)), F.lit(0))


def train_report(train: DataFrame, short: float, burst: tuple[float, float]) -> DataFrame:
    """Per unit: counts, interval statistics, rate, share of the recording, stationarity.  Medians and intervals of units of any size."""
    whole = train.agg(F.avg("ts_us").alias("mean_ts"), F.stddev("ts_us").alias("std_ts"), F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    unit = intervals(train).groupBy("unit").agg(
        F.count("*").alias("n_spikes"),
        F.avg("isi").alias("isi_mean"),
        F.avg((F.col("isi") < short).cast("int")).alias("short_isi"),
        (F.sum((F.col("isi") < burst[0]).cast("int")) / F.nullif(F.sum((F.col("isi") < burst[1]).cast("int")), F.lit(0))).alias("burst_ratio"),
        F.stddev("ts_us").alias("unit_std"),
        F.min("ts_us").alias("first_ts"),
        F.max("ts_us").alias("last_ts"),
    )
    middle = selection.medians(train, ["unit"], "ts_us").withColumnRenamed("median", "median_ts")
    joined = unit.join(middle, "unit").crossJoin(F.broadcast(whole))  # one row
    return joined.select(
        "unit",
        "n_spikes",
        "isi_mean",
        "short_isi",
        "burst_ratio",
        (F.col("n_spikes") * 1e6 / F.nullif(F.col("last_ts") - F.col("first_ts"), F.lit(0))).alias("rate_hz"),
        (2 * F.col("unit_std") / (F.col("t1") - F.col("t0"))).alias("recording_share"),
        ((F.col("median_ts") < F.col("mean_ts") - F.col("std_ts")) | (F.col("median_ts") > F.col("mean_ts") + F.col("std_ts"))).alias("non_stationary"),
    )


def burst_flags(train: DataFrame, bin_us: int, n_std: float) -> DataFrame:
    """Events within one bin width of the start of a bin that holds more than mean + n_std standard deviations.

    Empty bins count in mean and deviation: they follow from the number of bins,
    so no row is made for them.  The last edge counts only events on it.  The
    flagged edges reach an event by its own bin's neighbours, an equi-join.
    """
    ends = train.agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    placed = train.crossJoin(F.broadcast(ends)).withColumn("bin", F.floor((F.col("ts_us") - F.col("t0")) / bin_us))
    last = F.floor((F.col("t1") - F.col("t0")) / bin_us)
    counted = placed.where((F.col("bin") < last) | (F.col("ts_us") == F.col("t0") + last * bin_us)).groupBy("bin").agg(F.count("*").alias("n"), F.first(last + 1).alias("bins"))
    total = counted.agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.max("bins").alias("b"))
    mean = F.col("s") / F.col("b")
    limits = total.select((mean + n_std * F.sqrt((F.col("q") - F.col("s") * mean) / (F.col("b") - 1))).alias("limit"))
    edges = counted.crossJoin(F.broadcast(limits)).where(F.col("n") > F.col("limit")).select(F.col("bin").alias("edge"))
    near = placed.withColumn("edge", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)))
    start = F.col("t0") + F.col("edge") * bin_us
    near = near.where(F.abs(F.col("ts_us") - start) <= bin_us)
    return train.join(near.join(edges, "edge").select("event_id").distinct(), "event_id", "left_semi")


def nearest(labels: DataFrame, events: DataFrame, tolerance_us: int, bin_us: int | None = None) -> DataFrame:
    """Nearest-time join: ``label_id, event_id, distance`` for each label with an event closer than the tolerance.

    Times are cut into bins of the tolerance; a label meets the events of its own
    bin and its two neighbours, so the join is an equi-join that shuffles evenly,
    however long the train is.  Ties go to the earlier event, then the smaller id.
    """
    width = bin_us or tolerance_us
    left = labels.withColumn("bin", F.explode(F.sequence(F.floor(F.col("ts_us") / width) - 1, F.floor(F.col("ts_us") / width) + 1)))
    right = events.select("event_id", F.col("ts_us").alias("event_ts"), F.floor(F.col("ts_us") / width).alias("bin"))
    pairs = left.join(right, "bin").withColumn("distance", F.abs(F.col("event_ts") - F.col("ts_us"))).where(F.col("distance") < tolerance_us)
    best = pairs.groupBy("label_id").agg(F.min(F.struct("distance", "event_ts", "event_id")).alias("best"))
    return best.select("label_id", "best.event_id", "best.distance")
