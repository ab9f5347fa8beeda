"""Waveforms, event trains and peak matrices as DataFrames over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIRE_SAMPLES = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-wire snippets: ``spike_id, ts_us, cluster_id, w1, w2`` (32 samples a wire)."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("spike_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    wire = lambda start: F.transform(F.slice("embedding", start, WIRE_SAMPLES), lambda x: x.cast("double") * 1000)
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("spike_id"), F.col("label").alias("cluster_id"), wire(1).alias("w1"), wire(WIRE_SAMPLES + 1).alias("w2"))
        .join(events, "spike_id")
    )


def wires(frame: DataFrame) -> DataFrame:
    """One row a spike and wire: ``spike_id, ts_us, cluster_id, wire, wf``."""
    both = F.array(*(F.struct(F.lit(i).alias("wire"), F.col(f"w{i}").alias("wf")) for i in (1, 2)))
    return frame.select("spike_id", "ts_us", "cluster_id", F.inline(both))


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event trains: ``event_id, unit, wire, ts_us, amplitude``."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("unit"), F.col("event_type").alias("wire"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("value").alias("amplitude"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four peaks an item: ``tetrode, cluster_id, item, p1..p4``."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("tetrode"),
        F.concat("l_returnflag", "l_linestatus").alias("cluster_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item"),
        F.col("l_quantity").alias("p1"),
        (F.col("l_extendedprice") / 1000).alias("p2"),
        (F.col("l_discount") * 100).alias("p3"),
        (F.col("l_tax") * 100).alias("p4"),
    )


def tetrode_map(spark: SparkSession, rows: int = 96, columns: int = 4) -> DataFrame:
    """2 x 2 blocks of neighbouring channels on a grid numbered down its columns: ``tetrode, pos, channel``."""
    r, c = F.floor(F.col("id") / (columns - 1)), F.col("id") % (columns - 1)
    corner = r + 1 + rows * c
    blocks = spark.range((rows - 1) * (columns - 1)).select((F.col("id") + 1).alias("tetrode"), F.posexplode(F.array(corner, corner + 1, corner + rows, corner + rows + 1)).alias("p", "channel"))
    return blocks.select("tetrode", (F.col("p") + 1).cast("long").alias("pos"), F.col("channel").cast("long").alias("channel"))
