"""Spike records as tables: selection modes, file headers, scaling and the checks before a file is sorted.

A record has ``tetrode, idx, ts_us`` and the counts of its wires; ``idx`` is its 1-based place in
the file.  Selections prune columns and push predicates down to the scan; none of them sorts a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selection

ADMAX = 32767  # counts of a full-scale sample where the header names none
BITVOLTS = 6e-9  # volts a count where neither the header nor an input range gives them
MAX_RATE_HZ, MAX_SPIKES = 250.0, 400_000


def select_records(records: DataFrame, mode: str = "all", values: list[int] | None = None, fields: list[str] | None = None) -> DataFrame:
    """The records of a mode with ``ord``, their place in the result.

    ``all``; ``range``: places from the first to the second value; ``list``: the places in the order given,
    repeats kept, absent ones skipped; ``ts_range`` and ``ts_list``: the same by time, the list as a set.
    """
    fields = fields or records.columns
    if mode == "list":
        asked = records.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], "ord long, idx long")
        return records.join(asked, "idx").select("ord", *fields)
    if mode == "range":
        records = records.where(F.col("idx").between(*values))
    elif mode == "ts_range":
        records = records.where(F.col("ts_us").between(*values))
    elif mode == "ts_list":
        records = records.where(F.col("ts_us").isin(values))
    elif mode != "all":
        raise ValueError(f"{mode} is no selection mode")
    return records.select(F.col("idx").alias("ord"), *fields)


def parse_headers(lines: DataFrame) -> DataFrame:
    """``file, admax, bitvolts, input_range, threshold`` from the header ``lines`` (``file, line_no, line``).

    Values stand behind column 13 of a line, for the threshold behind column 12; lines after the
    threshold are not read.  Without input range, it is bitvolts x admax in microvolts.
    """
    stop = lines.where(F.col("line").contains("ThreshVal")).groupBy("file").agg(F.min("line_no").alias("stop"))
    read = lines.join(stop, "file", "left").where(F.col("stop").isNull() | (F.col("line_no") <= F.col("stop")))
    numbers = lambda start: F.transform(F.filter(F.split(F.substr("line", F.lit(start)), " +"), lambda x: x != ""), lambda x: x.cast("double"))
    value = lambda key, start: F.min_by(F.when(F.col("line").contains(key), numbers(start)), F.when(F.col("line").contains(key), F.col("line_no")))
    got = read.groupBy("file").agg(value("ADMaxValue", 13).alias("a"), value("ADBitVolts", 13).alias("b"), value("InputRange", 13).alias("r"), value("ThreshVal", 12).alias("threshold"))
    got = got.withColumn("admax", F.coalesce(F.get("a", F.lit(0)), F.lit(float(ADMAX))))
    derived = F.transform("r", lambda x: x / 1e6 / F.col("admax"))
    got = got.withColumn("bitvolts", F.coalesce("b", derived, F.array(F.lit(BITVOLTS))))
    return got.select("file", "admax", "bitvolts", F.coalesce("r", F.transform("bitvolts", lambda x: x * F.col("admax") * 1e6)).alias("input_range"), "threshold")


def microvolts(counts: Column, bitvolts: Column | float) -> Column:
    return F.transform(counts, lambda x: x * bitvolts * 1e6)


def within_limits(records: DataFrame, max_rate: float = MAX_RATE_HZ, max_spikes: int = MAX_SPIKES) -> DataFrame:
    """Records of files that are neither too dense nor too large; records at time 0 go."""
    records = records.where("ts_us <> 0")
    sizes = records.groupBy("tetrode").agg(F.count("*").alias("n"), (F.max("ts_us") - F.min("ts_us")).alias("span"))
    fine = sizes.where((F.col("n") <= max_spikes) & (F.coalesce(F.col("n") * 1e6 / F.nullif(F.col("span"), F.lit(0)), F.lit(0.0)) <= max_rate)).select("tetrode")
    return records.join(fine, "tetrode", "left_semi")


def unsaturated(records: DataFrame, wires: list[str], admax: int = ADMAX, least: int = 100) -> DataFrame:
    """Records with a live wire under full scale at both ends; files with fewer than ``least`` of them go.

    A wire is live in a file if more than half of its records have a sample other than zero there.
    """
    live = records.groupBy("tetrode").agg(*((F.avg(F.exists(w, lambda x: x != 0).cast("int")) > 0.5).alias(f"live_{w}") for w in wires))
    rows = records.join(live, "tetrode")
    top = F.array_min(F.filter(F.array(*(F.when(F.col(f"live_{w}"), F.array_max(w)) for w in wires)), lambda x: x.isNotNull()))
    low = F.array_max(F.filter(F.array(*(F.when(F.col(f"live_{w}"), F.array_min(w)) for w in wires)), lambda x: x.isNotNull()))
    good = rows.where((top < admax) & (low > -admax)).select(*records.columns)
    enough = good.groupBy("tetrode").agg(F.count("*").alias("good")).where(F.col("good") >= least).select("tetrode")
    return good.join(enough, "tetrode", "left_semi")


def to_counts(rows: DataFrame, wires: list[str], per_wire: bool = False) -> DataFrame:
    """``rows`` with the wires as counts of 16 bits.

    One scale for all wires, the lesser of max / 32768 and -min / 32769, or one for each wire, 1.05 times the greater.
    """
    ends = rows.agg(*(F.max(F.array_max(w)).alias(f"hi_{w}") for w in wires), *(F.min(F.array_min(w)).alias(f"lo_{w}") for w in wires))
    if per_wire:
        scale = {w: 1.05 * F.greatest(F.col(f"hi_{w}") / 32768, -F.col(f"lo_{w}") / 32769) for w in wires}
    else:
        one = F.least(F.greatest(*(F.col(f"hi_{w}") for w in wires)) / 32768, -F.least(*(F.col(f"lo_{w}") for w in wires)) / 32769) if len(wires) > 1 else F.least(F.col(f"hi_{wires[0]}") / 32768, -F.col(f"lo_{wires[0]}") / 32769)
        scale = dict.fromkeys(wires, one)
    scaled = rows.crossJoin(ends.select(*(v.alias(f"scale_{w}") for w, v in scale.items())))  # one row
    counted = lambda w: F.transform(w, lambda x: F.round(x / F.col(f"scale_{w}")).cast("int"))
    return scaled.withColumns({w: counted(w) for w in wires}).drop(*(f"scale_{w}" for w in wires))


def label_columns(matrix: DataFrame, columns: list[str], position: str) -> DataFrame:
    """``column, role`` of a label matrix whose column order isn't known.

    All values must be 0 or more.  Cluster numbers are constant or have neighbouring values 1 apart (of several
    such columns the one of the largest maximum); the times are the first other column that never falls.
    Neighbouring values meet by an equi-join and neighbouring rows by range, whether or not positions have gaps; a column may be of any length.
    """
    long = matrix.select(position, F.inline(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))))
    key = ["at", "column"]
    stats = long.groupBy(*key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max((F.col("v") != F.floor("v")).cast("int")).alias("broken"))
    values = long.select(*key, "v").distinct()
    steps = values.join(values.select(*key, (F.col("v") - 1).alias("v")), [*key, "v"], "left_semi").groupBy(*key).agg(F.lit(True).alias("one_apart"))
    falls = selection.with_neighbours(long, key, [position], before={"_before": "v"}).where(F.col("_before") > F.col("v")).select(*key).distinct().withColumn("falls", F.lit(True))
    all_ = stats.join(steps, key, "left").join(falls, key, "left").where("lo >= 0")
    number = (F.col("lo") == F.col("hi")) | ((F.col("broken") == 0) & F.coalesce("one_apart", F.lit(False)))
    cluster = all_.where(number).agg(F.max_by("at", F.struct("hi", (-F.col("at")).alias("first"))).alias("cluster"))
    all_ = all_.crossJoin(cluster)  # one row
    time = all_.where(F.col("falls").isNull() & (F.col("cluster").isNull() | (F.col("at") != F.col("cluster")))).agg(F.min("at").alias("time"))
    return all_.crossJoin(time).select("column", F.when(F.col("at") == F.col("cluster"), "cluster").when(F.col("at") == F.col("time"), "time").alias("role"))


def file_labels(lines: DataFrame, times: DataFrame) -> DataFrame:
    """``file, ts_us, cluster_id`` from lines of cluster numbers (``file, line_no, line``; line 0 is a count) and the files' record times (``file, pos, ts_us``)."""
    numbers = lines.where("line_no > 0").select("file", (F.col("line_no") - 1).alias("pos"), F.trim("line").cast("int").alias("cluster_id"))
    return times.join(numbers, ["file", "pos"]).select("file", "ts_us", "cluster_id")


def save_output(rows: DataFrame, folder: str, keys: tuple[str, ...] = ("session", "tetrode"), mode: str = "overwrite") -> None:
    """Parquet by session and tetrode: the times and clusters, the grades or the comparison of a run."""
    there = [k for k in keys if k in rows.columns]
    (rows.repartition(*there) if there else rows).write.mode(mode).partitionBy(*there).parquet(folder)


def write_records(rows: DataFrame, folder: str, wires: list[str], append: bool = False, samples: int = 32) -> None:
    """Record tables for other tools: 1, 2 or 4 wires of ``samples`` counts each; other shapes are refused before anything is written."""
    if len(wires) not in (1, 2, 4):
        raise ValueError("records have 1, 2 or 4 wires")
    odd = F.array_max(F.array(*((F.size(w) != samples).cast("int") for w in wires)))
    checked = rows.withColumn(wires[0], F.when(odd == 0, F.col(wires[0])).otherwise(F.raise_error(F.lit(f"a record needs {samples} samples a wire"))))
    checked.write.mode("append" if append else "overwrite").parquet(folder)


def read_output(spark: SparkSession, folder: str, session: str | None = None) -> DataFrame:
    found = spark.read.parquet(folder)
    return found.where(F.col("session") == session) if session is not None else found
