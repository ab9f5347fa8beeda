"""A sorting read back from its output, graded again, and compared with another sorting of the same recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gradebook
from .geometry import named_other
from .steps import Stages

SAME, FOUND = 1.0, 0.75  # distances under which a cluster has a partner, and counts as found in the statistics


def members_at(output: DataFrame, spikes: DataFrame, by: list[str], key: str, item: str, ts: str, tolerance_us: float) -> DataFrame:
    """``by, key, item``: the spike nearest in time to each row of ``output`` (``by, ts_s, key``) in its recording, if closer than the tolerance; the earlier one in a tie.  Cluster 0 is none.

    Times are cut into bins of the tolerance, and a row meets the spikes of its own bin and its two neighbours.
    """
    rows = output.where(F.col(key) > 0).select(*by, key, (F.col("ts_s") * 1e6).alias("_at")).withColumn("_row", F.monotonically_increasing_id())
    near = lambda x: F.floor(x / tolerance_us)
    left = rows.withColumn("_bin", F.explode(F.sequence(near(F.col("_at")) - 1, near(F.col("_at")) + 1)))
    right = spikes.select(*by, item, F.col(ts).cast("double").alias("_ts"), near(F.col(ts)).alias("_bin"))
    pairs = left.join(right, [*by, "_bin"]).withColumn("_away", F.abs(F.col("_ts") - F.col("_at"))).where(F.col("_away") < tolerance_us)
    best = pairs.groupBy(*by, key, "_row").agg(F.min(F.struct("_away", "_ts", item))[item].alias(item))
    return best.select(*by, key, item).distinct()


def compared(spikes: DataFrame, manual: DataFrame, auto: DataFrame, by: list[str], item: str, peaks: list[str]) -> DataFrame:
    """``by, manual, auto, common, bhat, found``: every two clusters of the two sortings (``by, cluster, item``) of a recording; ``found``: the manual one has a partner under ``SAME``.

    A manual cluster of a recording without automatic ones has one row, without a partner.
    """
    stages = Stages(spikes.sparkSession)
    table = lambda members: stages(gradebook.described_by(members.select(*by, "cluster", item).distinct().join(spikes.select(*by, item, *peaks), [*by, item]), [*by, "cluster"], peaks), "described")
    mine, theirs = table(manual), named_other(table(auto), by)
    pairs = gradebook.bhattacharyya(mine.join(theirs, by, "left"), peaks).select(*by, F.col("cluster").alias("manual"), F.col("o_cluster").alias("auto"), "bhat")
    common = manual.select(*by, F.col("cluster").alias("manual"), item).distinct().join(auto.select(*by, F.col("cluster").alias("auto"), item).distinct(), [*by, item]).groupBy(*by, "manual", "auto").agg(F.count("*").alias("common"))
    out = pairs.join(common, [*by, "manual", "auto"], "left").withColumn("common", F.coalesce("common", F.lit(0).cast("long")))
    hit = out.groupBy(*by, "manual").agg(F.coalesce(F.min("bhat") < SAME, F.lit(False)).alias("found"))
    return out.join(hit, [*by, "manual"]).select(*by, "manual", "auto", "common", "bhat", "found")


def found_statistics(pairs: DataFrame, manual_grades: DataFrame, auto_grades: DataFrame, by: list[str], least: int = 200) -> DataFrame:
    """``grade, clusters, found``: how many manual clusters of each final grade there are, and how many of them the automatic sorting found (a partner under ``FOUND``).

    Grades 3 to 5 count from ``least`` rows on, and as found only with a partner of grade 3 or more, as does 2; ``artifacts`` are those of negative grades, and never
    count as found.  ``good`` (5), ``medium`` (3 and 4, of full confidence) and ``bad`` (1 and 2) are from ``least`` rows on, with any partner.
    """
    best = pairs.where("auto is not null and bhat is not null").groupBy(*by, "manual").agg(F.min(F.struct("bhat", "auto")).alias("b")).select(*by, F.col("manual").alias("cluster"), "b.bhat", "b.auto")
    partner = auto_grades.select(*by, F.col("cluster").alias("auto"), F.col("final_grade").alias("partner"))
    rows = manual_grades.select(*by, "cluster", "n", "final_grade", "confidence").join(best, [*by, "cluster"], "left").join(partner, [*by, "auto"], "left")
    grade, large = F.col("final_grade"), F.col("n") >= least
    hit = F.coalesce(F.col("bhat") < FOUND, F.lit(False))
    fine = hit & F.coalesce(F.col("partner") >= 3, F.lit(False))
    kind = lambda name, member, found: F.when(member, F.struct(F.lit(name).alias("grade"), found.alias("hit")))
    kinds = [*(kind(f"g{g}", (grade == g) & (large if g > 2 else F.lit(True)), fine if g > 1 else hit) for g in (5, 4, 3, 2, 1)), kind("artifacts", grade < 0, F.lit(False))]
    kinds += [kind("good", (grade == 5) & large, hit), kind("medium", grade.isin(3, 4) & large & (F.col("confidence") == 1), hit), kind("bad", grade.isin(1, 2) & large, hit)]
    long = rows.select(F.inline(F.filter(F.array(*kinds), lambda x: x.isNotNull())))
    return long.groupBy("grade").agg(F.count("*").alias("clusters"), F.count_if("hit").alias("found"))


def regraded(output: DataFrame, manual: DataFrame, spikes: DataFrame, by: list[str], item: str, ts: str, wires: list[str], peaks: list[str], thresholds: list[float], template: list[float], tolerance_us: float = 1000.0, short_isi: float = 1e-3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(grades of the output's clusters, grades of the manual ones, :func:`compared`, :func:`found_statistics`) of two sortings (``by, ts_s, cluster``) of the aligned ``spikes``."""
    stages = Stages(spikes.sparkSession)
    spikes = stages(spikes.select(*by, item, ts, *wires, *peaks), "spikes")
    sets = [stages(members_at(rows, spikes, by, "cluster", item, ts, tolerance_us), "members") for rows in (output, manual)]
    grades = [gradebook.graded(spikes, members, by, "cluster", item, ts, wires, peaks, thresholds, template, short_isi) for members in sets]
    pairs = stages(compared(spikes, sets[1], sets[0], by, item, peaks), "pairs")
    return grades[0], grades[1], pairs, found_statistics(pairs, grades[1], grades[0], by)

