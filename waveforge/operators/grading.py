"""Grades of clusters: a fixed set of isolation, timing and shape measures and the rule-based final grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import waveform
from . import selection

MAX_SHORT_ISI = 0.05


def _above(x: Column, limit: float) -> Column:
    """x > limit, false for NaN and null."""
    return F.coalesce(~F.isnan(x) & (x > limit), F.lit(False))


def _below(x: Column, limit: float) -> Column:
    return F.coalesce(~F.isnan(x) & (x < limit), F.lit(False))


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def final_grades(grades: DataFrame, few_wires: int = 2) -> DataFrame:
    """``grades`` with ``final_grade`` and ``confidence``; ``few_wires``: a cluster on so many wires or fewer has grade -5.

    Rules apply in order, the first that holds decides; a comparison with NaN or
    null never holds.  Columns: snr, share, mpc, below, iso, wires, width,
    short_isi, rate, lratio, valley (boolean), bhat_mua, bhat_near, min_bhat, bhat_unsorted.
    """
    c = F.col
    far = _missing(c("bhat_unsorted"))
    distant = _above(c("min_bhat"), 4) & (far | _above(c("bhat_unsorted"), 2))
    mua = ~_missing(c("bhat_mua")) & (_below(c("bhat_mua"), 1.5) | (_above(c("below"), 0.1) & _below(c("bhat_near"), 0.5))) & _below(c("iso"), 1)
    clean = (far | _above(c("bhat_unsorted"), 1)) & _above(c("min_bhat"), 2) & _below(c("short_isi"), MAX_SHORT_ISI) & _below(c("below"), 0.1)
    infinite = F.coalesce(c("bhat_near") == float("inf"), F.lit(False))
    bad_isolation = _above(c("lratio"), 0.3) & _below(c("iso"), 5)
    grade = (
        F.when(_above(c("snr"), 0.25) | F.coalesce(c("snr") == 0.25, F.lit(False)), -1)
        .when(_below(c("share"), 0.25), -2)
        .when(_above(c("mpc"), 0.75), -3)
        .when(_above(c("below"), 0.35) & _below(c("iso"), 1), -4)
        .when(_below(c("wires").cast("double"), few_wires + 0.5), -5)
        .when(_below(c("width"), 90), -6)
        .when(_above(c("short_isi"), MAX_SHORT_ISI), -7)
        .when(_above(c("rate"), 50), -8)
        .when(bad_isolation, -9)
        .when(~F.coalesce(c("valley"), F.lit(False)), -10)
        .when(_above(c("below"), 0.25) & _below(c("iso"), 1), 1)
        .when(mua, 2)
        .when((distant | _below(c("lratio"), 0.05)) & _below(c("below"), 0.1) & infinite, 5)
        .when(_below(c("lratio"), 0.1), F.when(clean, 4).otherwise(3))
        .otherwise(2)
    )
    graded = grades.withColumn("final_grade", grade)
    unsure = c("final_grade").isin(3, 4) & _above(c("below"), 0.15)
    return graded.withColumn("confidence", F.when(c("final_grade") == -9, 0.8).when(unsure, 0.5).otherwise(1.0))


def incompleteness(rows: DataFrame, key: str, value: str, threshold: Column, bins: int = 21) -> DataFrame:
    """``key, below``: mass under the threshold of the distribution mirrored at its modal bin.

    Equal-width bins, the last closed; ties go to the lowest modal bin.  The right
    half stands for the left one, so only bin counts are needed: one aggregation
    for the range, one for the counts.
    """
    ends = rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.first(threshold).alias("threshold"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width))
    counts = rows.select(key, value).join(ends, key).where("hi > lo").withColumn("bin", at).groupBy(key, "bin").agg(F.count("*").alias("n"), *(F.first(x).alias(x) for x in ("lo", "hi", "threshold")))
    by_key = Window.partitionBy(key)
    modal = F.min(F.struct((-F.col("n")).alias("m"), "bin")).over(by_key)["bin"]
    counts = counts.withColumn("modal", modal).where("bin >= modal")
    center = lambda b: F.col("lo") + (b + 0.5) * width
    mirrored = F.when((F.col("bin") > F.col("modal")) & (center(2 * F.col("modal") - F.col("bin")) < F.col("threshold")), F.col("n")).otherwise(0)
    own = F.when(center(F.col("bin")) < F.col("threshold"), F.col("n")).otherwise(0)
    total = F.sum(F.when(F.col("bin") > F.col("modal"), 2 * F.col("n")).otherwise(F.col("n")))
    return counts.groupBy(key).agg((F.sum(mirrored + own) / total).alias("below"))


def core_rows(rows: DataFrame, key: str | list[str], distance: str, tie: str) -> DataFrame:
    """The core of each cluster: its k nearest rows, k = min(round(.6 n), max(200, round(.3 n))).  ``key``: a column or several."""
    k = F.least(F.round(0.6 * F.col("n")), F.greatest(F.lit(200.0), F.round(0.3 * F.col("n"))))
    return selection.lowest(rows, [key] if isinstance(key, str) else key, distance, tie, k)


def overlaps(members: DataFrame, a: str, b: str, item: str) -> DataFrame:
    """``a, b, common, of_a, of_b``: overlaps of two labelings of the same items, from counts alone."""
    both = members.groupBy(a, b).agg(F.countDistinct(item).alias("common"))
    na = both.groupBy(a).agg(F.sum("common").alias("na"))
    nb = both.groupBy(b).agg(F.sum("common").alias("nb"))
    return both.join(na, a).join(nb, b).select(F.col(a).alias("a"), F.col(b).alias("b"), "common", (F.col("common") / F.col("na")).alias("of_a"), (F.col("common") / F.col("nb")).alias("of_b"))


def find_ratio(graded: DataFrame, found_below: float = 0.75, least: int = 200) -> DataFrame:
    """``final_grade, clusters, found, ratio``: shares of clusters whose nearest other one is under ``found_below``.

    Clusters of grade 3 and better count from ``least`` rows on.
    """
    hit = F.sum((F.col("min_bhat") < found_below).cast("int"))
    rows = graded.where((F.col("n") >= least) | (F.col("final_grade") <= 2))
    return rows.groupBy("final_grade").agg(F.count("*").alias("clusters"), hit.alias("found"), (hit / F.count("*")).alias("ratio"))


def half_peak_range(wave: str, percent: float) -> Column:
    """``start, end`` (0-based) of the run around the largest sample in which samples reach ``percent`` of it.

    The run stays between the last local minimum before the peak and the last sample before the wave falls under that minimum.
    """
    w = F.col(wave)
    n = F.size(w)
    places = F.sequence(F.lit(0), n - 1)
    at, top = waveform.first_argmax(w), F.array_max(w)
    first = F.array_max(F.filter(waveform.local_valleys(w), lambda i: i < at))
    low = F.coalesce(first, F.lit(0))
    fall = F.array_min(F.filter(places, lambda i: (i > low) & (F.get(w, i) < F.get(w, low))))
    high = F.coalesce(fall - 1, n - 1)
    before = F.array_max(F.filter(places, lambda i: (i < at) & (F.get(w, i) < top * percent)))
    after = F.array_min(F.filter(places, lambda i: (i > at) & (F.get(w, i) < top * percent)))
    return F.struct(F.greatest(low, F.coalesce(before + 1, F.lit(0))).alias("start"), F.least(high, F.coalesce(after - 1, n - 1)).alias("end"))


def half_peak_spread(rows: DataFrame, key: str, wave: str, mean: str, start: str, end: str) -> DataFrame:
    """``key, cv, low_share``: the largest variation of a sample in the range, and the share of waves that the mean explains to under 0.7."""
    part = lambda c: F.slice(c, F.col(start) + 1, F.col(end) - F.col(start) + 1)
    cut = rows.select(key, part(wave).alias("v"), part(mean).alias("m"))
    average = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    centred = cut.withColumns({"av": average("v"), "am": average("m")}).select(key, "v", F.transform("v", lambda x: x - F.col("av")).alias("cv"), F.transform("m", lambda x: x - F.col("am")).alias("cm"))
    share = waveform.dot(F.col("cv"), F.col("cm")) * waveform.dot(F.col("cv"), F.col("cm")) / F.nullif(waveform.dot(F.col("cm"), F.col("cm")) * waveform.dot(F.col("cv"), F.col("cv")), F.lit(0.0))
    low = centred.groupBy(key).agg(F.avg((share < 0.7).cast("int")).alias("low_share"))
    at = centred.select(key, F.posexplode("v").alias("pos", "x")).groupBy(key, "pos").agg((F.stddev("x") / F.nullif(F.avg("x"), F.lit(0.0))).alias("cv"))
    return at.groupBy(key).agg(F.max("cv").alias("cv")).join(low, key)


def valley_after_peak(wave: str) -> Column:
    """Whether a local minimum follows the highest local peak."""
    w = F.col(wave)
    peaks = F.transform(waveform.local_peaks(w), lambda i: F.struct((-F.get(w, i)).alias("v"), i.alias("i")))
    return F.coalesce(F.array_max(waveform.local_valleys(w)) > F.array_min(peaks)["i"], F.lit(False))
