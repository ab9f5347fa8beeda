"""From the snippets of whole recordings to sorted spikes: the steps of the other modules, one after another, for all recordings at once.

resample -> set snippets of several spikes apart -> align -> features -> schedule of passes -> clustering in passes -> split the snippets set apart, and their spikes into the clusters found.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waveform as W
from . import features, gradebook, passes, shapes, splitting
from .steps import Stages, small


@dataclass
class Settings:
    """Wires' thresholds and input ranges in the waves' unit, and the sizes that decide on steps."""

    wires: list[str]
    thresholds: list[float]
    ranges: list[float]
    points: int = 120
    n_passes: int = 5
    least_rows: int = 10_000  # smaller recordings have passes without a condition
    least_in_pass: int = 600
    classify_std: float = 2.5
    template: list[float] = field(default_factory=lambda: [0.1, 0.3, 0.9, 0.3, 0.1])


def recording_of(by: list[str]) -> Column:
    return F.to_json(F.struct(*by))


def scores_by(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The columns less their recording's mean, over its deviation; a constant column becomes 0."""
    stats = rows.groupBy(*by).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev(c).alias(f"s_{c}") for c in columns))
    z = {c: F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    return rows.join(stats, by).withColumns(z).select(*rows.columns)


def signal_scores(aligned: DataFrame, raw: DataFrame, by: list[str], item: str, s: Settings) -> DataFrame:
    """``by, item, score``: how far a snippet's peak and valley stand out, as a score within its recording: per wire the aligned peak plus the valley's depth as scores, the largest of them, as a score."""
    places = aligned.groupBy(*by).agg(*(F.mode(W.first_argmax(F.col(w)), True).alias(f"place_{w}") for w in s.wires))
    turned = raw.select(*by, item, *(F.transform(w, lambda x: -x).alias(w) for w in s.wires))
    turned = turned.withColumn("wire", shapes.rep_wire(s.wires, s.thresholds, s.ranges))
    reach = int(0.25 * s.points + 0.5)
    valleys = turned.select(*by, item, *(v.alias(f"v_{w}") for w, v in zip(s.wires, shapes.peaks_near(s.wires, "wire", reach), strict=True)))
    sums = aligned.join(places, by).join(valleys, [*by, item]).select(*by, item, *((F.get(w, F.col(f"place_{w}")) + F.col(f"v_{w}")).alias(f"s_{w}") for w in s.wires))
    names = [f"s_{w}" for w in s.wires]
    best = scores_by(sums, by, names).select(*by, item, (F.greatest(*names) if len(names) > 1 else F.col(names[0])).alias("score"))
    return scores_by(best, by, ["score"])


def pass_numbers(scores: DataFrame, by: list[str], item: str, s: Settings) -> DataFrame:
    """``by, item, pass``: recordings of more than ``least_rows`` rows go by falling thresholds of the score, without passes of under ``least_in_pass`` rows, and all rows in the last; smaller ones have all rows in each."""
    large = scores.groupBy(*by).agg((F.count("*") > s.least_rows).alias("large"))
    limits = shapes.pass_thresholds(s.n_passes)
    by_score = F.array(*(F.when(~F.col("large") | (F.col("score") > t), F.lit(i + 1)) for i, t in enumerate(limits)), F.lit(s.n_passes))
    long = scores.join(large, by).select(*by, item, "large", F.explode(F.filter(by_score, lambda x: x.isNotNull())).alias("pass"))
    enough = long.groupBy(*by, "pass", "large").agg(F.count("*").alias("n")).where(~F.col("large") | (F.col("n") >= s.least_in_pass) | (F.col("pass") == s.n_passes)).select(*by, "pass")
    return long.join(enough, [*by, "pass"]).select(*by, item, "pass")


def aligned_peaks(waves: DataFrame, keys: list[str], wires: list[str], names: list[str]) -> DataFrame:
    """``waves`` with the wires' samples at the place where most of the group's waves have their peak."""
    places = waves.groupBy(*keys).agg(*(F.mode(W.first_argmax(F.col(w)), True).alias(f"place_{w}") for w in wires))
    return waves.join(places, keys).select(*(c for c in waves.columns if c not in wires), *(F.get(w, F.col(f"place_{w}")).alias(p) for w, p in zip(wires, names, strict=True)))


@dataclass
class Sorted:
    """``spikes``: ``by, item, part, ts_s, cluster`` (part 0: a snippet of one spike); ``members``: ``by, cluster, item, pass``; ``aligned`` waves with ``ts`` and peaks of the snippets of one spike."""

    spikes: DataFrame
    members: DataFrame
    aligned: DataFrame


def sorted_session(waves: DataFrame, by: list[str], item: str, ts: str, s: Settings) -> Sorted:
    """Sorts all recordings of ``waves`` (``by, item, ts`` in microseconds, the wires).

    A snippet in several clusters gets the one of the highest number; spikes in none are left out.  Cases: recordings in which nothing is found give no
    row; snippets with a null wave are left out; an empty table gives an empty result.
    """
    stages = Stages(waves.sparkSession)
    there = waves
    for w in s.wires:
        there = there.where(F.size(w) > 1)
    raw = there.select(*by, item, ts, *(W.resample(F.col(w), s.points).alias(w) for w in s.wires))
    raw = stages(raw.withColumn("several", splitting.several(s.wires, s.thresholds)), "raw")
    single = raw.where(~F.col("several")).drop("several")
    aligned = stages(single.select(*by, item, ts, *(W.align_to_peak(F.col(w), s.points).alias(w) for w in s.wires)), "aligned")
    width = len(s.wires)
    peaks, names = [f"p{i + 1}" for i in range(width)], [f"f{i}" for i in range(2 * width)]

    def described(rows: DataFrame, group: str) -> DataFrame:
        return features.spike_features(rows, group, item, s.wires)

    made = described(aligned.withColumn("_recording", recording_of(by)), "_recording")
    keys = aligned.select(*by, recording_of(by).alias("_recording")).distinct()
    values = made.join(small(stages(keys, "recordings")), "_recording").select(*by, item, *(F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)), *(F.get("features", F.lit(i)).alias(p) for i, p in enumerate(peaks)))
    rows = stages(scores_by(values, by, names), "rows")
    scores = stages(signal_scores(aligned, single, by, item, s), "scores")
    plan = stages(passes.schedule(pass_numbers(scores, by, item, s), rows, by, item, peaks), "plan")

    def loop_features(members: DataFrame, group: str) -> DataFrame:
        return described(members.join(aligned, [*by, item]), group).select(group, item, F.col("features").alias("x"))

    members = passes.iterated(passes.Recording(rows, by, item, names, peaks, loop_features, 3 * width - 1), plan)
    first = members.groupBy(*by, item).agg(F.max("cluster").alias("cluster")).join(aligned.select(*by, item, ts), [*by, item])
    first = first.select(*by, item, F.lit(0).alias("part"), (F.col(ts) / 1e6).alias("ts_s"), "cluster")

    parts = stages(splitting.split(raw.where("several").drop("several"), s.wires, s.thresholds, ts), "parts")
    own = aligned_peaks(members.select(*by, "cluster", item).join(aligned.select(*by, item, *s.wires), [*by, item]), [*by, "cluster"], s.wires, peaks)
    new = parts.select(*by, item, "part", ts, *(F.array_max(w).alias(p) for w, p in zip(s.wires, peaks, strict=True)))
    found = shapes.classified(stages(own, "own"), new.drop(ts), "cluster", [item, "part"], peaks, s.classify_std, by).where("cluster > 0")
    second = found.join(new.select(*by, item, "part", ts), [*by, item, "part"]).select(*by, item, "part", (F.col(ts) / 1e6).alias("ts_s"), "cluster")
    spikes = stages(first.unionByName(second), "sorted")
    return Sorted(spikes, members, stages(aligned.join(rows.select(*by, item, *peaks), [*by, item]), "described"))


def graded_session(done: Sorted, by: list[str], item: str, ts: str, s: Settings, short_isi: float = 1e-3) -> DataFrame:
    """The grades of the clusters of a sorted session."""
    peaks = [f"p{i + 1}" for i in range(len(s.wires))]
    return gradebook.graded(done.aligned, done.members, by, "cluster", item, ts, s.wires, peaks, s.thresholds, s.template, short_isi)
