"""Snippets that hold several spikes are split into one snippet a spike.

Everything happens inside a row, with built-in array functions: no shuffle, no Python.  A wire's candidates compete
with the other wires' ones, each that is left gets a cut, and the cuts become rows.  Places are 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waveform as W


def _last(places: Column, fits) -> Column:
    return F.array_max(F.filter(places, fits))


def _first(places: Column, fits) -> Column:
    return F.array_min(F.filter(places, fits))


def candidates(wires: list[str], k: int, threshold: Column) -> Column:
    """Places at which wire ``k`` has a spike of its own.

    A peak of .99 of the threshold at least that no other wire exceeds (the first wire wins a tie), and a valley under half
    the threshold before the wire's next peak of that height or the end of the snippet.
    """
    wave, n = F.col(wires[k]), F.size(wires[k])
    high = F.filter(F.col(f"peaks_{k}"), lambda p: F.get(wave, p) >= 0.99 * threshold)

    def leads(p: Column) -> Column:
        own = F.get(wave, p)
        beats = [own > F.get(F.col(w), p) if i < k else own >= F.get(F.col(w), p) for i, w in enumerate(wires) if i != k]
        return sum((~b).cast("int") for b in beats) == 0 if beats else F.lit(True)

    def falls(p: Column) -> Column:
        until = F.coalesce(_first(high, lambda q: q > p), n - 1)
        return F.exists(F.col(f"valleys_{k}"), lambda v: (v > p) & (v < until) & (F.get(wave, v) < threshold / 2))

    return F.filter(F.filter(high, leads), falls)


def competed(rows: DataFrame, wires: list[str], reach: Column) -> DataFrame:
    """Of two wires' candidates within ``reach`` of each other the lower one goes (the first wire's in a tie); a wire meets the later ones one after another, with all candidates that it had before."""
    for a in range(len(wires)):
        rows = rows.withColumn("before", F.col(f"spikes_{a}"))
        for b in range(a + 1, len(wires)):
            rows = rows.withColumns(_pair(wires, a, b, reach))
    return rows.drop("before")


def _pair(wires: list[str], a: int, b: int, reach: Column) -> dict[str, Column]:
    mine, theirs = f"spikes_{a}", f"spikes_{b}"
    near = lambda p, q: F.abs(p - q) <= reach
    higher = lambda p, q: F.get(F.col(wires[a]), p) > F.get(F.col(wires[b]), q)
    return {
        mine: F.filter(mine, lambda p: ~F.exists(theirs, lambda q: near(p, q) & ~higher(p, q))),
        theirs: F.filter(theirs, lambda q: ~F.exists("before", lambda p: near(p, q) & higher(p, q))),
    }


def _cut(wires: list[str], k: int, n: Column) -> Column:
    """Wire ``k``'s spikes as structs ``wire, at, lower, upper, spoiled``, in order."""
    every, peaks, valleys = F.col("every"), F.col(f"peaks_{k}"), F.col(f"valleys_{k}")
    under = lambda i, p: sum((F.get(F.col(w), i) > F.get(F.col(w), p)).cast("int") for w in wires) == 0

    def ends(p: Column) -> Column:
        before, after = _last(every, lambda q: q < p), _first(every, lambda q: q > p)
        lower = F.when(before.isNull(), F.coalesce(_last(peaks, lambda q: q < p), F.lit(0))).otherwise(_last(valleys, lambda v: (v > before) & (v < p)))
        # towards a later spike the last valley before it ends the cut, not the first one after the peak
        upper = F.when(after.isNull(), F.coalesce(_first(peaks, lambda q: q > p), n - 1)).otherwise(_last(valleys, lambda v: (v > p) & (v < after)))
        return F.struct(p.alias("at"), lower.alias("lower"), upper.alias("upper"))

    def shrunk(x: Column) -> Column:
        p = x["at"]
        # while some wire is above its value at the peak, the end moves towards the peak
        lower = F.when(under(x["lower"], p), x["lower"]).otherwise(_first(F.sequence(x["lower"], p), lambda i: (i > x["lower"]) & (i < p) & under(i, p)))
        upper = F.when(under(x["upper"], p), x["upper"]).otherwise(_last(F.sequence(p, x["upper"]), lambda i: (i < x["upper"]) & (i > p) & under(i, p)))
        spoiled = x["lower"].isNull() | x["upper"].isNull()
        return F.struct(F.lit(k + 1).alias("wire"), p.alias("at"), lower.alias("lower"), upper.alias("upper"), spoiled.alias("spoiled"))

    return F.transform(F.transform(F.col(f"spikes_{k}"), ends), shrunk)


def several(wires: list[str], thresholds: list[float]) -> Column:
    """Whether a snippet holds spikes apart: of all wires' peaks (and last samples) of 1.25 of the threshold and a quarter of the wire's highest at least, the first and the last are a third of the snippet apart."""

    def marked(w: str, limit: float) -> Column:
        top = F.array_max(w)
        return F.filter(W.local_peaks(F.col(w), include_last=True), lambda i: (F.get(w, i) >= 1.25 * limit) & (F.get(w, i) >= 0.25 * top))

    every = F.concat(*(marked(w, float(t)) for w, t in zip(wires, thresholds, strict=True)))
    return W.let(every, lambda at: F.coalesce(F.array_max(at) - F.array_min(at) >= F.ceil(0.33 * F.size(wires[0])), F.lit(False)))


def split(rows: DataFrame, wires: list[str], thresholds: list[float | Column], ts: str = "ts_us") -> DataFrame:
    """``rows`` with a row for each spike in them (none, one or several): the cut waves in the middle of zeros, ``ts`` moved by the samples before the cut, and ``part, part_wire, part_at, lower, upper``.

    Spikes are taken by wire, then by place.  One without a valley between itself and its neighbour spoils the snippet: it and
    what follows it are left out.  One whose cut would be empty is left out alone.  A sample lasts 1000 / n of ``ts``'s units.

    Cases: null waves give no row; snippets of under three samples hold no peak; null thresholds give no spike on their wire.
    """
    limits = [F.lit(float(t)) if isinstance(t, int | float) else t for t in thresholds]
    n = F.size(wires[0])
    out = rows.withColumns({f"peaks_{k}": F.when(n > 2, W.local_peaks(F.col(w))).otherwise(F.array().cast("array<int>")) for k, w in enumerate(wires)} | {f"valleys_{k}": F.when(n > 2, W.local_valleys(F.col(w))).otherwise(F.array().cast("array<int>")) for k, w in enumerate(wires)})
    out = out.withColumns({f"spikes_{k}": candidates(wires, k, limits[k]) for k in range(len(wires))})
    out = competed(out, wires, F.ceil(0.25 * n))
    out = out.withColumn("every", F.concat(*(F.col(f"spikes_{k}") for k in range(len(wires)))))
    out = out.withColumn("cuts", F.concat(*(_cut(wires, k, n) for k in range(len(wires)))))
    # the first spoiled one ends the snippet
    spoiled = F.array_position(F.transform("cuts", lambda x: x["spoiled"]), True)
    whole = F.filter(F.when(spoiled > 0, F.slice("cuts", 1, spoiled.cast("int") - 1)).otherwise(F.col("cuts")), lambda x: x["lower"].isNotNull() & x["upper"].isNotNull())
    own = [c for c in rows.columns if c not in (*wires, ts)]
    parts = out.select(*own, *wires, ts, F.posexplode(whole).alias("part", "cut"))
    start = F.floor((n - (F.col("cut.upper") - F.col("cut.lower") + 1)) / 2).cast("int")
    parts = parts.withColumn("start", start)
    moved = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 1),
        lambda i: F.when((i >= F.col("start")) & (i - F.col("start") + F.col("cut.lower") <= F.col("cut.upper")), F.get(F.col(w), i - F.col("start") + F.col("cut.lower"))).otherwise(F.lit(0.0)),
    )
    return parts.select(
        *own, (F.col(ts) + F.col("cut.lower") * 1000.0 / n).alias(ts), *(moved(w).alias(w) for w in wires),
        (F.col("part") + 1).alias("part"), F.col("cut.wire").alias("part_wire"), F.col("cut.at").alias("part_at"), F.col("cut.lower").alias("lower"), F.col("cut.upper").alias("upper"),
    )
