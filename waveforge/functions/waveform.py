"""Column functions over waveforms (arrays of doubles); places are 0-based.

All are built-in higher-order functions: no Python runs on the executors, and an
expression is evaluated where the row is, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def resample(wave: Column, n_out: int, last: Column | int | None = None) -> Column:
    """Linear interpolation at ``n_out`` evenly spaced places from 0 to ``last`` (the last sample by default)."""
    end = F.size(wave) - 1 if last is None else (F.lit(last) if isinstance(last, int) else last)
    step = end.cast("double") / (n_out - 1)

    def at(j: Column) -> Column:
        place = j * step
        low = F.least(F.floor(place).cast("int"), F.size(wave) - 2)
        return F.get(wave, low) + (F.get(wave, low + 1) - F.get(wave, low)) * (place - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n_out - 1)), at)


def first_argmax(wave: Column, low: int = 0, high: int | None = None) -> Column:
    """First place of the largest sample with ``low <= place <= high``."""
    part = wave if low == 0 and high is None else F.slice(wave, low + 1, (high if high is not None else 1 << 30) - low + 1)
    return (F.array_position(part, F.array_max(part)) - 1 + low).cast("int")


def align_geometry(n: int) -> tuple[int, int, int, int]:
    """(length, target, first, last) of alignment for n samples; halves round away from zero, places are 0-based."""
    half_up = lambda x: int(x + 0.5)
    out = half_up(1.25 * n)
    target = half_up(0.75 * (out - n)) + half_up(0.2 * n)
    return out, target - 1, half_up(n / 6) - 1, half_up(5 * n / 6) - 1


def align_to_peak(wave: Column, n: int) -> Column:
    """The wave shifted so that its peak in the middle two thirds stands at the target place, zeros around it."""
    out, target, low, high = align_geometry(n)

    def moved(w: Column, shift: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(out - 1)), lambda i: F.when((i - shift >= 0) & (i - shift < n), F.get(w, i - shift)).otherwise(F.lit(0.0)))

    return let(wave, lambda w: let(F.lit(target) - first_argmax(w, low, high), lambda shift: moved(w, shift)))


def local_peaks(wave: Column, include_last: bool = False) -> Column:
    """Places that rise above the sample before and are not under the sample after."""
    def is_peak(i: Column) -> Column:
        rises = F.get(wave, i) > F.get(wave, i - 1)
        after = F.get(wave, i) >= F.get(wave, i + 1)
        return rises & after

    inner = F.filter(F.sequence(F.lit(1), F.size(wave) - 2), is_peak)  # of a column: see let() for longer expressions
    return F.concat(inner, F.array(F.size(wave) - 1)) if include_last else inner


def local_valleys(wave: Column) -> Column:
    return let(F.transform(wave, lambda x: -x), lambda w: local_peaks(w))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def template_snr(wave: Column, template: list[float]) -> Column:
    """Best share over all offsets of the energy that the unit-length template explains: A / (|v|^2 - A)."""
    t = F.array(*map(F.lit, template))
    m = len(template)

    def share(part: Column) -> Column:
        return let(dot(part, t) * dot(part, t), lambda a: a / F.nullif(dot(part, part) - a, F.lit(0.0)))

    def at(i: Column) -> Column:
        return let(F.slice(wave, i + 1, m), share)

    return F.array_max(F.transform(F.sequence(F.lit(0), F.size(wave) - m), at))


def template_matches(wave: Column, templates: list[list[float]]) -> Column:
    """``snr, amplitude, offset`` (from 0) of the offset at which unit-length templates explain most: the explained energy A summed over the templates, over the rest of the part's energy.

    The first of equal offsets; one at which nothing is left counts for nothing.
    """
    m = len(templates[0])
    columns = [F.array(*map(F.lit, t)) for t in templates]

    def at(i: Column) -> Column:
        def of(part: Column) -> Column:
            explained = sum((dot(part, t) * dot(part, t) for t in columns[1:]), dot(part, columns[0]) * dot(part, columns[0]))
            return let(explained, lambda a: F.struct((a / F.nullif(dot(part, part) - a, F.lit(0.0))).alias("snr"), (-i).alias("back"), a.alias("amplitude")))

        return let(F.slice(wave, i + 1, m), of)

    every = F.filter(F.transform(F.sequence(F.lit(0), F.size(wave) - m), at), lambda x: x["snr"].isNotNull())
    return let(F.array_max(every), lambda x: F.struct(x["snr"].alias("snr"), x["amplitude"].alias("amplitude"), (-x["back"]).alias("offset")))
