"""Principal components of waves and peaks, by recording.

A recording's scatter matrix is a sum over its rows: each Arrow batch sends one matrix
for each recording and wire, the sums meet by element, and only matrices (samples
x samples) are decomposed, a row of a small table each.  Rows then meet their
recording's components by an equi-join and are projected by built-in functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waveform as W


def scatter(rows: DataFrame, keys: list[str], wave: str, by_row: bool) -> DataFrame:
    """``keys, n, total, sums``: sums of the samples and of their products, row by row of the matrix.

    ``by_row``: each wave loses its own mean first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            code = pa.StructArray.from_arrays([batch.column(k) for k in keys], names=keys)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(code.to_pylist()):
                groups.setdefault(tuple(key.values()), []).append(i)
            waves, out = batch.column(wave), {k: [] for k in [*keys, "n", "total", "sums"]}
            for key, at in groups.items():
                x = np.asarray(waves.take(pa.array(at)).flatten(), np.float64).reshape(len(at), -1)
                x = x - x.mean(axis=1, keepdims=True) if by_row else x
                for name, value in zip(out, [*key, len(at), x.sum(axis=0).tolist(), (x.T @ x).ravel().tolist()], strict=True):
                    out[name].append(value)
            types = [batch.schema.field(k).type for k in keys] + [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    parts = rows.select(*keys, wave).mapInArrow(run, f"{kinds}, n long, total array<double>, sums array<double>")
    summed = lambda c: parts.select(*keys, "n", F.posexplode(c).alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias(c)).select(*keys, "n", F.transform(c, lambda x: x["v"]).alias(c))
    return summed("sums").join(summed("total").drop("n"), keys).select(*keys, "n", "total", "sums")


def components(sums: DataFrame, keys: list[str], k: int, centred: bool) -> DataFrame:
    """``keys, mean, axes``: the ``k`` axes of largest scatter, turned so that their largest coefficient is positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, axes = [], []
            for row in batch.to_pylist():
                total, n = np.array(row["total"]), row["n"]
                matrix = np.array(row["sums"]).reshape(len(total), -1)
                if centred:
                    matrix = matrix - np.outer(total, total) / n
                vectors = np.linalg.eigh(matrix)[1][:, ::-1][:, :k].T
                vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
                means.append((total / n).tolist())
                axes.append(vectors.tolist())
            out = [*(batch.column(x) for x in keys), pa.array(means, pa.list_(pa.float64())), pa.array(axes, pa.list_(pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(out, names=[*keys, "mean", "axes"])

    kinds = ", ".join(f"{x} {sums.schema[x].dataType.simpleString()}" for x in keys)
    return sums.mapInArrow(run, f"{kinds}, mean array<double>, axes array<array<double>>")


def projected(wave: Column, axis: Column) -> Column:
    return W.dot(wave, axis)


def spike_features(waves: DataFrame, group: str, item: str, wires: list[str]) -> DataFrame:
    """``group, item, features``: aligned peaks, the first component of each wire, and the components of the peaks but the last.

    Peaks are the samples at the place where most waves of the recording have theirs; components of
    waves come from waves without their own mean and are applied to waves with it; those of peaks are centred.
    """
    places = waves.groupBy(group).agg(*(F.mode(W.first_argmax(F.col(w)), True).alias(f"place_{w}") for w in wires))
    rows = waves.join(places, group).select(group, item, *wires, F.array(*(F.get(w, F.col(f"place_{w}")) for w in wires)).alias("peaks"))
    for w in wires:
        axes = components(scatter(rows, [group], w, by_row=True), [group], 1, centred=False)
        rows = rows.join(axes.select(group, F.get("axes", F.lit(0)).alias(f"axis_{w}")), group)
    peak_axes = components(scatter(rows, [group], "peaks", by_row=False), [group], len(wires) - 1, centred=True)
    rows = rows.join(peak_axes, group)
    away = F.zip_with("peaks", "mean", lambda x, m: x - m)
    first = F.array(*(projected(F.col(w), F.col(f"axis_{w}")) for w in wires))
    return rows.select(group, item, F.concat("peaks", first, F.transform("axes", lambda a: projected(away, a))).alias("features"))


def feature_lines(waves: DataFrame, group: str, item: str, wires: list[str], k: int = 3) -> DataFrame:
    """``group, ord, line``: the text of a feature file, first the number of features, then a line a spike: all wires' first component, then the second and third.

    Components come from the covariance of the waves and are applied to the waves themselves.
    """
    rows = waves.select(group, item, *wires)
    for w in wires:
        axes = components(scatter(rows, [group], w, by_row=False), [group], k, centred=True)
        rows = rows.join(axes.select(group, F.col("axes").alias(f"axes_{w}")), group)
    values = [projected(F.col(w), F.get(f"axes_{w}", F.lit(i))) for i in range(k) for w in wires]
    lines = rows.select(group, F.col(item).alias("ord"), F.concat_ws(" ", *(F.format_string("%.6f", v) for v in values)).alias("line"))
    first = rows.select(group).distinct().select(group, F.lit(-1).cast("long").alias("ord"), F.lit(str(k * len(wires))).alias("line"))
    return first.union(lines)
