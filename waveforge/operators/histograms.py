"""Histograms in any number of dimensions, of counts or of any aggregate.

One aggregation: a row finds its bin by itself, and only occupied bins meet.  Edges that aren't given follow from the group's range, a row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32


def histogram(rows: DataFrame, dims: list[str], edges: dict[str, list[float] | int] | None = None, by: list[str] | None = None, **accumulated: Column) -> DataFrame:
    """``by, bin_<d>, mid_<d>, count`` and an aggregate for each of ``accumulated``: the occupied bins, numbered from 1.

    ``edges``: rising edges of a dimension, or how many bins of equal width its range in the group is cut into (``BINS`` where nothing is said).  A bin
    holds its lower edge and not its upper one; rows on the last edge have a bin of their own behind the others, whose ``mid`` is null.  Rows outside the edges, or with a null or NaN
    in some dimension, are left out.  In a dimension of a single value all rows are on the last edge.
    """
    of, edges = by or [], edges or {}
    clean = rows.where(" and ".join(f"`{d}` is not null and not isnan(`{d}`)" for d in dims))
    cut = [d for d in dims if isinstance(edges.get(d, BINS), int)]
    if cut:
        ends = clean.groupBy(*of).agg(*(f(F.col(d)).cast("double").alias(f"{n}_{d}") for d in cut for n, f in (("lo", F.min), ("hi", F.max))))
        clean = clean.join(ends, of) if of else clean.crossJoin(F.broadcast(ends))  # one row
    place, mid = {}, {}
    for d in dims:
        given = edges.get(d, BINS)
        if isinstance(given, int):
            lo, hi = F.col(f"lo_{d}"), F.col(f"hi_{d}")
            place[d] = F.when(F.col(d) == hi, given + 1).otherwise(F.least(F.lit(given), F.floor((F.col(d) - lo) / F.nullif(hi - lo, F.lit(0.0)) * given) + 1)).cast("int")
            mid[d] = F.when(F.col(f"bin_{d}") <= given, lo + (F.col(f"bin_{d}") - 0.5) * (hi - lo) / given)
        else:
            steps = F.array(*(F.lit(float(e)) for e in given))
            place[d] = F.when(F.col(d) <= given[-1], _below(steps, d))
            mid[d] = F.when(F.col(f"bin_{d}") < len(given), (F.get(steps, F.col(f"bin_{d}") - 1) + F.get(steps, F.col(f"bin_{d}"))) / 2)
    placed = clean.withColumns({f"bin_{d}": v for d, v in place.items()}).where(" and ".join(f"bin_{d} >= 1" for d in dims))
    ranges = [f"{n}_{d}" for d in cut for n in ("lo", "hi")]
    out = placed.groupBy(*of, *(f"bin_{d}" for d in dims), *ranges).agg(F.count("*").alias("count"), *(v.alias(k) for k, v in accumulated.items()))
    return out.select(*of, *(f"bin_{d}" for d in dims), *(v.alias(f"mid_{d}") for d, v in mid.items()), "count", *accumulated)


def _below(steps: Column, d: str) -> Column:
    """How many edges are not above the value."""
    return F.size(F.filter(steps, lambda e: e <= F.col(d)))
