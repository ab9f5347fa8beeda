"""Cluster geometry in any number of dimensions, by LDL factors of the covariances as plain columns.

A moment table has a row a cluster.  Its covariances are factored there once, so a
distance is a short expression over a row and its cluster's factors: no matrix
library, no Python on the executors, one equi-join of rows with their cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import moments


def total(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def factored(table: DataFrame, dims: list[str], cov: Callable[[str, str], Column] | None = None, prefix: str = "") -> DataFrame:
    """``table`` with ``<prefix>d_<i>`` and ``<prefix>l_<i>_<j>``: covariance = L D L'."""
    cov = cov or (lambda a, b: F.col(f"c_{a}_{b}"))
    name = lambda kind, *i: F.col("_".join([f"{prefix}{kind}", *map(str, i)]))
    for j, q in enumerate(dims):
        table = table.withColumn(f"{prefix}d_{j}", total([cov(q, q), *(-name("l", j, k) * name("l", j, k) * name("d", k) for k in range(j))]))
        lower = {f"{prefix}l_{i}_{j}": total([cov(q, dims[i]), *(-name("l", i, k) * name("l", j, k) * name("d", k) for k in range(j))]) / F.nullif(name("d", j), F.lit(0.0)) for i in range(j + 1, len(dims))}
        if lower:
            table = table.withColumns(lower)
    return table


def quadratic(differences: list[Column], prefix: str = "") -> Column:
    """v' C^-1 v by forward substitution with the factors of C; null for a singular C."""
    solved: list[Column] = []
    for i, v in enumerate(differences):
        solved.append(total([v, *(-F.col(f"{prefix}l_{i}_{k}") * solved[k] for k in range(i))]))
    return total([y * y / F.nullif(F.col(f"{prefix}d_{i}"), F.lit(0.0)) for i, y in enumerate(solved)])


def determinant(n: int, prefix: str = "") -> Column:
    out = F.col(f"{prefix}d_0")
    for i in range(1, n):
        out = out * F.col(f"{prefix}d_{i}")
    return out


def mahalanobis(dims: list[str], prefix: str = "") -> Column:
    """Squared Mahalanobis distance of a row to the factored moments beside it."""
    return quadratic([F.col(x) - F.col(f"mu_{x}") for x in dims], prefix)


def combined(parts: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Moments of unions of groups from the groups' own moments: centred sums are combined, so no digits are lost to large counts."""
    pairs = list(combinations_with_replacement(dims, 2))
    mean = parts.groupBy(*keys).agg(F.sum("n").alias("rows_n"), *((F.sum(F.col("n") * F.col(f"mu_{x}")) / F.sum("n")).alias(f"m_{x}") for x in dims))
    away = lambda x: F.col(f"mu_{x}") - F.col(f"m_{x}")
    scatter = {f"c_{a}_{b}": F.sum(F.coalesce(F.col(f"c_{a}_{b}") * (F.col("n") - 1), F.lit(0.0)) + F.col("n") * away(a) * away(b)) for a, b in pairs}
    out = parts.join(mean, keys).groupBy(*keys, "rows_n", *(f"m_{x}" for x in dims)).agg(*(v.alias(k) for k, v in scatter.items()))
    return out.select(*keys, F.col("rows_n").alias("n"), *(F.col(f"m_{x}").alias(f"mu_{x}") for x in dims), *((F.col(k) / (F.col("rows_n") - 1)).alias(k) for k in scatter))


def rest_moments(table: DataFrame, group: str, key: str, dims: list[str]) -> DataFrame:
    """Per cluster the moments of all rows of its group outside it, from the other clusters' moments (a few rows a group)."""
    others = table.withColumnRenamed(key, "_other")
    mine = table.select(group, key)
    return combined(mine.join(others, group).where(F.col(key) != F.col("_other")), [group, key], dims)


def lratio(rows: DataFrame, reference: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """``keys, lratio``: mean chi-squared tail of the rows under the reference moments of their keys.

    Where ``reference`` has columns ``use_<d>``, a key's distance is over the dimensions that it uses.
    """
    if f"use_{dims[0]}" not in reference.columns:
        near = rows.join(factored(reference, dims), keys)
        return near.groupBy(*keys).agg(F.avg(chi2_tail(mahalanobis(dims), len(dims))).alias("lratio"))
    use = lambda d: F.col(f"use_{d}")
    fit = factored(reference, dims, chosen(lambda a, b: F.col(f"c_{a}_{b}"), use))
    apart = quadratic([F.when(use(d), F.col(d) - F.col(f"mu_{d}")).otherwise(0.0) for d in dims])
    degrees = total([use(d).cast("int") for d in dims])
    return rows.join(fit, keys).groupBy(*keys).agg(F.avg(chi2_tail_of(apart, degrees, len(dims))).alias("lratio"))


def bhattacharyya(pairs: DataFrame, dims: list[str], other: str = "o_") -> DataFrame:
    """``pairs`` (moments beside moments named ``other``...) with ``bhat``."""
    mean = lambda a, b: (F.col(f"c_{a}_{b}") + F.col(f"{other}c_{a}_{b}")) / 2
    out = factored(factored(factored(pairs, dims), dims, lambda a, b: F.col(f"{other}c_{a}_{b}"), "y_"), dims, mean, "z_")
    n = len(dims)
    apart = quadratic([F.col(f"mu_{x}") - F.col(f"{other}mu_{x}") for x in dims], "z_") / 8
    return out.withColumn("bhat", apart + F.log(determinant(n, "z_") / F.sqrt(determinant(n) * determinant(n, "y_"))) / 2)


def named_other(table: DataFrame, keep: list[str], other: str = "o_") -> DataFrame:
    return table.select(*(F.col(c) if c in keep else F.col(c).alias(other + c) for c in table.columns))


# Coefficients of Cody's rational approximations of the error functions (1969), constant term last.
_ERF = ((1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(x: Column, parts: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    def horner(values: tuple[float, ...]) -> Column:
        out = F.lit(values[0])
        for v in values[1:]:
            out = out * x + v
        return out

    return horner(parts[0]) / horner(parts[1])


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0, to double precision."""
    near = 1.0 - z * _ratio(z * z, _ERF)
    middle = F.exp(-z * z) * _ratio(z, _MIDDLE)
    inverse = 1.0 / (z * z)
    far = F.exp(-z * z) / z * (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, _FAR))
    return F.when(z <= 0.46875, near).when(z <= 4, middle).otherwise(far)


def chi2_tail(x: Column, dims: int) -> Column:
    """P(chi-squared with ``dims`` degrees of freedom > x), to double precision: the tail of one or two degrees and a finite sum.

    1 for x = 0 and for no degrees; null and NaN stay what they are.
    """
    if dims == 0:
        return F.when(x.isNotNull(), F.lit(1.0))
    half = x / 2
    first = F.exp(-half) if dims % 2 == 0 else erfc(F.sqrt(half))
    term, sums = (half, []) if dims % 2 == 0 else (F.sqrt(half) * (2 / math.sqrt(math.pi)), [])
    for n in range(4 - dims % 2, dims + 1, 2):  # term: half^(n/2-1) / gamma(n/2)
        sums.append(term)
        term = term * half / (n / 2)
    return first + F.exp(-half) * total(sums) if sums else first


def chi2_tail_of(x: Column, degrees: Column, most: int) -> Column:
    """The tail for a number of degrees of freedom that rows differ in, from 0 to ``most``."""
    out = F.lit(None).cast("double")
    for d in range(most, -1, -1):
        out = F.when(degrees == d, chi2_tail(x, d)).otherwise(out)
    return out


def chosen(cov: Callable[[str, str], Column], use: Callable[[str], Column]) -> Callable[[str, str], Column]:
    """Covariances of the dimensions in use; another one is unrelated, of variance 1: it adds nothing to a distance from differences of 0."""
    return lambda a, b: F.when(use(a) & use(b), cov(a, b)).otherwise(F.lit(1.0 if a == b else 0.0))


def usable(rows: DataFrame, keys: list[str], dims: list[str], tolerance: float = 0.05) -> DataFrame:
    """``keys, use_<d>``: whether the distinct values of a dimension are ``tolerance`` of the group's rows at least.

    Values are made distinct where they are before they meet; a group may hold all rows.
    """
    long = rows.select(*keys, F.inline(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(d).cast("double").alias("v")) for i, d in enumerate(dims)))))
    values = long.groupBy(*keys, "dim", "v").agg(F.count("*").alias("n")).groupBy(*keys, "dim").agg((F.count("v") >= tolerance * F.sum("n")).alias("use"))
    return values.groupBy(*keys).agg(*(F.max(F.when(F.col("dim") == i, F.col("use"))).alias(f"use_{d}") for i, d in enumerate(dims)))


def rates_1d(rows: DataFrame, group: str, key: str, dims: list[str]) -> DataFrame:
    """``group, key, dim, rate``: one-dimensional L-ratio of each cluster and dimension against the rest of its group."""
    rest = rest_moments(moments(rows, [group, key], dims), group, key, dims)
    near = rows.select(group, key, *dims).join(rest, [group, key])
    z2 = lambda x: (F.col(x) - F.col(f"mu_{x}")) * (F.col(x) - F.col(f"mu_{x}")) / F.col(f"c_{x}_{x}")
    got = near.groupBy(group, key).agg(*(F.avg(erfc(F.sqrt(z2(x) / 2))).alias(x) for x in dims))
    return got.select(group, key, F.inline(F.array(*(F.struct(F.lit(x).alias("dim"), F.col(x).alias("rate")) for x in dims))))


def density(rows: DataFrame, dims: list[str], bin_width: float = 10.0, factor: float = 1.25, max_bins: int = 60, max_window: int = 10, by: list[str] | None = None) -> DataFrame:
    """The rows in cells that hold clearly more than the occupied cells around them, recording by recording (``by``; one recording where it is left out).

    Cells are about ``bin_width`` wide: round(range / width) a dimension, the largest value in one
    of its own.  The box around a cell is ceil(std / 7) cells wide; its sums are made a dimension at
    a time over occupied cells, so each step sends a cell to one line of neighbours.  With a single
    bin in some dimension, all windows of one cell, or more than ``max_bins``^4 cells or ``max_window``^4
    window cells, all rows of a recording stay.
    """
    columns = rows.columns
    of = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    stats = rows.groupBy(*of).agg(*(F.min(x).alias(f"lo_{i}") for i, x in enumerate(dims)), *(F.max(x).alias(f"hi_{i}") for i, x in enumerate(dims)), *(F.coalesce(F.stddev(x), F.lit(0.0)).alias(f"s_{i}") for i, x in enumerate(dims)))
    each = range(len(dims))
    stats = stats.select("*", *(F.floor((F.col(f"hi_{i}") - F.col(f"lo_{i}")) / bin_width + 0.5).alias(f"n_{i}") for i in each), *(F.ceil(F.col(f"s_{i}") / 7).alias(f"w_{i}") for i in each))
    product = lambda x: math.prod([F.col(f"{x}_{i}").cast("double") for i in each[1:]], start=F.col(f"{x}_0").cast("double"))
    single = total([(F.col(f"w_{i}") != 1).cast("int") for i in each]) == 0
    cut = (total([(F.col(f"n_{i}") <= 1).cast("int") for i in each]) == 0) & (product("n") <= max_bins ** 4) & ~single & (product("w") <= max_window ** 4)
    stats = stats.withColumn("cut", F.coalesce(cut, F.lit(False)))
    width = lambda i: (F.col(f"hi_{i}") - F.col(f"lo_{i}")) / F.col(f"n_{i}")
    keys = [f"b{i}" for i in each]
    joined = rows.join(F.broadcast(stats), of) if not by else rows.join(stats, of)
    placed = joined.where("cut").select(*rows.columns, *(F.floor((F.col(x) - F.col(f"lo_{i}")) / width(i)).alias(f"b{i}") for i, x in enumerate(dims)), *(f"w_{i}" for i in each))
    cells = placed.groupBy(*of, *keys, *(f"w_{i}" for i in each)).agg(F.count("*").alias("n"))
    sums = cells.withColumn("m", F.lit(1).cast("long"))
    for i, key in enumerate(keys):
        # a box of even width reaches one cell further up than down
        half = F.floor(F.col(f"w_{i}") / 2)
        sent = sums.withColumn(key, F.explode(F.sequence(F.col(key) - half, F.col(key) + F.col(f"w_{i}") - 1 - half)))
        sums = sent.groupBy(*of, *keys, *(f"w_{j}" for j in each)).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    mean = sums.select(*of, *keys, (F.col("n") / F.col("m")).alias("mean"))
    dense = cells.join(mean, [*of, *keys]).where(((F.col("n") > 1) | (F.col("mean") > 1)) & (F.col("n") > factor * F.col("mean"))).select(*of, *keys)
    return placed.join(dense, [*of, *keys], "left_semi").select(*columns).union(joined.where("not cut").select(*columns))
