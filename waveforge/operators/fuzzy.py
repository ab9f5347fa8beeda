"""Single steps of fuzzy c-means as one aggregation; :mod:`.cores` has whole fits, of all groups at once.

A step is one aggregation over the rows: memberships follow from the current
centers (a few literals), and each partition only sends sums, so a group of any
size is clustered without gathering it.  Centers, at most ``k`` x ``dims`` numbers,
are all that reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def squared_distances(dims: list[str], centers: list[list]) -> list[Column]:
    return [sum(((F.col(d) - v) * (F.col(d) - v) for d, v in zip(dims[1:], c[1:], strict=True)), (F.col(dims[0]) - c[0]) * (F.col(dims[0]) - c[0])) for c in centers]


def memberships(dims: list[str], centers: list[list]) -> list[Column]:
    """Degrees of membership (fuzzifier 2); a row on a center belongs to it wholly, shared between equal centers."""
    d2 = squared_distances(dims, centers)
    on = sum((F.when(d == 0, 1).otherwise(0) for d in d2), F.lit(0))
    inverse = [F.lit(1.0) / F.nullif(d, F.lit(0.0)) for d in d2]
    total = sum(inverse[1:], inverse[0])
    return [F.when(on > 0, F.when(d == 0, 1.0 / on).otherwise(0.0)).otherwise(i / total) for d, i in zip(d2, inverse, strict=True)]


def step(rows: DataFrame, dims: list[str], centers: list[list[float]]) -> Row:
    """Sums of one step under the given centers: new centers, objective and partition coefficient."""
    u = memberships(dims, centers)
    d2 = squared_distances(dims, centers)
    sums = [F.sum(m * m).alias(f"w{i}") for i, m in enumerate(u)]
    sums += [F.sum(m * m * F.col(d)).alias(f"x{i}_{j}") for i, m in enumerate(u) for j, d in enumerate(dims)]
    sums += [F.sum(sum((m * m * q for m, q in zip(u[1:], d2[1:], strict=True)), u[0] * u[0] * d2[0])).alias("objective")]
    return rows.agg(F.count("*").alias("n"), *sums).first()


def fit(rows: DataFrame, dims: list[str], centers: list[list[float]], max_iter: int = 50, epsilon: float = 1e-5) -> tuple[list[list[float]], float]:
    """(centers, partition coefficient) after the objective changes by less than ``epsilon`` or ``max_iter`` steps."""
    before, coefficient = None, 0.0
    for _ in range(max_iter):
        got = step(rows, dims, centers)
        coefficient = sum(got[f"w{i}"] for i in range(len(centers))) / got["n"]
        if before is not None and abs(got["objective"] - before) < epsilon:
            break
        before = got["objective"]
        centers = [[got[f"x{i}_{j}"] / got[f"w{i}"] for j in range(len(dims))] if got[f"w{i}"] else c for i, c in enumerate(centers)]
    return centers, coefficient


def validity(coefficient: float, k: int) -> float:
    """The modified partition coefficient: 1 for a crisp partition, 0 for an even one."""
    return 1 - k / (k - 1) * (1 - coefficient)
