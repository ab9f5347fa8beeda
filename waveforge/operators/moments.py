"""Cluster geometry from moments: one aggregation a cluster, then closed forms over the small table.

A moment table has a row a cluster; it is joined with the rows by the cluster key
or with itself for pairs of clusters, never with all pairs of rows.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(rows: DataFrame, keys: list[str], dims: list[str], sample: bool = True) -> DataFrame:
    """``keys, n, mu_<d>, c_<d>_<e>``: counts, means and (sample or population) covariances."""
    cov = F.covar_samp if sample else F.covar_pop
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *(F.avg(d).alias(f"mu_{d}") for d in dims),
        *(cov(a, b).alias(f"c_{a}_{b}") for a, b in combinations_with_replacement(dims, 2)),
    )


def mahalanobis_2d(x: str, y: str, prefix: str = "") -> Column:
    """Squared Mahalanobis distance of columns x and y to the moments with ``prefix``."""
    m = lambda c: F.col(prefix + c)
    dx, dy = F.col(x) - m(f"mu_{x}"), F.col(y) - m(f"mu_{y}")
    a, b, d = m(f"c_{x}_{x}"), m(f"c_{x}_{y}"), m(f"c_{y}_{y}")
    return (d * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * d - b * b)


def bhattacharyya_2d(table: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """``a, b, bhat`` for the pairs of clusters a < b; the table has a row a cluster."""
    other = table.select(*(F.col(c).alias(f"o_{c}") for c in table.columns))
    pairs = table.join(other, F.col(key) < F.col(f"o_{key}"))
    mean = lambda c: (F.col(c) + F.col(f"o_{c}")) / 2
    a, b, d = mean(f"c_{x}_{x}"), mean(f"c_{x}_{y}"), mean(f"c_{y}_{y}")
    det = a * d - b * b
    own = lambda p: F.col(f"{p}c_{x}_{x}") * F.col(f"{p}c_{y}_{y}") - F.col(f"{p}c_{x}_{y}") * F.col(f"{p}c_{x}_{y}")
    dx, dy = F.col(f"mu_{x}") - F.col(f"o_mu_{x}"), F.col(f"mu_{y}") - F.col(f"o_mu_{y}")
    first = (d * dx * dx - 2 * b * dx * dy + a * dy * dy) / det / 8
    return pairs.select(F.col(key).alias("a"), F.col(f"o_{key}").alias("b"), (first + F.log(det / F.sqrt(own("") * own("o_"))) / 2).alias("bhat"))
