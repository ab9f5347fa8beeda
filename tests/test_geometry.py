"""Tails of the chi-squared distribution and distances over chosen dimensions, against direct sums and NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveforge.operators import geometry
from waveforge.operators.moments import moments


def tail(x, dims):
    """The series of the lower incomplete gamma function, term by term."""
    h, a = x / 2, dims / 2
    if x == 0 or dims == 0:
        return 1.0
    return 1 - math.fsum(math.exp(-h + (a + n) * math.log(h) - math.lgamma(a + n + 1)) for n in range(400))


# Quantiles of .95 by degrees of freedom, from printed tables.
QUANTILES = {1: 3.841, 2: 5.991, 3: 7.815, 4: 9.488, 5: 11.070, 6: 12.592, 7: 14.067, 8: 15.507, 9: 16.919, 10: 18.307, 11: 19.675}


def test_tails_for_one_to_eleven_degrees(spark):
    xs = [0.0, 1e-9, 0.01, 0.4, 0.45, 1.0, 3.0, 10.0, 31.9, 32.1, 60.0, 200.0]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    for dims in range(0, 12):
        got = [r[0] for r in frame.select(geometry.chi2_tail(F.col("x"), dims)).collect()]
        assert got == pytest.approx([tail(x, dims) for x in xs], abs=3e-13), dims
    table = spark.createDataFrame([(d, float(q)) for d, q in QUANTILES.items()], "d int, q double")
    for r in table.select(geometry.chi2_tail_of(F.col("q"), F.col("d"), 11).alias("p")).collect():
        assert r["p"] == pytest.approx(0.05, abs=2e-5)
    far = frame.select(geometry.erfc(F.lit(10.0))).first()[0]
    assert far == pytest.approx(math.erfc(10.0), rel=1e-10)


@pytest.mark.parametrize("dims", [1, 2, 3, 5])
def test_lratio_in_any_number_of_dimensions(spark, dims):
    r = np.random.default_rng(dims)
    own, other = r.normal(0.5, 1, (80, dims)), r.normal(0, 1.5, (120, dims))
    names = [f"x{i}" for i in range(dims)]
    kinds = "k int, " + ", ".join(f"{x} double" for x in names)
    rows = spark.createDataFrame([(1, *map(float, x)) for x in own], kinds)
    rest = moments(spark.createDataFrame([(1, *map(float, x)) for x in other], kinds), ["k"], names)
    inverse = np.linalg.inv(np.cov(other.T).reshape(dims, dims))
    d = [(x - other.mean(0)) @ inverse @ (x - other.mean(0)) for x in own]
    assert geometry.lratio(rows, rest, ["k"], names).first()["lratio"] == pytest.approx(np.mean([tail(x, dims) for x in d]), abs=1e-12)


def test_lratio_leaves_out_singular_columns(spark):
    r = np.random.default_rng(9)
    own, other = r.normal(0, 1, (60, 4)), r.normal(0, 1.5, (200, 4))
    other[:, 1] = 3.0  # one value: singular
    names = ["a", "b", "c", "d"]
    kinds = "k int, a double, b double, c double, d double"
    rows, rest = (spark.createDataFrame([(1, *map(float, x)) for x in part], kinds) for part in (own, other))
    table = moments(rest, ["k"], names).join(geometry.usable(rest, ["k"], names), "k")
    assert [table.first()[f"use_{x}"] for x in names] == [True, False, True, True]
    keep = [0, 2, 3]
    inverse = np.linalg.inv(np.cov(other[:, keep].T))
    d = [(x - other.mean(0))[keep] @ inverse @ (x - other.mean(0))[keep] for x in own]
    got = geometry.lratio(rows, table, ["k"], names).first()["lratio"]
    assert got == pytest.approx(np.mean([tail(x, 3) for x in d]), abs=1e-12)


def test_usable_counts_distinct_values(spark):
    rows = spark.createDataFrame([(g, float(i % 4) if g == 1 else float(i), None) for g in (1, 2) for i in range(100)], "g int, x double, y double")
    got = {r["g"]: (r["use_x"], r["use_y"]) for r in geometry.usable(rows, ["g"], ["x", "y"]).collect()}
    assert got == {1: (False, False), 2: (True, False)}
    assert geometry.usable(rows.limit(0), ["g"], ["x", "y"]).count() == 0
