"""Order statistics, ranks and neighbours of large groups against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveforge.operators import selection, steps

r = np.random.default_rng(3)
GROUPS = {
    1: r.normal(0, 1, 3000),
    2: np.concatenate([r.normal(0, 1e-3, 2000), [1e6, -1e5]]),  # far outliers: many passes
    3: np.repeat([1.0, 2.0, 3.0], 700),
    4: np.array([5.0]),
    5: np.exp(r.uniform(-30, 30, 1500)),
    6: np.array([2.0, 1.0]),
    7: np.full(900, 4.0),
}


@pytest.fixture(params=["direct", "narrowed"])
def way(request, monkeypatch):
    if request.param == "narrowed":
        for name, value in (("DIRECT", 0), ("BINS", 64), ("GATHER", 20), ("CHUNK", 70)):
            monkeypatch.setattr(selection, name, value)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(g, int(i), float(v)) for g, x in GROUPS.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "g int, item long, v double").repartition(5).cache()


def test_medians_and_limits(frame, way):
    got = {x["g"]: x["median"] for x in selection.medians(frame, ["g"], "v").collect()}
    assert got == {g: float(np.median(x)) for g, x in GROUPS.items()}
    got = {x["g"]: x["limit"] for x in selection.limits(frame, ["g"], "v", 2.5).collect()}
    for g, x in GROUPS.items():
        assert got[g] is None if len(x) == 1 else got[g] == pytest.approx(np.median(x) + 2.5 * x.std(ddof=1), rel=1e-9)


def test_any_rank(spark, frame, monkeypatch):
    monkeypatch.setattr(selection, "GATHER", 5)
    ranks = [(g, w, k) for g, x in GROUPS.items() for w, k in enumerate((0, len(x) // 3, len(x) - 1, len(x)))]
    got = {(x["g"], x["which"]): x["value"] for x in selection.kth(frame, ["g"], "v", spark.createDataFrame(ranks, "g int, which int, rank long"), steps.Stages(spark)).collect()}
    want = {(g, w): float(np.sort(GROUPS[g])[k]) for g, w, k in ranks if k < len(GROUPS[g])}
    assert got == want


def test_lowest_rows_with_ties(frame, way):
    many = F.round(0.4 * F.col("n"))
    got = {}
    for x in selection.lowest(frame, ["g"], "v", "item", many).collect():
        got.setdefault(x["g"], set()).add(x["item"])
    for g, x in GROUPS.items():
        k = int(0.4 * len(x) + 0.5)
        assert got.get(g, set()) == set(np.lexsort((np.arange(len(x)), x))[:k].tolist())


def test_neighbours_across_borders(frame, way):
    got = {(x["g"], x["item"]): (x["b"], x["a"]) for x in selection.with_neighbours(frame, ["g"], ["v", "item"], before={"b": "item"}, after={"a": "v"}).collect()}
    want = {}
    for g, x in GROUPS.items():
        order = np.lexsort((np.arange(len(x)), x)).tolist()
        for i, at in enumerate(order):
            want[(g, at)] = (order[i - 1] if i else None, float(x[order[i + 1]]) if i + 1 < len(order) else None)
    assert got == want


def test_values_that_are_no_numbers_and_empty_tables(spark, way):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, 4.0), (2, 3, None)], "g int, item long, v double")
    assert {x["g"]: x["median"] for x in selection.medians(rows, ["g"], "v").collect()}.get(1) == 3.0
    for made in (selection.medians, lambda f, k, v: selection.lowest(f, k, v, "item", F.col("n")), lambda f, k, v: selection.with_neighbours(f, k, [v], before={"b": v})):
        assert made(rows.limit(0), ["g"], "v").count() == 0


def test_samples_do_not_depend_on_partitions(spark, frame):
    want = None
    for parts in (1, 40):
        rows = frame.repartition(parts)
        got = {(x["g"], x["item"]) for x in selection.sampled(rows, ["g"], "item", 30, seed=5).collect()}
        draws = sorted((x["g"], x["draw"], x["item"]) for x in selection.drawn(rows, ["g"], "item", 50, seed=5).collect())
        assert want in (None, (got, draws))
        want = (got, draws)
    sizes = {g: sum(1 for h, _ in got if h == g) for g in GROUPS}
    assert sizes == {g: min(30, len(x)) for g, x in GROUPS.items()}
    assert len(draws) == 50 * len(GROUPS) and {d for g, _, d in draws if g == 4} == {0}
    other = {(x["g"], x["item"]) for x in selection.sampled(frame, ["g"], "item", 30, seed=6).collect()}
    assert other != got


def test_neighbours_of_rows_that_have_a_place_already(frame, way):
    named = frame.select("g", F.col("item").alias("place"), "v", F.lit(1).alias("chunk"), F.lit("x").alias("own"))
    got = selection.with_neighbours(named, ["g"], ["place"], before={"b": "place"})
    assert got.columns == ["g", "place", "v", "chunk", "own", "b"]
    assert all(x["b"] == (x["place"] - 1 if x["place"] else None) for x in got.collect()) and got.count() == frame.count()


def test_sample_is_dealt_by_the_number_of_rows(frame, monkeypatch):
    monkeypatch.setattr(steps, "TASK_ROWS", 200)
    many = frame.count()
    assert steps.dealt(frame, many, "g").rdd.getNumPartitions() == -(-many // 200)
    want = sorted(map(tuple, selection.sampled(frame, ["g"], "item", 5).select("g", "item").collect()))
    assert sorted(map(tuple, selection.sampled(frame, ["g"], "item", 5, many=many).select("g", "item").collect())) == want
