"""Every query against its SQL in DuckDB on the smallest tables, and the operators on hand-made rows."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waveforge.functions import waveform as W
from waveforge.operators import cores, grading, steps, trains
from waveforge.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def rows_of(columns, rows):
    plain = lambda x: float(x) if type(x).__name__ == "Decimal" else x
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = oracle.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(columns, got.select(*columns).collect()) == rows_of(columns, want.select(*columns).fetchall())


def test_aligned_peak_stands_at_the_target(spark):
    wave = [0.0] * 120
    wave[70] = 5.0
    got = spark.createDataFrame([(wave,)], "w array<double>").select(W.align_to_peak(F.col("w"), 120).alias("a")).first()["a"]
    assert len(got) == 150 and got.index(5.0) == 46


def test_plateaus_count_once_and_ends_never(spark):
    frame = spark.createDataFrame([([3.0, 1.0, 2.0, 2.0, 1.0, 4.0],)], "w array<double>")
    got = frame.select(W.local_peaks(F.col("w")).alias("p"), W.local_peaks(F.col("w"), include_last=True).alias("q")).first()
    assert (got["p"], got["q"]) == ([2], [2, 5])


def test_nearest_prefers_the_earlier_event_and_respects_the_tolerance(spark):
    events = spark.createDataFrame([(1, 90), (2, 110), (3, 500)], "event_id long, ts_us long")
    labels = spark.createDataFrame([(7, 100), (8, 300), (9, 500)], "label_id long, ts_us long")
    got = {r["label_id"]: (r["event_id"], r["distance"]) for r in trains.nearest(labels, events, 50).collect()}
    assert got == {7: (1, 10), 9: (3, 0)}


def test_grades_with_nan_take_no_rule_that_compares_them(spark):
    nan, inf = float("nan"), float("inf")
    names = "snr share mpc below iso wires width short_isi rate lratio valley bhat_mua bhat_near min_bhat bhat_unsorted".split()
    good = dict(zip(names, [0.1, 0.9, 0.1, 0.01, 9.0, 4.0, 120.0, 0.0, 5.0, 0.01, True, nan, inf, 5.0, nan], strict=True))
    rows = [good, good | {"snr": 0.25}, good | {"lratio": nan, "min_bhat": nan}, good | {"valley": False}, good | {"lratio": 0.5, "iso": 2.0}]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {'boolean' if n == 'valley' else 'double'}" for n in names))
    got = [(r["final_grade"], r["confidence"]) for r in grading.final_grades(frame).collect()]
    assert got == [(5, 1.0), (-1, 1.0), (2, 1.0), (-10, 1.0), (-9, 0.8)]


def test_fuzzy_clustering_finds_planted_groups(spark):
    points = [(i, 10.0 * (i % 3) + (i % 7) * 0.05, 20.0 * (i % 3) + (i % 5) * 0.05) for i in range(120)]
    frame = spark.createDataFrame(points, "id long, x double, y double").select(F.lit(0).alias("all"), "id", F.array("x", "y").alias("x")).cache()
    fits = cores.fit_groups(frame, ["all"], "id", 4, 2, steps.Stages(spark), max_iter=30).withColumn("weights", F.array(F.lit(1.0), F.lit(1.0)))
    found = fits.first()
    assert found["k"] == 3 and found["validity"] > 0.9
    groups = {}
    for r in cores.assigned(frame, fits, ["all"]).collect():
        groups.setdefault(r["child"], set()).add(r["id"] % 3)
    assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,)]


def test_empty_tables_give_empty_results(spark):
    train = spark.createDataFrame([], "event_id long, unit long, wire string, ts_us long, amplitude double")
    assert trains.train_report(train, 1.0, (1.0, 2.0)).count() == 0
    assert trains.burst_flags(train, 1000, 2.0).count() == 0


def test_fuzzy_clustering_equals_numpy_with_six_groups(spark, monkeypatch):
    r = np.random.default_rng(4)
    points = np.concatenate([np.array(c) + r.normal(0, 0.6, (20, 2)) for c in ((0, 0), (9, 1), (2, 11), (14, 12), (25, 3), (22, 20))])

    def distances(centers):
        return ((points[:, None, :] - centers[None]) ** 2).sum(axis=2)

    centers, best = points.mean(axis=0)[None], (None, 0.0)
    for k in range(2, 7):
        centers, before = np.vstack([centers, points[distances(centers).sum(axis=1).argmin()] + 1e-5]), None
        for _ in range(50):
            d2 = distances(centers)
            u2 = ((1 / d2) / (1 / d2).sum(axis=1, keepdims=True)) ** 2
            coefficient, objective = u2.sum() / len(points), (u2 * d2).sum()
            if before is not None and abs(objective - before) < 1e-5:
                break
            before, centers = objective, u2.T @ points / u2.sum(axis=0)[:, None]
        if (got := 1 - k / (k - 1) * (1 - coefficient)) > best[1]:
            best = (centers, got)
    want = distances(best[0]).argmin(axis=1).tolist()
    frame = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "spike_id long, a double, b double").coalesce(1).cache()
    monkeypatch.setattr(catalogue, "_xy", lambda spark, sf_dir: frame)
    got = {r["spike_id"]: r["cluster"] for r in catalogue.QUERIES["fcm_cluster"](spark, SF).collect()}
    assert len(best[0]) == 6 and [got[i] for i in range(len(points))] == want


def test_transform_features_shuffles_no_row_a_dimension(spark):
    """Tasks are dealt by the number of rows, and rows become one for each dimension only where they are."""
    got = catalogue.QUERIES["transform_features"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning" in x and "dim#" in x.split("hashpartitioning")[1]]


def test_nearby_unsorted_reads_its_table_once(spark):
    """Sizes, limits and distances come from written tables; none of them reads the lineitems again."""
    found = catalogue.QUERIES["nearby_unsorted"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and not [f for f in found.inputFiles() if "lineitem" in f]
