"""Hand-made cases for the record sources, shapes, geometry, features and sorting; none of them comes from the SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveforge.operators import features, geometry, grading, moments, shapes, sorting
from waveforge.sources import records


def test_variation_takes_the_wire_of_the_highest_mean_peak(spark, monkeypatch):
    from waveforge.plans import catalogue

    # wire 2 is the larger one in most rows, wire 1 has the higher mean
    frame = spark.createDataFrame([(i, 0, 1, a, b) for i, (a, b) in enumerate([(1.0, 2.0), (1.0, 2.0), (10.0, 2.0)])], "spike_id long, ts_us long, cluster_id int, a double, b double")
    monkeypatch.setattr(catalogue, "_xy", lambda spark, sf_dir: frame)
    got = catalogue.QUERIES["peak_cv"](spark, "").first()
    assert got["wire"] == 1 and got["cv"] == pytest.approx(np.std([1, 1, 10], ddof=1) / 4, abs=1e-6)


def test_density_keeps_rows_of_full_cells(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.uniform(0, 300, (400, 2)), r.normal(150, 4, (300, 2)), [[0.0, 0.0], [300.0, 300.0]]])
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "item long, x double, y double")
    got = {r["item"] for r in geometry.density(frame, ["x", "y"]).collect()}
    bins = [30, 30]
    cell = np.stack([np.floor((x[:, d] - 0.0) / (300.0 / bins[d])).astype(int) for d in (0, 1)], axis=1)
    count = np.zeros((32, 32), int)
    np.add.at(count, tuple(cell.T), 1)
    w = [math.ceil(x[:, d].std(ddof=1) / 7) for d in (0, 1)]
    want = set()
    for i, (a, b) in enumerate(cell):
        reach = [slice(max(0, v - (n - 1 - n // 2)), v + n // 2 + 1) for v, n in zip((a, b), w, strict=True)]
        box = count[tuple(reach)]
        mean = box.sum() / (box > 0).sum()
        n = count[a, b]
        if (n > 1 or mean > 1) and n > 1.25 * mean:
            want.add(i)
    assert got == want and len(got) > 200
    assert geometry.density(frame.where("item < 0"), ["x", "y"]).count() == 0
    assert geometry.density(frame.withColumn("y", F.lit(1.0)), ["x", "y"]).count() == frame.count()


def test_geometry_equals_linear_algebra(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(0, 1, (60, 3)) @ r.normal(0, 1, (3, 3)) + 1e6, r.normal(1, 2, (50, 3)) + 1e6
    rows = [(0, 1, i, *map(float, v)) for i, v in enumerate(x)] + [(0, 2, 100 + i, *map(float, v)) for i, v in enumerate(y)]
    frame = spark.createDataFrame(rows, "g int, k int, i int, p double, q double, s double")
    dims = ["p", "q", "s"]
    table = moments.moments(frame, ["g", "k"], dims)
    got = {r["i"]: r["d"] for r in frame.join(geometry.factored(table, dims), ["g", "k"]).select("i", geometry.mahalanobis(dims).alias("d")).collect()}
    away = x - x.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", away, np.linalg.inv(np.cov(x.T)), away)
    assert np.allclose([got[i] for i in range(60)], want, rtol=1e-6)
    rest = {r["k"]: r for r in geometry.rest_moments(table, "g", "k", dims).collect()}
    assert rest[1]["c_p_q"] == pytest.approx(np.cov(y.T)[0, 1], rel=1e-6) and rest[1]["n"] == 50
    both = geometry.bhattacharyya(table.where("k = 1").join(geometry.named_other(table.where("k = 2"), ["g"]), "g"), dims).first()["bhat"]
    mean, d = (np.cov(x.T) + np.cov(y.T)) / 2, x.mean(axis=0) - y.mean(axis=0)
    assert both == pytest.approx(d @ np.linalg.inv(mean) @ d / 8 + math.log(np.linalg.det(mean) / math.sqrt(np.linalg.det(np.cov(x.T)) * np.linalg.det(np.cov(y.T)))) / 2, rel=1e-6)
    z = spark.createDataFrame([(0.0,), (0.3,), (1.0,), (2.5,)], "z double")
    assert np.allclose([r[0] for r in z.select(geometry.erfc(F.col("z"))).collect()], [math.erfc(v) for v in (0.0, 0.3, 1.0, 2.5)], atol=2e-7)
    assert [round(shapes.chi2_limit(0.99, d), 4) for d in (1, 2, 3, 4, 11)] == [6.6349, 9.2103, 11.3449, 13.2767, 24.725]


def test_half_peak_valley_and_representative_wire(spark):
    wave = [0.0, -1.0, 2.0, 4.0, 6.0, 3.0, 1.0, -2.0, -3.0, -1.0]
    got = spark.createDataFrame([(wave,), ([-1.0, -2.0, -1.0] + [-3.0] * 7,)], "w array<double>").select(grading.half_peak_range("w", 0.5).alias("h"), grading.valley_after_peak("w").alias("v"), shapes.first_valley("w", 0.0, only_left=True).alias("f")).collect()
    assert (tuple(got[0]["h"]), got[0]["v"], tuple(got[0]["f"])) == ((3, 5), True, (2, 1))
    assert tuple(got[1]["f"]) == (2, 1)
    a, b = [0.0] * 20, [0.0] * 20
    a[10], a[6], b[6] = 9.0, -1.0, 5.0  # wire 1 peaks highest, but wire 2 does at the valley before that
    rows = spark.createDataFrame([(a, b), (a, [0.0] * 20), (b, [v * 100 for v in b])], "w1 array<double>, w2 array<double>")
    assert [r[0] for r in rows.select(shapes.rep_wire(["w1", "w2"], [4.0, 4.0], [400.0, 400.0])).collect()] == [2, 1, 1]


def test_modes_headers_and_limits_of_records(spark):
    frame = spark.createDataFrame([(1, i, 1000 * i, [i, -i], [0, 0]) for i in range(1, 21)] + [(2, i, i, [1, 1], [40000, 1]) for i in range(1, 6)], "tetrode int, idx long, ts_us long, w1 array<int>, w2 array<int>")
    one = frame.where("tetrode = 1")
    assert [r["idx"] for r in records.select_records(one, "list", [9, 2, 77, 9]).orderBy("ord").collect()] == [9, 2, 9]
    assert records.select_records(one, "range", [5, 7], ["ts_us"]).columns == ["ord", "ts_us"]
    with pytest.raises(ValueError):
        records.select_records(one, "any")
    assert {r["tetrode"] for r in records.within_limits(frame, max_rate=2000.0).collect()} == {1}
    # the second wire of file 1 is not live, so it doesn't count; the wire of file 2 over full scale on one end only stays
    assert records.unsaturated(frame, ["w1", "w2"], admax=15, least=1).groupBy("tetrode").count().orderBy("tetrode").collect() == [(1, 14), (2, 5)]
    lines = spark.createDataFrame([("f", 0, "-InputRange 300 200"), ("f", 1, "-ThreshVal  40"), ("f", 2, "-ADMaxValue 9"), ("g", 0, "-Other")], "file string, line_no int, line string")
    got = {r["file"]: r for r in records.parse_headers(lines).collect()}
    assert got["f"]["admax"] == 32767 and got["f"]["input_range"] == [300.0, 200.0] and got["f"]["threshold"] == [40.0] and got["f"]["bitvolts"][0] == pytest.approx(300 / 1e6 / 32767)
    assert got["g"]["bitvolts"] == [6e-9] and got["g"]["threshold"] is None


def test_sinks_read_back(spark, tmp_path):
    frame = spark.createDataFrame([("s", 1, 0.5, [1] * 32), ("s", 2, 0.25, [2] * 32), ("t", 1, 0.75, [3] * 32)], "session string, tetrode int, ts_s double, w1 array<int>")
    records.save_output(frame, str(tmp_path / "out"))
    assert records.read_output(spark, str(tmp_path / "out"), "s").count() == 2
    records.write_records(frame, str(tmp_path / "rec"), ["w1"])
    records.write_records(frame, str(tmp_path / "rec"), ["w1"], append=True)
    assert spark.read.parquet(str(tmp_path / "rec")).count() == 6
    with pytest.raises(ValueError):
        records.write_records(frame, str(tmp_path / "no"), ["w1", "w1", "w1"])
    with pytest.raises(Exception, match="32 samples"):
        records.write_records(frame.withColumn("w1", F.array(F.lit(1))), str(tmp_path / "no"), ["w1"])


def test_features_equal_numpy(spark):
    r = np.random.default_rng(3)
    w1, w2 = (r.normal(0, 1, (80, 2)) @ r.normal(0, 1, (2, 12)) + r.normal(0, 0.05, (80, 12)) for _ in range(2))
    frame = spark.createDataFrame([(i % 2, i, w1[i].tolist(), w2[i].tolist()) for i in range(80)], "tetrode int, spike_id long, w1 array<double>, w2 array<double>")
    got = {r["spike_id"]: r["features"] for r in features.spike_features(frame, "tetrode", "spike_id", ["w1", "w2"]).collect()}
    for t in (0, 1):
        at, columns, peaks = np.arange(t, 80, 2), [], []
        turned = lambda v: v * np.sign(v[np.abs(v).argmax()])
        for w in (w1[at], w2[at]):
            places = w.argmax(axis=1)
            peaks.append(w[:, np.bincount(places).argmax()])
            bare = w - w.mean(axis=1, keepdims=True)
            columns.append(w @ turned(np.linalg.eigh(bare.T @ bare)[1][:, -1]))
        p = np.stack(peaks, axis=1)
        columns.append((p - p.mean(axis=0)) @ turned(np.linalg.eigh(np.cov(p.T))[1][:, -1]))
        assert np.allclose([got[i] for i in at], np.column_stack([p, *columns]), atol=1e-8)
    assert features.feature_lines(frame, "tetrode", "spike_id", ["w1", "w2"]).where("ord = -1").first()["line"] == "6"


def test_passes_and_empty_tables(spark):
    assert shapes.pass_thresholds(1) == [] and shapes.pass_thresholds(5) == [2.0, 2.0 - 2 / 3, 2.0 - 4 / 3, 0.0]
    empty = spark.createDataFrame([], "spike_id long, a double, b double, cluster_id int")
    assert shapes.passes(empty.withColumn("score", F.col("a")), "score", 5).count() == 0
    assert shapes.overlap_test(empty, ["cluster_id"], "a").count() == 0
