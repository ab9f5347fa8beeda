"""Spike files: written, read in all modes, split at record borders, and compared byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveforge.sources import recordfiles, records

r = np.random.default_rng(6)
N = 500
WAVES = r.integers(-32768, 32768, (N, 4, 32))
TS = np.sort(r.integers(1, 1 << 50, N))


def frame(spark, wires=4):
    rows = [(i, int(TS[i]), i % 7, i % 3, [int(v) for v in range(i, i + 8)], WAVES[i, :wires].tolist()) for i in range(N)]
    return spark.createDataFrame(rows, "at int, ts_us long, sc int, cell int, features array<int>, waves array<array<int>>").repartition(6)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/rec"


@pytest.mark.parametrize("kind, wires", [("nse", 1), ("nst", 2), ("ntt", 4)])
def test_round_trip_and_bytes(spark, folder, tmp_path, kind, wires):
    recordfiles.write(frame(spark, wires), folder, kind, ["at"], header="######## x\n-ADMaxValue 100\n")
    got = sorted(recordfiles.read(spark, folder).collect(), key=lambda x: x["idx"])
    assert [x["idx"] for x in got] == list(range(1, N + 1)) and [x["ts_us"] for x in got] == TS.tolist()
    assert [x["waves"] for x in got] == WAVES[:, :wires].tolist()
    assert all((x["sc"], x["cell"], x["features"]) == (i % 7, i % 3, list(range(i, i + 8))) for i, x in enumerate(got))
    raw = b"".join(f.read_bytes()[16384:] for f in sorted((tmp_path / "rec").iterdir()) if f.suffix == f".{kind}")
    size = 48 + 64 * wires
    assert len(raw) == N * size
    for i in (0, 1, N - 1):  # sample by sample, wire by wire
        ts, sc, cell, *rest = struct.unpack(f"<QII8i{32 * wires}h", raw[i * size : (i + 1) * size])
        assert (ts, sc, cell, rest[:8]) == (TS[i], i % 7, i % 3, list(range(i, i + 8)))
        assert rest[8:] == [int(WAVES[i, w, s]) for s in range(32) for w in range(wires)]
    lines = recordfiles.headers(spark, folder).collect()
    assert {(x["line_no"], x["line"]) for x in lines} == {(0, "######## x"), (1, "-ADMaxValue 100")}
    assert records.parse_headers(recordfiles.headers(spark, folder)).first()["admax"] == 100.0


def test_modes(spark, folder):
    recordfiles.write(frame(spark), folder, "ntt", ["at"])
    idx = lambda mode, values: [x["idx"] for x in recordfiles.read(spark, folder, mode, values, ["idx"]).orderBy("ord").collect()]
    t = TS.tolist()
    assert idx("range", [100, 120]) == list(range(100, 121)) and idx("range", [490, 9999]) == list(range(490, N + 1)) and idx("range", [5, 4]) == []
    assert idx("list", [7, 3, 9999, 3]) == [7, 3, 3]
    assert idx("ts_range", [t[10], t[20]]) == [i + 1 for i, v in enumerate(t) if t[10] <= v <= t[20]]
    assert idx("ts_list", [t[5], t[99], 0]) == [i + 1 for i, v in enumerate(t) if v in (t[5], t[99])]
    only = recordfiles.read(spark, folder, "range", [3, 4], ["ts_us"])
    assert only.columns == ["ord", "ts_us"] and [x["ts_us"] for x in only.orderBy("ord").collect()] == t[2:4]


def test_ranges_leave_splits_unread(folder, spark):
    recordfiles.write(frame(spark).coalesce(1), folder, "ntt", ["at"])
    reader = recordfiles.Reader({"path": folder, "split": "50", "first": "101", "last": "130"}, ["idx", "waves"])
    splits = reader.partitions()
    assert sum(s.many for s in splits) <= 200 and all(s.before + s.first < 130 and s.before + s.first + s.many >= 101 for s in splits)
    found = [i for s in splits for b in reader.read(s) for i in b.column("idx").to_pylist()]
    assert found == list(range(101, 131))
    pushed = recordfiles.PushedReader({"path": folder}, ["idx"])
    left = list(pushed.pushFilters([recordfiles.GreaterThan(("idx",), 10), recordfiles.LessThanOrEqual(("idx",), 12), recordfiles.EqualTo(("cell",), 1)]))
    assert [f.attribute for f in left] == [("cell",)] and pushed.idx == [11, 12]


def test_filters_are_pushed_down(spark, folder):
    recordfiles.write(frame(spark), folder, "ntt", ["at"])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(recordfiles.SpikeFiles)
        found = spark.read.format("spikefile").options(fields="idx,ts_us,cell", push="true").load(folder).where("idx > 10 and idx <= 40 and cell = 1")
        assert sorted(x["idx"] for x in found.collect()) == [i + 1 for i in range(N) if 10 < i + 1 <= 40 and i % 3 == 1]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_append_overwrite_times_alone_and_incomplete_records(spark, folder, tmp_path):
    recordfiles.write(frame(spark), folder, "ntt", ["at"])
    recordfiles.write(frame(spark).where("at < 30"), folder, "ntt", ["at"], append=True)
    got = recordfiles.read(spark, folder, fields=["idx", "ts_us"]).orderBy("idx").collect()
    assert [x["ts_us"] for x in got] == TS.tolist() + TS[:30].tolist()
    recordfiles.write(frame(spark).select("at", "ts_us"), folder, "nts", ["at"])
    got = recordfiles.read(spark, folder).orderBy("idx").collect()
    assert [x["ts_us"] for x in got] == TS.tolist() and got[0]["waves"] is None
    last = sorted((tmp_path / "rec").glob("*.nts"))[-1]
    last.write_bytes(last.read_bytes()[:-3])
    assert recordfiles.read(spark, folder, fields=["idx"]).count() == N - 1
    assert not [f for f in (tmp_path / "rec").iterdir() if f.name.startswith("_")]


def test_wrong_shapes_leave_nothing_behind(spark, folder, tmp_path):
    odd = frame(spark, 2)
    with pytest.raises(Exception, match="must hold 4 x 32"):
        recordfiles.write(odd, folder, "ntt", ["at"])
    assert not [f for f in (tmp_path / "rec").glob("*") if not f.name.startswith(".")]
    with pytest.raises(Exception, match="beyond their width"):
        recordfiles.write(frame(spark).withColumn("waves", F.transform("waves", lambda w: F.transform(w, lambda x: x + 40000))), folder, "ntt", ["at"])
    assert recordfiles.read(spark, folder).count() == 0


def test_older_selections(spark):
    rows = spark.createDataFrame([(i, i * 10) for i in range(1, 8)], "idx long, ts_us long")
    ids = lambda *a: [x["idx"] for x in recordfiles.legacy_selection(rows, *a).orderBy("ord").collect()]
    assert ids("range", [0, 2]) == [1, 2, 3] and ids("list", [1, 5]) == [2, 6] and ids("all", None, 3) == [1, 2, 3]
    with pytest.raises(ValueError, match="must rise"):
        ids("list", [5, 1])
