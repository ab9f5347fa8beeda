"""Outputs read back by time, comparisons of two sortings, and the statistics over them."""

import math

import numpy as np
import pytest

from waveforge.operators import comparison


def test_nearest_spike_of_the_own_recording(spark):
    spikes = spark.createDataFrame([("a", 1, 1000), ("a", 2, 1800), ("a", 3, 9000), ("b", 4, 1000), ("b", 5, 700_000)], "rec string, item int, ts long")
    rows = [("a", 1, 0.0014), ("a", 2, 0.0081), ("a", 2, 0.0079), ("a", 3, 0.02), ("b", 1, 0.0018), ("a", 0, 0.001), ("a", 4, 0.0018), ("a", 4, 0.0018)]
    output = spark.createDataFrame(rows, "rec string, cluster int, ts_s double")
    got = {tuple(r) for r in comparison.members_at(output, spikes, ["rec"], "cluster", "item", "ts", 1000).collect()}
    # the first is as far from both of its neighbours: the earlier one
    assert got == {("a", 1, 1), ("a", 2, 3), ("b", 1, 4), ("a", 4, 2)}
    assert comparison.members_at(output.limit(0), spikes, ["rec"], "cluster", "item", "ts", 1000).count() == 0


def bhat(x, y):
    cx, cy = np.cov(x.T), np.cov(y.T)
    c = (cx + cy) / 2
    d = x.mean(0) - y.mean(0)
    return d @ np.linalg.inv(c) @ d / 8 + math.log(np.linalg.det(c) / math.sqrt(np.linalg.det(cx) * np.linalg.det(cy))) / 2


def test_comparison(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal((0, 0), 1, (200, 2)), r.normal((9, 3), 1, (150, 2))])
    spikes = spark.createDataFrame([(n, i, *map(float, v)) for n in "ab" for i, v in enumerate(x)], "rec string, item int, p1 double, p2 double")
    manual = {1: range(0, 190), 2: range(205, 350)}
    auto = {1: range(190, 350), 2: range(0, 100)}
    frame = lambda sets, recs: spark.createDataFrame([(n, c, i) for n in recs for c, items in sets.items() for i in items], "rec string, cluster int, item int")
    got = comparison.compared(spikes, frame(manual, "ab"), frame(auto, "a"), ["rec"], "item", ["p1", "p2"]).collect()
    assert len(got) == 6
    for q in got:
        if q["rec"] == "b":
            assert q["auto"] is None and q["bhat"] is None and not q["found"]
            continue
        m, a = (list(s[q[k]]) for s, k in ((manual, "manual"), (auto, "auto")))
        assert q["bhat"] == pytest.approx(bhat(x[m], x[a]), rel=1e-8) and q["common"] == len(set(m) & set(a))
        assert q["found"] == any(bhat(x[m], x[list(s)]) < 1 for s in auto.values())


def test_statistics(spark):
    #        cluster, n, grade, confidence, partners' distances
    manual = [(1, 300, 5, 1.0), (2, 199, 5, 1.0), (3, 300, 4, 1.0), (4, 300, 4, 0.5), (5, 300, 2, 1.0), (6, 10, 1, 1.0), (7, 500, -3, 1.0), (8, 300, 3, 1.0), (9, 250, 1, 1.0)]
    auto = [(1, 3), (2, 2)]
    near = {1: (0.2, 3.0), 2: (0.1, 2.0), 3: (2.0, 0.3), 4: (0.1, 0.2), 5: (0.7, 0.9), 6: (3.0, 0.4), 7: (0.1, 0.1), 8: (0.75, 0.8), 9: (5.0, 5.0)}
    pairs = spark.createDataFrame([("a", m, a, 0, b, True) for m, ds in near.items() for a, b in enumerate(ds, 1)] + [("c", 1, None, 0, None, False)], "rec string, manual int, auto int, common long, bhat double, found boolean")
    mine = spark.createDataFrame([("a", *m) for m in manual] + [("c", 1, 400, 5, 1.0)], "rec string, cluster int, n long, final_grade int, confidence double")
    theirs = spark.createDataFrame([("a", *m) for m in auto], "rec string, cluster int, final_grade int")
    got = {q["grade"]: (q["clusters"], q["found"]) for q in comparison.found_statistics(pairs, mine, theirs, ["rec"]).collect()}
    assert got == {"g5": (2, 1), "g4": (2, 1), "g3": (1, 0), "g2": (1, 1), "g1": (2, 1), "artifacts": (1, 0), "good": (2, 1), "medium": (2, 1), "bad": (2, 1)}


def test_regrading(spark):
    r = np.random.default_rng(7)
    tops = np.concatenate([r.normal((80, 200), 6, (150, 2)), r.normal((260, 90), 6, (150, 2)), r.uniform(40, 300, (80, 2))])
    shape = np.array([0, 0.2, 1.0, 0.4, -0.3, 0.0])
    rows = [("a", i, 5000 * i, *((t * shape + r.normal(0, 1, 6)).tolist() for t in v)) for i, v in enumerate(tops)]
    spikes = spark.createDataFrame([(*x, x[3][2], x[4][2]) for x in rows], "rec string, item int, ts long, w1 array<double>, w2 array<double>, p1 double, p2 double")
    label = lambda sets: spark.createDataFrame([("a", c, 5000 * i / 1e6 + 1e-4) for c, items in sets.items() for i in items], "rec string, cluster int, ts_s double")
    auto, manual = label({1: range(0, 140), 2: range(150, 300)}), label({1: range(150, 290), 2: range(0, 150)})
    mine, theirs, pairs, stats = comparison.regraded(auto, manual, spikes, ["rec"], "item", "ts", ["w1", "w2"], ["p1", "p2"], [40.0, 40.0], [0.3, 0.9, 0.3])
    assert {(q["cluster"], q["n"]) for q in mine.collect()} == {(1, 140), (2, 150)} and {(q["cluster"], q["n"]) for q in theirs.collect()} == {(1, 140), (2, 150)}
    assert {(q["manual"], q["auto"]) for q in pairs.where("bhat < 1").collect()} == {(1, 2), (2, 1)} and pairs.where("found").count() == 4
    assert stats.agg({"clusters": "sum"}).first()[0] >= 2
