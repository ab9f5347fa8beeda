"""Grades of hand-made clusters against direct formulas in NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveforge.operators import gradebook

TEMPLATE = [0.1, 0.5, 0.8, 0.3]


def test_spline_reproduces_cubics_and_has_no_jumps():
    for n in (2, 3, 4, 5, 32, 150):
        x = np.arange(n, dtype=float)
        c = [0.3, -1.2, 0.7, 2.0][4 - min(n, 4) :]
        y = np.polyval(c, x / n)
        fine = np.linspace(0, n - 1, 5000)
        assert np.allclose(gradebook.spline_matrix(n, 5000) @ y, np.polyval(c, fine / n), atol=1e-9), n
    r = np.random.default_rng(0)
    y = r.normal(0, 1, 12)
    s = gradebook.spline_matrix(12, 11 * 1000 + 1) @ y
    assert np.allclose(s[::1000], y, atol=1e-12)
    for order in (1, 2):  # derivatives from both sides of each sample
        step = np.diff(s, order) * 1000.0**order
        assert max(abs(step[1000 * k] - step[1000 * k - order]) for k in range(1, 11)) < 0.2
    third = np.diff(s, 3) * 1e9
    assert abs(third[1000 + 5] - third[1000 - 8]) < 1e-2 and abs(third[10000 + 5] - third[10000 - 8]) < 1e-2


def test_widths(spark):
    wave = [0.0, 0.0, 1.0, 4.0, 9.0, 4.0, 1.0, -2.0, -1.0, 0.0]
    rows = spark.createDataFrame([(1, wave), (2, [-1.0] * 10)], "g int, mean array<double>")
    got = {x["g"]: x["width"] for x in gradebook.widths(rows, "mean").collect()}
    s = gradebook.spline_matrix(10, 5000) @ np.array(wave)
    at = s.argmax()
    lo = max(i for i in range(at) if s[i] < 0.25 * s[at]) + 1
    hi = min(i for i in range(at, 5000) if s[i] < 0.25 * s[at]) - 1
    assert got == {1: pytest.approx(1250 * (hi - lo) / 5000, abs=1e-9), 2: 0.0}


def bhat(x, y):
    cx, cy = np.cov(x.T), np.cov(y.T)
    c = (cx + cy) / 2
    d = x.mean(0) - y.mean(0)
    return d @ np.linalg.inv(c) @ d / 8 + math.log(np.linalg.det(c) / math.sqrt(np.linalg.det(cx) * np.linalg.det(cy))) / 2


def mahal(y, x):
    a = y - x.mean(0)
    return np.einsum("ij,jk,ik->i", a, np.linalg.inv(np.cov(x.T)), a)


def best_mpc(x):
    c = np.vstack([x.mean(0), x[((x - x.mean(0)) ** 2).sum(1).argmin()] + 1e-5])
    before = None
    for _ in range(50):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        w = ((1 / d) / (1 / d).sum(1, keepdims=True)) ** 2
        c = w.T @ x / w.sum(0)[:, None]
        objective = (w * ((x[:, None] - c[None]) ** 2).sum(2)).sum()
        if before is not None and abs(objective - before) < 1e-5:
            break
        before = objective
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    return max(0.0, 1 - 2 * (1 - (((1 / d) / (1 / d).sum(1, keepdims=True)) ** 2).sum() / len(x)))


def test_all_grades(spark):
    r = np.random.default_rng(8)
    n, shape = 500, np.array([0, 0.1, 0.4, 1.0, 0.5, 0.0, -0.4, -0.2, 0.0, 0.0])
    owner = r.integers(0, 4, n)  # 0 is unsorted
    base = np.array([(60, 50, 55), (150, 60, 70), (80, 160, 60), (90, 80, 170)], float)
    tops = base[owner] + r.normal(0, 12, (n, 3))
    waves = tops[:, :, None] * shape + r.normal(0, 2, (n, 3, 10))
    peaks = waves[:, :, 3]
    ts = np.sort(r.integers(0, 10_000_000, n)).astype(float)
    rows = [("a", i, float(ts[i]), *(w.tolist() for w in waves[i]), *map(float, peaks[i])) for i in range(n)]
    rows += [("b", i, float(i), *([0.0] * 10 for _ in range(3)), 1.0, 2.0, 3.0) for i in range(5)]
    kinds = "rec string, item int, ts double, w1 array<double>, w2 array<double>, w3 array<double>, p1 double, p2 double, p3 double"
    members = [("a", int(owner[i]), i) for i in range(n) if owner[i]] + [("b", 1, 3)]
    thresholds = [45.0, 48.0, 40.0]
    spikes, held = spark.createDataFrame(rows, kinds).repartition(4), spark.createDataFrame(members, "rec string, cluster int, item int")
    found = {(x["rec"], x["cluster"]): x for x in gradebook.graded(spikes, held, ["rec"], "cluster", "item", "ts", ["w1", "w2", "w3"], ["p1", "p2", "p3"], thresholds, TEMPLATE).collect()}
    assert set(found) == {("a", 1), ("a", 2), ("a", 3), ("b", 1)}
    one = found["b", 1]
    assert (one["n"], one["mpc"], one["width"], one["wires"]) == (1, 0.0, 0.0, 0)
    loose = peaks[owner == 0]
    for c in (1, 2, 3):
        got, at = found["a", c], owner == c
        x, wire = peaks[at], c - 1
        want = {"n": at.sum(), "rate": at.sum() * 1e6 / (ts[-1] - ts[0]), "share": 2 * ts[at].std(ddof=1) / (ts[-1] - ts[0])}
        tail = lambda v: math.erfc(math.sqrt(v / 2)) + math.sqrt(2 * v / math.pi) * math.exp(-v / 2)
        want["lratio"] = np.mean([tail(v) for v in mahal(x, peaks[~at])])
        want["short_isi"] = np.mean(np.diff(ts[at]) * 1e-6 < 1e-3)
        want["iso"] = (x[:, wire].mean() - thresholds[wire]) ** 2 / x[:, wire].var(ddof=1)
        want["min_bhat"] = min(bhat(x, peaks[owner == o]) for o in (1, 2, 3) if o != c)
        want["bhat_unsorted"] = bhat(x, loose)
        under = loose[(loose < 1.5 * np.array(thresholds)).all(1)]
        want["bhat_mua"] = bhat(x, under) if len(under) > 0.5 * at.sum() else None
        own = mahal(x, x)
        near = loose[mahal(loose, x) < np.median(own) + 5 * own.std(ddof=1)]
        want["bhat_near"] = bhat(x, near) if len(near) > 0.2 * at.sum() else math.inf
        want["n_near"] = len(near)
        want["mpc"] = best_mpc(x)
        mean = waves[at][:, wire].mean(0)
        s = gradebook.spline_matrix(10, 5000) @ mean
        top = s.argmax()
        lo, hi = max([i for i in range(top) if s[i] < 0.25 * s[top]], default=-1) + 1, min([i for i in range(top, 5000) if s[i] < 0.25 * s[top]], default=5000) - 1
        want["width"] = 1250 * (hi - lo) / 5000
        m = mean - mean.mean()
        a = [(m[i : i + 4] @ TEMPLATE) ** 2 for i in range(7)]
        want["template"] = max(v / (m[i : i + 4] @ m[i : i + 4] - v) for i, v in enumerate(a))
        half = [i for i in range(10) if mean[i] >= 0.25 * mean.max()]
        v = waves[at][:, wire][:, half[0] : half[-1] + 1]
        v = v - v.mean(1, keepdims=True)
        u = mean[half] - mean[half].mean()
        want["snr"] = np.mean((v @ u) ** 2 / ((u @ u) * (v**2).sum(1)) < 0.7)
        want["wires"] = 3
        for k, w in want.items():
            assert got[k] == (w if w is None or math.isinf(w) else pytest.approx(w, rel=1e-7, abs=1e-9)), (c, k)
        assert got["valley"] and isinstance(got["final_grade"], int)


def test_no_members(spark):
    spikes = spark.createDataFrame([("a", 1, 2.0, [1.0, 2.0, 1.0, 0.0], 2.0)], "rec string, item int, ts double, w1 array<double>, p1 double")
    none = spark.createDataFrame([], "rec string, cluster int, item int")
    assert gradebook.graded(spikes, none, ["rec"], "cluster", "item", "ts", ["w1"], ["p1"], [1.0], [0.6, 0.8]).count() == 0
    assert gradebook.widths(spikes.select(F.lit(None).cast("array<double>").alias("m")), "m").first()["width"] in (0.0, None)
