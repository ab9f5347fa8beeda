"""Refinement of hand-made clusters against a direct walk in NumPy, each branch by a cluster of its own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveforge.operators import refinement, shapes, steps


def usable(x):
    return np.array([len(np.unique(x[:, d])) >= 0.05 * len(x) for d in range(x.shape[1])], bool)


def mahal(y, x):
    c = np.atleast_2d(np.cov(x.T))
    a = y - x.mean(0)
    return np.einsum("ij,jk,ik->i", a, np.linalg.inv(c), a)


def rate(x, other):
    if not len(other):
        return 0.0
    z = np.abs(x - other.mean()) / other.std(ddof=1)
    return np.mean([math.erfc(v / math.sqrt(2)) for v in z])


def tail(x, d):
    h, a = x / 2, d / 2
    return 1.0 if x == 0 else max(0.0, 1 - math.fsum(math.exp(-h + (a + n) * math.log(h) - math.lgamma(a + n + 1)) for n in range(300))) if h < 60 else 0.0


def core(x, items):
    y = x[items][:, usable(x[items])]
    order = np.argsort(mahal(y, y), kind="stable")
    n = len(items)
    k = min(math.floor(0.6 * n + 0.5), max(200, math.floor(0.3 * n + 0.5)))
    return [items[i] for i in order[:k]]


def valley(f):
    v = [i for i in range(1, len(f) - 1) if f[i] < f[i - 1] and f[i] <= f[i + 1]]
    p = [i for i in range(1, len(f) - 1) if f[i] > f[i - 1] and f[i] >= f[i + 1]]
    start = 0 if not p or (v and v[0] < p[0]) else p[0]
    later = [i for i in v if i > start]
    return later[0] if later else None


def expand(x, own, only_peaks, n_std):
    rest = np.setdiff1d(np.arange(len(x)), own)
    if not only_peaks:
        x = x[:, usable(x[rest])]
    x = x[:, usable(x[own])]
    keep = np.array([1 - rate(x[own, d], x[rest, d]) for d in range(x.shape[1])])
    x = x[:, keep > 0] * keep[keep > 0]
    m = mahal(x, x[own])
    limit = shapes.chi2_limit(0.99, x.shape[1]) * 15
    near = m[m < limit]
    bins = math.floor(limit * 0.25 + 0.5)
    width = (near.max() - near.min()) / bins
    counts = np.bincount(np.minimum(bins - 1, np.floor((near - near.min()) / width)).astype(int), minlength=bins)
    smooth = [np.mean(counts[i - r : i + r + 1]) for i in range(bins) for r in [min(2, i, bins - 1 - i)]]
    at = valley(smooth)
    if at is None:
        return []
    inside = np.flatnonzero(m < near.min() + (at + 0.5) * width)
    if len(inside) < x.shape[1]:
        return list(own)
    d = mahal(x[inside], x[inside])
    return inside[d < np.median(d) + n_std * d.std(ddof=1)].tolist()


def refine(x, peaks, items, bad):
    if not usable(peaks[items]).any():
        return [], None
    first = expand(x, core(x, items), False, 1.0)
    if not first:
        return [], None
    rest = np.setdiff1d(np.arange(len(x)), first)
    rating = np.mean([tail(v, peaks.shape[1]) for v in mahal(peaks[first], peaks[rest])])
    if rating >= 0.05:
        return first, "features"
    inner = core(x, core(x, first))
    second = expand(peaks, inner, True, 2.5)
    if not second:
        return [], None
    return (first, "backup") if bad else (second, "peaks")


def recording(seed, constant=False):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal((0, 0, 0), 1, (400, 3)), r.normal((70, 30, 3), 1.1, (150, 3)), r.normal((2.5, -9, 12), 0.9, (260, 3)), r.normal((5, -2, 4), 6, (350, 3))])
    peaks = np.column_stack([x[:, 0] * 10 + r.normal(0, 1, len(x)), x[:, 1] * 8 + x[:, 2] * 3 + r.normal(0, 1, len(x))])
    if constant:
        peaks[:400] = (5.0, 7.0)
    owner = np.repeat([1, 2, 3, 4], [400, 150, 260, 350])
    clusters = {c: sorted(set(np.flatnonzero(owner == c).tolist()) | set(r.choice(len(x), 12, replace=False).tolist()) if c != 1 or not constant else np.flatnonzero(owner == c).tolist()) for c in (1, 2, 3, 4)}
    return x, peaks, clusters


RECORDINGS = {"a": recording(1), "b": recording(2, constant=True)}
BAD = {("a", 2)}


def frames(spark, recordings):
    rows = [(n, i, *map(float, x[i]), *map(float, p[i])) for n, (x, p, _) in recordings.items() for i in range(len(x))]
    members = [(n, c, i) for n, (_, _, clusters) in recordings.items() for c, items in clusters.items() for i in items]
    kinds = "rec string, item int, f0 double, f1 double, f2 double, p0 double, p1 double"
    return spark.createDataFrame(rows, kinds).repartition(4), spark.createDataFrame(members, "rec string, cluster int, item int").repartition(3)


def flagged(inside, peaks):
    one = F.struct(F.get_json_object("g", "$.rec").alias("rec"), F.get_json_object("g", "$.cluster").cast("int").alias("cluster"))
    hit = F.lit(False)
    for n, c in BAD:
        hit = hit | ((one["rec"] == n) & (one["cluster"] == c))
    return inside.select("g").distinct().withColumn("bad", hit)


def test_each_branch_equals_a_direct_walk(spark):
    rows, members = frames(spark, RECORDINGS)
    got, branch = {}, {}
    for r in refinement.refined(rows, members, ["rec"], "cluster", "item", ["f0", "f1", "f2"], ["p0", "p1"], steps.Stages(spark), flagged).collect():
        got.setdefault((r["rec"], r["cluster"]), set()).add(r["item"])
        branch[r["rec"], r["cluster"]] = r["branch"]
    want = {}
    for n, (x, p, clusters) in RECORDINGS.items():
        for c, items in clusters.items():
            found, way = refine(x, p, items, (n, c) in BAD)
            if found:
                want[n, c] = (set(found), way)
    assert branch == {k: w for k, (_, w) in want.items()}
    assert got == {k: v for k, (v, _) in want.items()}
    assert set(branch.values()) == {"features", "peaks", "backup"} and ("b", 1) not in got


def test_several_modes_are_bad(spark):
    r = np.random.default_rng(5)
    one, two = r.normal(0, 1, (600, 2)), np.concatenate([r.normal(-5, 1, (400, 2)), r.normal(5, 1, (400, 2))])
    turned = np.column_stack([two[:, 0] * 0 + r.normal(0, 1, 800), two[:, 1]])
    inside = spark.createDataFrame([(g, *map(float, v)) for g, x in (("one", one), ("two", two), ("turned", turned)) for v in x], "g string, p0 double, p1 double")
    assert {x["g"]: x["bad"] for x in refinement.bad_clusters(inside, ["p0", "p1"]).collect()} == {"one": False, "two": True, "turned": True}


def test_final_fill(spark):
    x, p, clusters = RECORDINGS["a"]
    cases = {"a": (x, p, clusters | {9: list(range(24))})}
    rows, members = frames(spark, cases)
    got = {}
    for r in refinement.finalized(rows, members, ["rec"], "cluster", "item", ["p0", "p1"], steps.Stages(spark)).collect():
        got.setdefault(r["cluster"], set()).add(r["item"])
    want = {}
    for c, items in clusters.items():
        own = p[items]
        inverse = np.linalg.inv(np.cov(own.T, bias=True))
        m = np.einsum("ij,jk,ik->i", p - own.mean(0), inverse, p - own.mean(0))
        want[c] = set(items) | set(np.flatnonzero(m < np.median(m[items]) + m[items].std(ddof=1)).tolist())
    assert got == want


def test_complement_from_moments(spark):
    x, p, clusters = RECORDINGS["a"]
    rows, members = frames(spark, {"a": RECORDINGS["a"]})
    inside = members.withColumn("g", refinement.group(["rec"], "cluster")).join(rows, ["rec", "item"])
    got = {r["g"]: r for r in refinement.complement(rows, inside, ["rec"], ["p0", "p1"]).collect()}
    for c, items in clusters.items():
        rest, r = p[np.setdiff1d(np.arange(len(p)), items)], got[f'{{"rec":"a","cluster":{c}}}']
        assert r["n"] == len(rest) and r["mu_p0"] == pytest.approx(rest[:, 0].mean(), rel=1e-10)
        assert [r["c_p0_p0"], r["c_p0_p1"], r["c_p1_p1"]] == pytest.approx(np.cov(rest.T)[[0, 0, 1], [0, 1, 1]].tolist(), rel=1e-9)


def test_empty_tables(spark):
    rows, members = frames(spark, {"a": RECORDINGS["a"]})
    for some, none in ((rows, members.limit(0)), (rows.limit(0), members)):
        assert refinement.refined(some, none, ["rec"], "cluster", "item", ["f0", "f1", "f2"], ["p0", "p1"], steps.Stages(spark)).count() == 0
        assert refinement.finalized(some, none, ["rec"], "cluster", "item", ["p0", "p1"], steps.Stages(spark)).count() == 0
