"""The overlap fold against a direct loop over the pairs of clusters."""

import math

import numpy as np
import pytest

from waveforge.operators import overlaps


def usable(x):
    return [len(np.unique(x[:, d])) >= 0.05 * len(x) for d in range(x.shape[1])]


def rate(x, reference):
    if len(reference) == 0:
        return 0.0
    if len(reference) == 1 or reference.std() == 0:
        return math.nan
    z = np.abs(x - reference.mean()) / reference.std(ddof=1)
    return float(np.mean([math.erfc(v / math.sqrt(2)) for v in z]))


def distances(x, reference):
    if x.shape[1] == 0 or len(reference) < x.shape[1]:
        return np.zeros(len(x))
    with np.errstate(all="ignore"):
        c = np.atleast_2d(np.cov(reference.T)) if len(reference) > 1 else np.zeros((x.shape[1],) * 2)
        if abs(np.linalg.det(c)) < 1e-300:
            return np.full(len(x), np.nan)
        away = x - reference.mean(0)
        return np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away)


def direct(data, clusters, share=0.65):
    """Cluster number -> set of items, settled one pair after another."""
    cf = {k: set(v) for k, v in clusters.items()}
    order = sorted(cf)
    for i, k in enumerate(order):
        for m in order[i + 1 :]:
            both = sorted(cf[k] & cf[m])
            if not both:
                continue
            own_k, own_m = sorted(cf[k] - cf[m]), sorted(cf[m] - cf[k])
            x, xk, xm = (np.array([data[j] for j in part], float).reshape(len(part), -1 if part else len(data[both[0]])) for part in (both, own_k, own_m))
            keep = [d for d in range(x.shape[1]) if (not own_k or usable(xk)[d]) and (not own_m or usable(xm)[d])]
            xk, xm, x = xk[:, keep].copy(), xm[:, keep].copy(), x[:, keep]
            for d in range(len(keep)):
                rk, rm = rate(x[:, d], xk[:, d]), rate(x[:, d], xm[:, d])
                xk[:, d] *= 1 - rk
                xm[:, d] *= 1 - rm
            if len(xk) < len(keep) or len(xm) < len(keep):
                dk = dm = np.zeros(len(x))
            else:
                dk, dm = distances(x, xk), distances(x, xm)
            if len(both) > share * min(len(cf[k]), len(cf[m])):
                whole = cf[k] | cf[m]
                if (dk < dm).sum() > (dm < dk).sum():
                    cf[k], cf[m] = whole, set()
                else:
                    cf[k], cf[m] = set(), whole
                    break
            else:
                cf[k] = set(own_k) | {j for j, a, b in zip(both, dk, dm, strict=True) if a < b}
                cf[m] = set(own_m) | {j for j, a, b in zip(both, dk, dm, strict=True) if b < a}
    return {(k, j) for k, v in cf.items() for j in v}


def recording(seed, n_clusters, reach, dims=2, singular=False):
    """Items around centres on a line; a cluster holds its own and those of its neighbours within reach."""
    r = np.random.default_rng(seed)
    centres = np.arange(n_clusters)[:, None] * np.array([6.0, 1.5, -2.0, 3.0])[:dims]
    data = np.concatenate([c + r.normal(0, 1.5, (60 + 10 * i, dims)) for i, c in enumerate(centres)])
    owner = np.repeat(np.arange(n_clusters), [60 + 10 * i for i in range(n_clusters)])
    if singular:
        data[:, 1] = np.round(data[:, 1] / 50)
    clusters = {}
    for c in range(n_clusters):
        d = np.linalg.norm(data - centres[c], axis=1)
        clusters[c + 1] = {j for j in range(len(data)) if owner[j] == c or d[j] < reach * r.uniform(0.6, 1.4)}
    return [tuple(map(float, x)) for x in data], clusters


CASES = {
    "chain of five": recording(1, 5, 5.0),
    "three that merge": recording(2, 3, 14.0),
    "four, some merge": recording(3, 4, 8.0),
    "far apart": recording(4, 3, 0.1),
    "singular": recording(5, 3, 6.0, singular=True),
    "four dimensions": recording(6, 4, 7.0, dims=4),
}


def settle(spark, cases, dims, parts=3):
    names = [f"x{i}" for i in range(dims)]
    rows = [(name, k, j, *data[j]) for name, (data, clusters) in cases.items() for k, items in clusters.items() for j in items]
    frame = spark.createDataFrame(rows + rows[:3], "rec string, cluster int, item int, " + ", ".join(f"{x} double" for x in names)).repartition(parts)
    return {(r["rec"], r["cluster"], r["item"]) for r in overlaps.settled(frame, ["rec"], "cluster", "item", names).collect()}


def test_all_recordings_at_once(spark):
    cases = {k: v for k, v in CASES.items() if k != "four dimensions"}
    want = {(name, *x) for name, (data, clusters) in cases.items() for x in direct(data, clusters)}
    assert settle(spark, cases, 2) == want
    assert len({(n, k) for n, k, _ in want if n == "three that merge"}) < 3
    assert len({k for n, k, _ in want if n == "chain of five"}) == 5


def test_four_dimensions(spark):
    cases = {"four dimensions": CASES["four dimensions"]}
    assert settle(spark, cases, 4, 1) == {("four dimensions", *x) for x in direct(*CASES["four dimensions"])}


@pytest.mark.parametrize("clusters", [{1: {0, 1, 2}, 2: {0, 1, 2}}, {1: {0, 1, 2, 3, 4, 5, 6, 7}, 2: {0}}, {1: {0, 1, 2, 3, 4, 5}, 2: {5, 6, 7, 8, 9, 10}}, {1: set(range(20)), 2: {19, *range(30, 50)}, 3: {49, 0, *range(60, 90)}}])
def test_few_other_items(spark, clusters):
    data = [(float(i * 7 % 11), float(i * i % 13)) for i in range(100)]
    got = settle(spark, {"r": (data, clusters)}, 2)
    assert got == {("r", *x) for x in direct(data, clusters)}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "rec string, cluster int, item int, x0 double")
    assert overlaps.settled(frame, ["rec"], "cluster", "item", ["x0"]).count() == 0


def test_two_other_items_in_two_dimensions_make_neither_nearer(spark):
    """Their covariance is singular but for rounding, which must not choose the winner: without a vote it is the second cluster."""
    r = np.random.default_rng(8)
    rows = []
    for t in range(40):
        x = np.round(r.uniform([1, 1], [50, 100], (62, 2)), 3)
        rows += [(t, "A", i, *map(float, x[i])) for i in range(60)] + [(t, "N", i, *map(float, x[i])) for i in range(30, 62)]
    frame = spark.createDataFrame(rows, "t int, c string, item long, p1 double, p2 double")
    got = overlaps.settled(frame, ["t"], "c", "item", ["p1", "p2"]).select("t", "c").distinct().collect()
    assert sorted(map(tuple, got)) == [(t, "N") for t in range(40)]
