"""Grouped fits and the recursion against direct loops in NumPy, in tasks and over all tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveforge.operators import cores, steps


def naive_u(x, centers):
    u = np.zeros((len(x), len(centers)))
    for i, row in enumerate(x):
        d = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centers]
        zero = [j for j, v in enumerate(d) if v == 0]
        for j in range(len(centers)):
            u[i, j] = (j in zero) / len(zero) if zero else (1 / d[j]) / sum(1 / v for v in d)
    return u


def naive_fit(x, centers):
    before, u = None, naive_u(x, centers)
    for _ in range(50):
        w = u**2
        centers = np.array([(w[:, j][:, None] * x).sum(0) / w[:, j].sum() for j in range(len(centers))])
        objective = sum(w[i, j] * ((x[i] - centers[j]) ** 2).sum() for i in range(len(x)) for j in range(len(centers)))
        u = naive_u(x, centers)
        if before is not None and abs(objective - before) < 1e-5:
            break
        before = objective
    return centers, (u**2).sum() / len(x), u


def naive_best(x, k_max):
    centers, best = x.mean(0)[None], (None, 0.0, None)
    if len(np.unique(x, axis=0)) == 1:
        return 1, 0.0, None
    for k in range(2, k_max + 1):
        d = sum(((x - c) ** 2).sum(1) for c in centers)
        centers, p, u = naive_fit(x, np.vstack([centers, x[d.argmin()] + 1e-5]))
        mpc = 1 - k / (k - 1) * (1 - p)
        if mpc > best[1]:
            best = (centers, mpc, u)
    return (len(best[0]) if best[0] is not None else 1), best[1], best[2]


def naive_redundant(x, fits, weights):
    dims = {}
    for d, (k, mpc, u) in enumerate(fits):
        if weights[d]:
            dims.setdefault(k, []).append((d, mpc, [set(np.flatnonzero(u[:, j] == u.max(1))) for j in range(k)]))
    for group in dims.values():
        for i, (d, mpc, own) in enumerate(group):
            if weights[d] == 0:
                continue
            for e, other, theirs in group[i + 1 :]:
                table = [[(len(a & b) / len(a), len(a & b) / len(b)) for b in theirs] for a in own]
                fit = min(min(max(row[j][way] for row in table) for j in range(len(theirs))) for way in (0, 1))
                if fit > 0.9:
                    if mpc < other:
                        weights[d] = 0
                        break
                    weights[e] = 0
    return weights


def naive_loop(x, depth=5, drop_redundant=False):
    clusters = [(list(range(len(x))), True)]
    for level in range(depth):
        nxt = []
        for items, open_ in clusters:
            if not open_:
                nxt.append((items, False))
                continue
            if len(items) < 50:
                continue
            rows = x[items]
            fits = [naive_best(rows[:, d : d + 1], 4) for d in range(x.shape[1])]
            weights = [(k - 1) ** 2 if mpc >= 0.75 else 0 for k, mpc, _ in fits]
            if drop_redundant:
                weights = naive_redundant(rows, fits, weights)
            if not any(weights):
                nxt.append((items, False))
                continue
            k, _, u = naive_best(rows * np.array(weights), 4 if level else 6)
            if u is None:
                continue
            for j in range(k):
                own = [items[i] for i in np.flatnonzero(np.isclose(u[:, j], u.max(1), rtol=0, atol=0))]
                if len(own) >= 50:
                    nxt.append((own, len(own) < len(items)))
        clusters = nxt
    return [set(c) for c, _ in clusters]


def planted(seed, centres, n=70, dims=3, spread=0.6):
    r = np.random.default_rng(seed)
    x = np.concatenate([np.array(c) + r.normal(0, spread, (n + 7 * i, dims)) for i, c in enumerate(centres)])
    return x[r.permutation(len(x))]


RECORDINGS = {
    "three": planted(1, [(0, 0, 0), (12, 1, 3), (2, 14, -4)]),
    "nested": planted(2, [(0, 0, 0), (0, 6, 0), (60, 0, 0), (60, 9, 4), (0, 120, 0)]),
    "one": planted(3, [(0, 0, 0)]),
    "small": planted(4, [(0, 0, 0)], n=30),
    "lost": np.concatenate([planted(5, [(0, 0, 0)], n=90), planted(6, [(40, 0, 0)], n=20)]),
    "equal": np.ones((60, 3)),
    "copy": (lambda x: np.column_stack([x[:, 0], x[:, 0] * 2 + 0.001 * x[:, 1], x[:, 1]]))(planted(7, [(0, 0, 0), (30, 0, 0)])),
}


def frame_of(spark, recordings):
    rows = [(name, i, [float(v) for v in row]) for name, x in recordings.items() for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "rec string, item int, x array<double>").repartition(3)


@pytest.mark.parametrize("local, drop", [(200_000, False), (200_000, True), (0, True)])
def test_recursion_equals_a_direct_loop(spark, monkeypatch, local, drop):
    monkeypatch.setattr(cores, "LOCAL_ROWS", local)
    names = list(RECORDINGS) if local else ["copy", "equal"]
    frame = frame_of(spark, {k: RECORDINGS[k] for k in names}).cache()
    made = lambda members, group: members.join(frame, ["rec", "item"]).select(group, "item", "x")
    depth = 5 if local else 1
    got = {}
    for r in cores.core_loop(frame.select("rec", "item"), ["rec"], "item", made, n_dims=3, drop_redundant=drop, depth=depth).collect():
        got.setdefault(r["rec"], {}).setdefault(r["cluster"], set()).add(r["item"])
    for name in names:
        want = naive_loop(RECORDINGS[name], depth=depth, drop_redundant=drop)
        assert [got.get(name, {}).get(i + 1) for i in range(len(want))] == want and len(got.get(name, {})) == len(want), name
    if local and not drop:
        assert len(got["nested"]) == 5 and len(got["three"]) == 3 and len(got["lost"]) == 1 and "small" not in got


def test_large_fits_equal_local_ones(spark, monkeypatch):
    stages = steps.Stages(spark)
    frame = stages(frame_of(spark, {k: RECORDINGS[k] for k in ("three", "equal")}), "rows")
    near = {r["rec"]: r for r in cores.fit_groups(frame, ["rec"], "item", 4, 3, stages).collect()}
    monkeypatch.setattr(cores, "LOCAL_ROWS", 0)
    far = {r["rec"]: r for r in cores.fit_groups(frame, ["rec"], "item", 4, 3, stages).collect()}
    assert near.keys() == far.keys() == {"three", "equal"}
    for name in near:
        assert near[name]["k"] == far[name]["k"] and near[name]["validity"] == pytest.approx(far[name]["validity"], abs=1e-9)
        assert np.allclose(near[name]["centers"], far[name]["centers"], atol=1e-7)
    k, mpc, _ = naive_best(RECORDINGS["three"], 4)
    assert near["three"]["k"] == k == 3 and near["three"]["validity"] == pytest.approx(mpc, abs=1e-9)


def test_ties_join_several_clusters(spark):
    rows = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [0.0]), (1, 2, [3.0])], "g int, item int, x array<double>")
    fits = spark.createDataFrame([(1, 2, [1.0], [[0.0], [2.0]])], "g int, k int, weights array<double>, centers array<array<double>>")
    got = sorted((r["item"], r["child"]) for r in cores.assigned(rows, fits, ["g"]).collect())
    assert got == [(0, 0), (0, 1), (1, 0), (2, 1)]


def test_of_two_copies_the_less_valid_goes(spark):
    labels = [("r", d, i, (i // 10) if d < 2 else i % 3) for d in range(3) for i in range(30)]
    frame = spark.createDataFrame(labels, "rec string, dim int, item int, cluster int")
    for first, second, gone in ((0.8, 0.9, 0), (0.9, 0.8, 1), (0.9, 0.9, 1)):
        quality = spark.createDataFrame([("r", 0, 3, first), ("r", 1, 3, second), ("r", 2, 3, 0.99)], "rec string, dim int, k int, validity double")
        assert [r["dim"] for r in cores.redundant(frame, quality, ["rec"], "item").collect()] == [gone]


def test_empty_table(spark):
    frame = frame_of(spark, {"r": RECORDINGS["three"]}).limit(0)
    made = lambda members, group: members.join(frame, ["rec", "item"]).select(group, "item", "x")
    assert cores.core_loop(frame.select("rec", "item"), ["rec"], "item", made, n_dims=3).count() == 0
    assert cores.fit_groups(frame, ["rec"], "item", 3, 3, steps.Stages(spark)).where(F.col("k") > 0).count() == 0


def test_redundant_dimensions_of_small_groups_are_left_out_in_their_tasks(spark, monkeypatch):
    stages = steps.Stages(spark)
    frame = stages(frame_of(spark, {k: RECORDINGS[k] for k in ("copy", "three", "equal", "one")}), "rows")
    monkeypatch.setattr(cores, "by_dimension", lambda *a: pytest.fail("rows of small groups were dealt out by dimension"))
    got = {r["rec"]: r for r in cores.core_fits(frame, ["rec"], "item", 3, 6, stages, drop_redundant=True).collect()}
    assert got.keys() == {"copy", "three", "equal", "one"}
    for name, r in got.items():
        x = RECORDINGS[name]
        fits = [naive_best(x[:, d : d + 1], 4) for d in range(3)]
        weights = naive_redundant(x, fits, [(k - 1) ** 2 if mpc >= 0.75 else 0 for k, mpc, _ in fits])
        assert r["weights"] == weights and r["k"] == ((naive_best(x * np.array(weights), 6)[0]) if any(weights) else 1), name
    assert got["copy"]["weights"].count(0.0) == 2


def test_values_of_one_dimension_are_fitted_as_their_rows():
    r = np.random.default_rng(3)
    for x in (r.integers(0, 9, 400), np.repeat([0, 1], [30, 3]), r.normal(0, 1, 200), np.concatenate([r.normal(0, 1, 90), r.normal(20, 1, 60)])):
        x = x.astype(float)[:, None]
        centers, valid = cores.best_centers(x, 4)
        k, mpc, _ = naive_best(x, 4)
        assert len(centers) == k and valid == pytest.approx(mpc, abs=1e-9)
