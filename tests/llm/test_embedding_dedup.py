"""Near-duplicate vectors against brute force, with planted pairs, a hot group and unusable rows."""

import numpy as np
import pytest

from waveforge.llm import embedding_dedup, graph

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, v int"


def brute(rows, threshold=0.98):
    """n_links and component by all pairs of equal labels."""
    units = {}
    for i, v, label, *_ in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            units[i] = (label, x / np.sqrt(x @ x))
    links = {r[0]: set() for r in rows}
    for label in {x[0] for x in units.values()}:
        ids = [i for i in units if units[i][0] == label]
        for dim in {len(units[i][1]) for i in ids}:
            some = [i for i in ids if len(units[i][1]) == dim]
            x = np.stack([units[i][1] for i in some])
            for p, q in np.argwhere(x @ x.T >= threshold).tolist():
                if p != q:
                    links[some[p]].add(some[q])
    root = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, others in links.items():
            low = min([root[i], *(root[j] for j in others)]) if i is not None else i
            if low != root[i]:
                root[i], changed = low, True
    return {i: (len(links[i]), root[i]) for i in links}


def planted(n, seed, dim=64, spread=1.0):
    """``n`` vectors around a common direction, of which a tenth have a partner at a cosine a little over or under 0.98."""
    r = np.random.default_rng(seed)
    x = r.normal(0, spread, (n, dim)) + r.normal(0, 1, dim)
    for i in range(0, n // 10):
        near = x[n - 1 - i] + r.normal(0, 1, dim) * np.linalg.norm(x[n - 1 - i]) / np.sqrt(dim) * r.uniform(0.17, 0.22)
        x[i] = near
    return x


@pytest.mark.parametrize("parts", ["3", "40"])
def test_links_and_components(spark, monkeypatch, parts):
    monkeypatch.setattr(embedding_dedup, "partitions", lambda s: int(parts))
    rows = [(i, v.tolist(), 1, "clash", 1) for i, v in enumerate(planted(700, 1))]
    rows += [(1000 + i, v.tolist(), 2, "clash", 1) for i, v in enumerate(planted(500, 2, spread=0.45))]
    hot = np.random.default_rng(3).normal(0, 1, 64)
    rows += [(2000 + i, (hot + np.random.default_rng(i).normal(0, 0.1, 64)).tolist(), 3, "clash", 1) for i in range(600)]
    rows += [(3000 + i, [1.0, 2.0, 3.0], 1, "clash", 1) for i in range(3)] + [(3010, [1e30] * 64, 1, "clash", 1), (3011, [1e-30] * 64, 1, "clash", 1)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0, None], [float("inf"), 1.0]]
    rows += [(4000 + i, v, 1, "clash", 1) for i, v in enumerate(odd)] + [(4100, hot.tolist(), None, "clash", 1), (None, hot.tolist(), 3, "clash", 1)]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5))
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()}
    want = brute(rows)
    assert {i for i in want if found[i] != want[i]} == set()
    assert sum(n > 0 for n, _ in want.values()) > 600


def test_recall_over_larger_labels(spark):
    x = planted(9000, 5, spread=0.5)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(frame).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    asked = range(0, len(u), 50)
    want = {i: int((u @ u[i] >= 0.98).sum()) - 1 for i in [*asked, *range(900)]}
    linked = [i for i in want if want[i]]
    assert len(linked) > 300 and np.mean([found[i] == want[i] for i in linked]) >= 0.99


def test_no_rows_and_other_ids(spark):
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(TypeError):
        embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA), id_col="rep")


def tight(groups, n, cosine, pairs, seed, dim=64):
    """``groups`` groups of ``n`` vectors each, any two of a group at about ``cosine``, and partners at a cosine a little over or under 0.98 for some."""
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    away = np.sqrt(1 / cosine - 1)
    x = np.concatenate([c + r.normal(0, away / np.sqrt(dim), (n, dim)) for c in centres])
    at = r.choice(len(x), pairs, replace=False)
    step = r.normal(0, 1, (pairs, dim))
    own = x[at] / np.linalg.norm(x[at], axis=1, keepdims=True)
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    return np.concatenate([x, own + step * r.uniform(0.17, 0.22, (pairs, 1))])


def all_links(x, threshold=0.98):
    u = x.astype(np.float32).astype(float)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    counts, edges = np.zeros(len(u), int), []
    for lo in range(0, len(u), 2000):
        near = u[lo : lo + 2000] @ u.T >= threshold
        counts[lo : lo + 2000] = near.sum(axis=1) - 1
        edges += [(lo + i, j) for i, j in np.argwhere(near).tolist() if j < lo + i]
    root = list(range(len(u)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in edges:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return counts, np.array([find(i) for i in range(len(u))])


@pytest.mark.parametrize("groups, n, cosine", [(4, 5000, 0.95), (2, 15000, 0.96)])
def test_tight_groups_inside_a_label(spark, groups, n, cosine):
    x = tight(groups, n, cosine, 400, 11)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(frame).collect()}
    counts, components = all_links(x)
    got = np.array([found[i][0] for i in range(len(x))])
    assert counts.sum() > 600 and (got <= counts).all() and got.sum() >= 0.99 * counts.sum()
    assert np.mean([found[i][1] == components[i] for i in np.flatnonzero(counts)]) >= 0.99


def test_windows_of_chunks(spark, monkeypatch):
    """With small chunks a label takes many passes and rounds, and every link is found all the same."""
    monkeypatch.setattr(embedding_dedup, "CHUNK", 100)
    x = planted(1200, 8)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(frame).collect()}
    counts, _ = all_links(x)
    assert counts.sum() > 80 and sum(found.values()) >= 0.99 * counts.sum() and all(found[i] <= counts[i] for i in found)


def test_passes_follow_the_label_size():
    counts = [embedding_dedup.passes_for(n, 1e-4) for n in (1, 8192, 8193, 50_000, 1_000_000, 100_000_000)]
    assert counts == sorted(counts) and counts[:2] == [1, 1] and counts[2] > 1


def test_components_of_chains_stars_loops_and_nulls(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    links = chain + star + [(200, 200), (None, 5), (7, None), (301, 300), (300, 301), (301, 300)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 300: 300, 301: 300}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
