"""Passes over planted groups, keep-out boxes against NumPy, and the density of scheduled passes."""

import numpy as np
from pyspark.sql import functions as F

from waveforge.operators import passes, steps


def rows_of(spark, recordings):
    rows = [(n, i, *map(float, v)) for n, x in recordings.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "rec string, item int, p0 double, p1 double").repartition(3).cache()


def test_boxes(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal((0, 0), (4, 1), (300, 2)) @ np.array([[0.8, 0.6], [-0.6, 0.8]]), r.uniform(-25, 25, (1500, 2))])
    clusters = {1: [*range(0, 300), 700], 2: [400, 401, 402, 403]}
    rows = rows_of(spark, {"a": x, "b": x[:50]})
    members = spark.createDataFrame([("a", c, i) for c, items in clusters.items() for i in items], "rec string, cluster int, item int")
    left = {(q["rec"], q["item"]) for q in passes.outside_boxes(rows.select("rec", "item"), rows, members, ["rec"], "cluster", "item", ["p0", "p1"], steps.Stages(spark)).collect()}
    gone = set()
    for items in clusters.values():
        axes = np.linalg.eigh(np.cov(x[items].T))[1][:, ::-1]
        data = np.column_stack([x, x @ axes])
        own = data[items]
        lo = np.maximum(own.min(0), own.mean(0) - 3 * own.std(0, ddof=1))
        hi = np.minimum(own.max(0), own.mean(0) + 3 * own.std(0, ddof=1))
        gone |= set(np.flatnonzero(((lo < data) & (data < hi)).all(1)).tolist()) | set(items)
    assert left == {("a", i) for i in range(len(x)) if i not in gone} | {("b", i) for i in range(50)}
    assert 300 < len(gone) < 1300


def recording(spark, x):
    rows = rows_of(spark, x)
    made = lambda members, group: members.join(rows, ["rec", "item"]).select(group, "item", F.array("p0", "p1").alias("x"))
    return passes.Recording(rows, ["rec"], "item", ["p0", "p1"], ["p0", "p1"], made, 2)


def test_groups_are_found_in_the_pass_that_the_schedule_says(spark):
    r = np.random.default_rng(3)
    sizes, centres = (260, 240, 280), ((0, 0), (60, 8), (20, 70))
    x = np.concatenate([r.normal(c, 1.5, (n, 2)) for c, n in zip(centres, sizes, strict=True)])
    owner = np.repeat([1, 2, 3], sizes)
    y = np.concatenate([r.normal((0, 0), 1.5, (300, 2)), r.normal((50, -40), 1.5, (300, 2))])
    noise = r.uniform(-80, 110, (2500, 2))  # in no pass, but among the rows that clusters are expanded in
    owner = np.concatenate([owner, np.zeros(len(noise), int)])
    rec = recording(spark, {"a": np.concatenate([x, noise]), "b": np.concatenate([y, noise])})
    # the first pass of "a" sees two groups, the second all; "b" has both in the second
    plan = [("a", i, 1) for i in range(len(x)) if owner[i] < 3] + [("a", i, 2) for i in range(len(x))] + [("b", i, 2) for i in range(len(y))]
    got = {}
    for q in passes.iterated(rec, spark.createDataFrame(plan, "rec string, item int, pass int")).collect():
        got.setdefault((q["rec"], q["cluster"], q["pass"]), set()).add(q["item"])
    groups = {}
    for (n, c, p), items in got.items():
        owners = [int(owner[i]) if n == "a" else 1 + (i >= 300) if i < 600 else 0 for i in items]
        g = max(set(owners), key=owners.count)
        assert g and owners.count(g) > 0.95 * len(items)
        groups[n, g] = p
        assert len(items) > 0.5 * (sizes[g - 1] if n == "a" else 300)
    assert groups == {("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("b", 1): 2, ("b", 2): 2}
    assert sorted(c for n, c, _ in got if n == "a") == [1, 2, 3]


def test_last_pass_isn_t_thinned(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.uniform(0, 300, (300, 2)), r.normal(150, 5, (300, 2))])
    rows = rows_of(spark, {"a": x, "b": x})
    plan = rows.where("rec = 'a'").select("rec", "item", F.explode(F.array(F.lit(1), F.lit(2))).alias("pass")).union(rows.where("rec = 'b'").select("rec", "item", F.lit(1)))
    got = {(q["rec"], q["pass"]): q["n"] for q in passes.schedule(plan, rows, ["rec"], "item", ["p0", "p1"]).groupBy("rec", "pass").agg(F.count("*").alias("n")).collect()}
    assert got["a", 2] == 600 and got["a", 1] == got["b", 1] < 600


def test_empty_tables(spark):
    rec = recording(spark, {"a": np.zeros((3, 2))})
    none = spark.createDataFrame([], "rec string, item int, pass int")
    assert passes.iterated(rec, none).count() == 0
    few = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("a", 2, 2)], "rec string, item int, pass int")
    assert passes.iterated(rec, few).count() == 0
