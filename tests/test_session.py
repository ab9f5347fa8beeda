"""A whole session over planted recordings: two or three shapes of spike, noise, and snippets of two spikes."""

import numpy as np
from pyspark.sql import functions as F

from waveforge.operators import session

KINDS = "rec string, item int, ts long, w1 array<double>, w2 array<double>"


def spike(at, heights):
    i = np.arange(32)
    shape = np.exp(-(((i - at) / 1.6) ** 2)) - 0.5 * np.exp(-(((i - at - 4) / 2.0) ** 2)) - 0.15 * np.exp(-(((i - at + 4) / 2.0) ** 2))
    return np.outer(heights, shape)


def recording(name, seed, heights, n=180):
    r = np.random.default_rng(seed)
    rows, owner = [], {}
    for k, h in enumerate(heights):
        for _ in range(n):
            i = len(rows)
            rows.append((name, i, 1000 * i, *(w.tolist() for w in spike(10, np.array(h) + r.normal(0, 6, 2)) + r.normal(0, 2, (2, 32)))))
            owner[i] = k
    for _ in range(450):  # loose ones of all heights
        i = len(rows)
        rows.append((name, i, 1000 * i, *(w.tolist() for w in spike(10, r.uniform(60, 420, 2)) + r.normal(0, 2, (2, 32)))))
    pairs = {}
    for j in range(12):
        i, (a, b) = len(rows), (j % len(heights), (j + 1) % len(heights))
        rows.append((name, i, 1000 * i, *(w.tolist() for w in spike(7, heights[a]) + spike(22, heights[b]) + r.normal(0, 1, (2, 32)))))
        pairs[i] = (a, b)
    return rows, owner, pairs


RECORDINGS = {"a": recording("a", 1, [(120, 300), (320, 110)]), "b": recording("b", 2, [(100, 250), (380, 390), (260, 90)])}
SETTINGS = session.Settings(["w1", "w2"], [50.0, 50.0], [2000.0, 2000.0], n_passes=2)


def test_planted_spikes_are_sorted_and_graded(spark):
    frame = spark.createDataFrame([x for rows, _, _ in RECORDINGS.values() for x in rows], KINDS).repartition(4)
    done = session.sorted_session(frame, ["rec"], "item", "ts", SETTINGS)
    got = {}
    for x in done.spikes.collect():
        got.setdefault(x["rec"], {}).setdefault((x["item"], x["part"]), []).append((x["cluster"], x["ts_s"]))
    for name, (rows, owner, pairs) in RECORDINGS.items():
        found = {i: c[0][0] for (i, part), c in got[name].items() if part == 0}
        assert all(len(c) == 1 for c in got[name].values())
        number = {}
        for k in set(owner.values()):
            own = [found[i] for i, o in owner.items() if o == k and i in found]
            number[k] = max(set(own), key=own.count)
            assert own.count(number[k]) > 0.6 * sum(o == k for o in owner.values())
        assert len(set(number.values())) == len(number)
        for i in (*owner, *pairs):
            for (j, part), c in got[name].items():
                if j == i:
                    assert abs(c[0][1] - rows[i][2] / 1e6) < 1e-2
        assert not set(pairs) & set(found)
        right = sum(c[0][0] in {number[k] for k in pairs[i]} for (i, part), c in got[name].items() if part)
        whole = sum(1 for (i, part) in got[name] if part)
        assert whole >= 6 and right > 0.7 * whole
    grades = session.graded_session(done, ["rec"], "item", "ts", SETTINGS).collect()
    assert {(x["rec"], x["cluster"]) for x in grades} == {(x["rec"], x["cluster"]) for x in done.members.select("rec", "cluster").distinct().collect()}
    assert all(-10 <= x["final_grade"] <= 5 and x["width"] > 0 for x in grades)


def test_no_rows_and_null_waves(spark):
    rows = spark.createDataFrame([("a", 1, 2, None, [1.0, 2.0])], KINDS)
    for frame in (rows, rows.limit(0)):
        assert session.sorted_session(frame, ["rec"], "item", "ts", SETTINGS).spikes.count() == 0


def test_schedule_of_passes(spark):
    scores = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", i, 0.0) for i in range(3)], "rec string, item int, score double")
    small = session.Settings(["w1"], [1.0], [1.0], n_passes=3, least_rows=5, least_in_pass=9)
    got = {(x["rec"], x["pass"]): x["n"] for x in session.pass_numbers(scores, ["rec"], "item", small).groupBy("rec", "pass").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", 2): 9, ("a", 3): 10, ("b", 1): 3, ("b", 2): 3, ("b", 3): 3}
