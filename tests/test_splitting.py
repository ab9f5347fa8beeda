"""Snippets of several spikes against a plain walk over each snippet."""

import math

import numpy as np
import pytest

from waveforge.operators import splitting


def walk(waves, thresholds, ts):
    """``ts, waves, wire, at, lower, upper`` of each spike, sample by sample."""
    n = len(waves[0])
    peaks = [[i for i in range(1, n - 1) if w[i] > w[i - 1] and w[i] >= w[i + 1]] for w in waves]
    valleys = [[i for i in range(1, n - 1) if -w[i] > -w[i - 1] and -w[i] >= -w[i + 1]] for w in waves]
    spikes = []
    for k, w in enumerate(waves):
        high = [p for p in peaks[k] if w[p] >= 0.99 * thresholds[k]]
        found = []
        for p in high:
            if int(np.argmax([x[p] for x in waves])) != k:
                continue
            later = [q for q in high if q > p]
            until = later[0] if later else n - 1
            if any(p < v < until and w[v] < thresholds[k] / 2 for v in valleys[k]):
                found.append(p)
        spikes.append(found)
    every = sorted(p for s in spikes for p in s)
    for a in range(len(waves)):
        mine = list(spikes[a])
        for b in range(a + 1, len(waves)):
            theirs = list(spikes[b])
            for p in mine:
                for q in theirs:
                    if abs(p - q) <= math.ceil(0.25 * n):
                        k, x = (b, q) if waves[a][p] > waves[b][q] else (a, p)
                        spikes[k] = [y for y in spikes[k] if y != x]
                        every = [y for y in every if y != x]
    out = []
    for k, w in enumerate(waves):
        for p in spikes[k]:
            i = every.index(p)
            if i == 0:
                lower = max([q for q in peaks[k] if q < p], default=0)
            else:
                lower = max([v for v in valleys[k] if every[i - 1] < v < p], default=None)
            if i == len(every) - 1:
                upper = min([q for q in peaks[k] if q > p], default=n - 1)
            else:
                upper = max([v for v in valleys[k] if p < v < every[i + 1]], default=None)
            if lower is None or upper is None:
                return out
            fits = lambda j: all(x[j] <= x[p] for x in waves)  # noqa: B023, E731
            if not fits(lower):
                lower = next((j for j in range(lower + 1, p) if fits(j)), None)
            if not fits(upper):
                upper = next((j for j in range(upper - 1, p, -1) if fits(j)), None)
            if lower is None or upper is None:
                continue
            size = upper - lower + 1
            start = (n - size) // 2
            made = [[0.0] * start + list(x[lower : upper + 1]) + [0.0] * (n - size - start) for x in waves]
            out.append((ts + lower * 1000 / n, made, k + 1, p, lower, upper))
    return out


def bump(n, at, height, width=2.0):
    i = np.arange(n)
    return np.round(height * (np.exp(-(((i - at) / width) ** 2)) - 0.8 * np.exp(-(((i - at - 3 * width) / width) ** 2)) - 0.2 * np.exp(-(((i - at + 3 * width) / width) ** 2))), 1)


HAND = {
    "none": [np.zeros(40), np.zeros(40)],
    "one": [bump(40, 15, 100), bump(40, 15, 50)],
    "two on one wire": [bump(40, 8, 100) + bump(40, 28, 90), bump(40, 8, 40) + bump(40, 28, 30)],
    "two on two wires": [bump(40, 8, 100), bump(40, 30, 90)],
    "too near": [bump(40, 14, 100), bump(40, 20, 90)],
    "tie": [bump(40, 14, 100), bump(40, 22, 100)],
    "three": [bump(60, 8, 100) + bump(60, 45, 80), bump(60, 26, 90)],
    "four": [bump(80, 8, 100) + bump(80, 48, 80), bump(80, 28, 90) + bump(80, 68, 95)],
    "no valley after": [np.concatenate([np.linspace(0, 100, 30), np.full(10, 99.0)]), np.zeros(40)],
    "peak at an end": [np.linspace(0, 100, 40), np.zeros(40)],
    "two samples": [np.array([1.0, 200.0]), np.array([0.0, 0.0])],
}


def spark_rows(spark, snippets, thresholds):
    rows = [(str(name), 1000, [[float(v) for v in w] for w in waves]) for name, waves in snippets.items()]
    frame = spark.createDataFrame(rows, "name string, ts_us long, waves array<array<double>>")
    wires = [f"w{i + 1}" for i in range(len(thresholds))]
    frame = frame.select("name", "ts_us", *(frame.waves[i].alias(w) for i, w in enumerate(wires)))
    got = {}
    for r in splitting.split(frame, wires, thresholds).orderBy("name", "part").collect():
        got.setdefault(r["name"], []).append((r["ts_us"], [list(r[w]) for w in wires], r["part_wire"], r["part_at"], r["lower"], r["upper"]))
    return got


def test_hand_made_snippets(spark):
    got = spark_rows(spark, HAND, [60.0, 60.0])
    for name, waves in HAND.items():
        assert got.get(name, []) == walk([list(map(float, w)) for w in waves], [60.0, 60.0], 1000), name
    assert {k: len(v) for k, v in got.items()} == {"one": 1, "two on one wire": 2, "two on two wires": 2, "three": 3, "four": 2}


@pytest.mark.parametrize("wires", [1, 2, 4])
def test_random_snippets(spark, wires):
    r = np.random.default_rng(wires)
    snippets = {i: [np.convolve(r.normal(0, 60, 36), np.ones(1 + i % 3), "valid")[:32] for _ in range(wires)] for i in range(300)}
    snippets |= {1000 + i: [np.round(r.normal(0, 2, 32)) for _ in range(wires)] for i in range(200)}  # many ties
    thresholds = [50.0, 40.0, 1.0, 45.0][:wires]
    got = spark_rows(spark, snippets, thresholds)
    many = 0
    for name, waves in snippets.items():
        want = walk([list(map(float, w)) for w in waves], thresholds, 1000)
        assert got.get(str(name), []) == want, name
        many += len(want) > 1
    assert many > 20


def test_null_waves_and_empty_table(spark):
    frame = spark.createDataFrame([(1, 5, None, None)], "id long, ts_us long, w1 array<double>, w2 array<double>")
    assert splitting.split(frame, ["w1", "w2"], [1.0, 1.0]).count() == 0
    assert splitting.split(frame.limit(0), ["w1", "w2"], [1.0, 1.0]).count() == 0
