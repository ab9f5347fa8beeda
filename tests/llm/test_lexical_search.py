"""Ranked search against a direct score of every document."""

import math
import random
import re
from collections import Counter

import pytest

from waveforge.llm import lexical_search

SCHEMA = "doc_id long, text string, score long, rank int, item_id string, id long, w long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
r = random.Random(4)
VOCABULARY = ["".join(r.choice("abcéß9") for _ in range(r.randint(1, 4))) for _ in range(400)]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def text_of(n, seed):
    s = random.Random(seed)
    return "".join(s.choice(VOCABULARY[: int(s.paretovariate(0.6) * 8) + 1]).title() + s.choice([" ", "-", "\n", "_", "\x00"]) for _ in range(n))


def direct(docs, items, k):
    held = [(doc, Counter(words(text)), len(words(text))) for doc, text, *_ in docs]
    n, total = sum(size > 0 for *_, size in held), sum(size for *_, size in held)
    df = Counter(w for _, tf, _ in held for w in tf)
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(words(text))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, tf, size in held:
            if size:
                m = 100 - 75 + 75 * size * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
                if score > 0:
                    found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, i + 1, doc, -score) for i, (score, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


DOCS = [(i * 13 % 701, text_of(r.choice([3, 20, 60, 400]), i), 1, 1, "x", 1, 1) for i in range(600)]
DOCS += [(800 + i, DOCS[5][1], 1, 1, "x", 1, 1) for i in range(30)]  # ties
DOCS += [(3, "twice the same id", 1, 1, "x", 1, 1), (900, None, 1, 1, "x", 1, 1), (901, "", 1, 1, "x", 1, 1), (902, " -- \x7f", 1, 1, "x", 1, 1), (None, DOCS[5][1], 1, 1, "x", 1, 1), (903, " ".join(VOCABULARY * 40), 1, 1, "x", 1, 1)]
ITEMS = [(i, text_of(r.choice([1, 4, 30]), 1000 + i)) for i in range(60)] + [(60, DOCS[5][1]), (61, None), (62, " "), (63, "nowhere"), (64, "a a a a b"), (1, "a b"), (None, "twice same id")]


def key(row):
    return tuple((x is not None, x or 0) for x in row)


@pytest.mark.parametrize("parts, shard, k, block", [(1, 1 << 16, 10, 1 << 20), (7, 40, 10, 1 << 20), (3, 5, 1, 1 << 20), (4, 100, 1000, 1 << 20), (4, 100, 10, 600)])
def test_search_equals_a_direct_score(spark, monkeypatch, parts, shard, k, block):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_search, "SEED_DOCS", 8)
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(parts)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = sorted((tuple(x) for x in lexical_search.search(docs, items, k, block_bytes=block).collect()), key=key)
    assert found == sorted(direct(DOCS, ITEMS, k), key=key)


def test_wand_skips_documents(monkeypatch):
    """Of documents that only hold a frequent term, few are visited."""
    ids = [*range(5000)]
    row = {"docs": ids, "lengths": b"".join((10).to_bytes(8, "little") for _ in ids), "terms": [0, 1], "dfs": [5000, 20]}
    places = [*range(5000), *range(0, 5000, 250)]
    row |= {"places": b"".join(x.to_bytes(4, "little") for x in places), "tfs": (1).to_bytes(4, "little") * len(places)}
    shard, query = lexical_search.Shard(row, 5000, 50000), lexical_search.Query("q", {0: 1, 1: 5000})
    jumps = []
    monkeypatch.setattr(lexical_search, "bisect_left", lambda a, x, lo=0: jumps.append(x) or next((i for i in range(lo, len(a)) if a[i] >= x), len(a)))
    for threshold, most in ((1, 1100), (shard.seed(query, 5)[-1], 100)):  # single steps up to the fifth rare one; from the seeded threshold on none
        jumps.clear()
        assert sorted(place for _, place in shard.wand(query, 5, threshold)) == [0, 250, 500, 750, 1000]
        assert len(jumps) < most


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    full = spark.createDataFrame(DOCS[:5], SCHEMA)
    for d, i in ((docs, items), (docs, some), (full, items)):
        assert lexical_search.search(d, i).count() == 0
