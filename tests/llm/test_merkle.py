"""The Merkle manifest against a direct walk over lists."""

import zlib
from hashlib import sha256

import pytest

from waveforge.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, leaf int, tree string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes, at, fanout):
    """The root over ``nodes`` and, level by level, what stands left and right of the way up from ``at``."""
    way = []
    while len(nodes) > 1:
        low = at // fanout * fanout
        way.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + fanout])))
        nodes, at = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], at // fanout
    return nodes[0], way


def direct(rows, fanout):
    made = []
    for doc, text, lang, source, n, *_ in rows:
        low = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        leaf, lower = (h(*map(field, (doc, source, lang, n, t))) for t in (text, low))
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        made.append((lang is not None, lang or "", doc is not None, doc or 0, leaf, lower if tampered else leaf, doc))
    made.sort(key=lambda r: r[:5])
    trees = {}
    for r in made:
        trees.setdefault(r[:2], []).append(r)
    subroots = [climb([r[4] for r in t], 0, fanout)[0] for t in trees.values()]
    out = []
    for k, tree in enumerate(trees.values()):
        root, high = climb(subroots, k, fanout)
        for i, r in enumerate(tree):
            subroot, low = climb([x[4] for x in tree], i, fanout)
            node = r[5]
            for left, right in low + high:
                node = h(left, node, right)
            out.append((r[6], r[4], subroot, root, h(*(x for pair in low + high for x in pair)), node, node == root))
    return out


def rows_of(n, langs, seed=0):
    return [(i * 7 % (n + 3) + seed, "Some Text É %d" % (i % 40) if i % 11 else None, langs[i * i % len(langs)], "s" if i % 5 else None, i if i % 3 else None, "x", 1, "t") for i in range(n)]


CASES = [
    rows_of(1, ["en"]),
    rows_of(9, ["en"]),
    rows_of(300, ["en", "de", None, "", "é", "zz"]) + [(3, "", "xx", "", 0, "x", 1, "t"), (None, "Null ID", "en", "s", 1, "x", 1, "t"), (None, None, None, None, None, None, None, None)] + rows_of(4, ["en"]) * 3,
    [(i, "lower", f"l{i % 70}", "s", 1, "x", 1, "t") for i in range(150)],
]


@pytest.mark.parametrize("rows", CASES, ids=["one", "nine", "nulls and copies", "many groups"])
@pytest.mark.parametrize("fanout, levels", [(8, 3), (2, 2)])
def test_manifest_equals_a_direct_walk(spark, rows, fanout, levels):
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        found = [tuple(r) for r in merkle.manifest(merkle.leaves(docs), fanout, levels).collect()]
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(found, key=key) == sorted(direct(rows, fanout), key=key)


def test_large_ids_stay_whole_beside_nulls_and_proofs_lead_to_the_root(spark):
    big = (1 << 62) + 1
    docs = spark.createDataFrame([(big, "A", "en", "s", 1, "", 0, ""), (None, "B", "en", "s", 1, "", 0, "")], SCHEMA)
    found = merkle.manifest(merkle.leaves(docs), keep_proofs=True).collect()
    assert {r["id"] for r in found} == {big, None}
    assert all(merkle.fold(r["leaf"], r["lefts"], r["rights"]) == r["root"] for r in found)
    assert all(h("".join(x + y for x, y in zip(r["lefts"], r["rights"], strict=True))) == r["proof_sha256"] for r in found)


def test_empty_table(spark):
    assert merkle.manifest(merkle.leaves(spark.createDataFrame([], SCHEMA))).count() == 0


def test_depth():
    assert [merkle.depth(n, 8) for n in (0, 1, 2, 8, 9, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]
