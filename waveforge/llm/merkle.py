"""Merkle manifest of a dataset: superblock reduction, inclusion proofs and their check.

Rows become leaves; the leaves of each group (a language) form a tree of runs of ``fanout``
nodes, and the groups' roots form one more tree over the groups.  Leaves are numbered
within their group in order of id: one range partitioning, positions inside partitions, and
a prefix sum over a row for each partition and group.  A *superblock* is ``fanout**levels``
neighbouring nodes (``index // fanout**levels``): one call of ``applyInPandas`` collapses
it by ``levels`` levels to a single node, and the superblocks' nodes are reduced again until
each group has one.  A group of all rows is thus many superblocks, of bounded size.

Proofs come down the same way: a superblock's nodes get their siblings inside it, followed by the
proof of the superblock's own node, which is one row beside up to ``fanout**levels`` (a cogroup, so the
upper proof isn't copied to each of them).

A node is the lowercase hex sha256 of its children's hex texts one after another; a run of a
single node is hashed too, but a tree of one leaf is that leaf.

Cases: null fields are ``-`` and differ from empty ones; a null group comes first; null ids come
first in their group and are never tampered with; rows that repeat an id are ordered by their leaves; the
fields are read by name, other columns not at all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, partitions, small_or_shuffled

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The bits of ``monotonically_increasing_id`` below the partition's number.
_PLACE_BITS = 33


def field_text(column: str | Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    value = (F.col(f"`{column}`") if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(fields: list[str | Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tree, leaf, claim``: the leaf, and the leaf of what a holder of the row claims (the row with text lower-cased, for a third of the ids)."""
    tampered = F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 0
    claimed = [ascii_lower(F.col(f"`{x}`")) if x == text_col else x for x in fields]
    group = F.col(f"`{group_col}`").cast("string")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("tree"),  # in the order of the groups, null first
        leaf_digest(list(fields)).alias("leaf"),
        F.when(tampered, leaf_digest(claimed)).alias("claim"),
    )


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx`` (from 0 in the order within its tree) and ``n`` (the tree's size).  ``rows`` is read twice: pass a written table."""
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("place", _PLACE_BITS))
    runs = placed.groupBy("tree", "part").agg(F.min("place").alias("low"), F.count("*").alias("many"))
    by_tree = Window.partitionBy("tree")
    shifts = runs.select("tree", "part", (F.sum("many").over(by_tree.orderBy("part")) - F.col("many") - F.col("low")).alias("shift"), F.sum("many").over(by_tree).alias("n"))
    shifts = small_or_shuffled(materialize(shifts, "shifts"))
    return placed.join(shifts, ["tree", "part"]).withColumn("idx", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def depth(n: int, fanout: int) -> int:
    """Levels over ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def collapse(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """``nodes`` and the levels above them, ``levels`` in number."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def siblings(tower: list[list[str]], at: int, fanout: int) -> Iterator[tuple[str, str]]:
    """What stands left and right of the path from node ``at`` of a superblock, level by level."""
    for below in tower[:-1]:
        low = at - at % fanout
        yield "".join(below[low:at]), "".join(below[at + 1 : low + fanout])
        at //= fanout


def _block(fanout: int, levels: int) -> Column:
    return F.floor(F.col("idx") / F.lit(fanout**levels)).cast("long").alias("block")


def reduce_trees(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Rounds of ``tree, idx, n, digest``, from ``nodes`` to one node a tree; each round's nodes are the superblocks of the one before."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        n = int(rows["n"].iloc[0])
        up = min(levels, depth(n, fanout))
        (top,) = collapse(rows["digest"].tolist(), up, fanout)[-1]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-n // fanout**up)], "digest": [top]})

    rounds = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        blocks = rounds[-1].select("tree", "idx", "n", "digest").groupBy("tree", _block(fanout, levels))
        rounds.append(materialize(blocks.applyInPandas(one, "tree string, idx long, n long, digest string"), "superblocks"))
        largest = -(-largest // fanout**levels)
    return rounds


PROOF = "tree string, idx long, lefts array<string>, rights array<string>, subroot string, root string"


def proofs_below(nodes: list[DataFrame], upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Proofs of the first of ``nodes`` (rounds, each the superblocks of the one before); ``upper``: ``PROOF`` of the superblocks of the last."""

    def one(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        up, nodes = above.iloc[0], rows["digest"].tolist()
        tower = collapse(nodes, min(levels, depth(int(rows["n"].iloc[0]), fanout)), fanout)
        pairs = [[*siblings(tower, i, fanout)] for i in range(len(nodes))]
        return pd.DataFrame({
            "tree": key[0], "idx": rows["idx"].to_numpy(),
            "lefts": [[x for x, _ in p] + list(up["lefts"]) for p in pairs], "rights": [[y for _, y in p] + list(up["rights"]) for p in pairs],
            "subroot": up["subroot"], "root": up["root"],
        })

    for below in reversed(nodes):
        rows = below.select("tree", "idx", "n", "digest").groupBy("tree", _block(fanout, levels))
        upper = materialize(rows.cogroup(upper.groupBy("tree", F.col("idx").alias("block"))).applyInPandas(one, PROOF), "proofs")
    return upper


def fold(node: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in zip(lefts, rights, strict=True):
        node = digest(left, node, right)
    return node


def manifest(rows: DataFrame, fanout: int = 8, levels: int = 3, keep_proofs: bool = False) -> DataFrame:
    """Per row of :func:`leaves`: ``id, leaf, subroot, root, proof_sha256, folded_root, verified`` and, with ``keep_proofs``, ``lefts, rights``.

    ``folded_root`` is recomputed from the claim (the leaf where there is none) and the row's siblings.
    """
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "lefts", "rights"][: 7 + 2 * keep_proofs]

    def check(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, up = rows.sort_by("idx"), above.to_pylist()[0]
        nodes, claims = rows.column("leaf").to_pylist(), rows.column("claim").to_pylist()
        rest = "".join(x + y for x, y in zip(up["lefts"], up["rights"], strict=True))
        tower = collapse(nodes, min(levels, depth(rows.column("n")[0].as_py(), fanout)), fanout)
        proofs, folded, lefts, rights = [], [], [], []
        for i, leaf in enumerate(nodes):
            pairs = [*siblings(tower, i, fanout)]
            left, right = [x for x, _ in pairs] + up["lefts"], [y for _, y in pairs] + up["rights"]
            proofs.append(digest(*(x + y for x, y in pairs), rest))
            folded.append(fold(claims[i] or leaf, left, right))
            if keep_proofs:
                lefts.append(left)
                rights.append(right)
        ways = [pa.array(x, pa.list_(pa.string())) for x in (lefts, rights)][: 2 * keep_proofs]
        same = pa.array([x == up["root"] for x in folded])
        text = [pa.array([up[x]] * len(nodes), pa.string()) for x in ("subroot", "root")]
        return pa.Table.from_arrays([rows.column("id"), rows.column("leaf"), *text, pa.array(proofs), pa.array(folded), same, *ways], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", lefts array<string>, rights array<string>" * keep_proofs
    found = numbered(materialize(rows, "leaves"), ["id", "leaf", "claim"], "ordered")
    trees = reduce_trees(found.select("tree", "idx", "n", F.col("leaf").alias("digest")), fanout, levels)
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    groups = numbered(materialize(subroots, "subroots"), ["group"], "groups")
    top = reduce_trees(groups.select("tree", "idx", "n", "digest"), fanout, levels)
    nothing = F.array().cast("array<string>")
    root = top[-1].select("tree", "idx", nothing.alias("lefts"), nothing.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    ways = proofs_below(top[:-1], root, fanout, levels).select("idx", "lefts", "rights", "root")
    upper = groups.join(ways, "idx").select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("idx"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    above = proofs_below(trees[1:-1], materialize(upper, "upper"), fanout, levels)
    blocks = found.select("id", "tree", "idx", "n", "leaf", "claim").groupBy("tree", _block(fanout, levels))
    return blocks.cogroup(above.groupBy("tree", F.col("idx").alias("block"))).applyInArrow(check, schema)


def oracle_sql() -> str:
    """The same for ``documents`` in DuckDB, level by level."""

    def field(x: str) -> str:
        return f"coalesce(octet_length(encode(cast({x} AS VARCHAR))) || ':' || {x}, '-')"

    plain = " || ".join(map(field, FIELDS))
    lowered = " || ".join(map(field, [*FIELDS[:-1], "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"]))
    return f"""
WITH RECURSIVE leaves AS (SELECT doc_id, cast(doc_id AS VARCHAR) AS name, lang, sha256({plain}) AS leaf, sha256({lowered}) AS lowered FROM documents),
bits AS (SELECT *, list_transform(range(8 * length(name)), lambda i: (ascii(substr(name, 1 + (i >> 3), 1)) >> (i & 7)) & 1) AS bit FROM leaves),
crcs AS (SELECT *, xor(list_reduce(list_concat([4294967295], bit), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS crc FROM bits),
placed AS (SELECT doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS claim, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM crcs),
low AS (
    SELECT lang, 0 AS height, pos, n, leaf AS node FROM placed
    UNION ALL
    SELECT lang, height + 1, pos >> 3, (n + 7) >> 3, sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, height, pos >> 3, n),
subroots AS (SELECT lang, height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
    SELECT 0 AS height, pos, n, subroot AS node FROM subroots
    UNION ALL
    SELECT height + 1, pos >> 3, (n + 7) >> 3, sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY height, pos >> 3, n),
low_runs AS (SELECT lang, height, pos >> 3 AS run, list(node ORDER BY pos) AS nodes FROM low WHERE n > 1 GROUP BY lang, height, pos >> 3),
high_runs AS (SELECT height, pos >> 3 AS run, list(node ORDER BY pos) AS nodes FROM high WHERE n > 1 GROUP BY height, pos >> 3),
steps AS (
    SELECT p.lang, p.pos, r.height AS step, (p.pos >> (3 * r.height)) & 7 AS place, r.nodes
    FROM placed p JOIN low_runs r ON r.lang IS NOT DISTINCT FROM p.lang AND r.run = p.pos >> (3 * r.height + 3)
    UNION ALL
    SELECT p.lang, p.pos, s.height + r.height, (s.pos >> (3 * r.height)) & 7, r.nodes
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN high_runs r ON r.run = s.pos >> (3 * r.height + 3)),
sides AS (SELECT lang, pos, step, array_to_string(nodes[1:place], '') AS l, array_to_string(nodes[place + 2:], '') AS r FROM steps),
ways AS (SELECT lang, pos, string_agg(l || r, '' ORDER BY step) AS proof, list(l || '|' || r ORDER BY step) AS pairs FROM sides GROUP BY lang, pos),
done AS (
    SELECT p.doc_id, p.leaf, s.subroot, t.node AS root, sha256(coalesce(w.proof, '')) AS proof_sha256,
           list_reduce(list_concat([p.claim], coalesce(w.pairs, [])), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT node FROM high WHERE n = 1) t ON true
    LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos)
SELECT *, folded_root = root AS verified FROM done"""
