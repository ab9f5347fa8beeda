"""Ranked lexical search: WAND in every document shard, then a merge of the shards' heaps.

For a block of queries (bounded by the bytes of their texts, so its vocabulary is bounded too):

1. *Index.*  Each task reads its documents once and cuts them into shards of bounded size.  A shard is a row: its documents with a
   query term and their lengths, and per term its postings in order of the documents.  Texts aren't shuffled.
2. *Statistics* over all documents: N, L and each term's number of documents, summed from the shards' rows; a term's weight comes from them.
3. *Thresholds.*  Each shard scores the documents of a query's rarest terms.  The k-th best of those real scores over all shards
   is a score that the query's k-th document reaches at least, so a shard may start its heap from it.
4. *WAND.*  The cursors of a query's terms stand in order of their next document; the pivot is the first document at which the largest impacts of the
   terms up to it add up to the threshold.  Cursors before the pivot jump to it, as no document in between can enter the heap; a pivot that all
   of them reach is scored.  The threshold rises with the heap.  A document that ties with it is scored too, as the order of ids decides.
5. *Merge*: the best k rows of a query, of the at most k rows a shard has sent.  Spark keeps k rows a query in each task before the shuffle.

Scores are 64-bit integers throughout, so they don't depend on the shards.

Cases: null texts and texts without a term count for nothing; null ids come first among equal scores; rows that repeat an id are documents of their own; queries that share an id
are one query (terms add up), one without terms has no result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heappush, heapreplace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import arrow_map, integer_ids, materialize, slices

#: Bytes of query texts in a block of queries.
BLOCK_BYTES = 8 << 20
#: A shard ends at so many documents or occurrences of query terms.
SHARD_DOCS, SHARD_HITS = 1 << 16, 1 << 21
#: A shard scores at least so many documents, where a query has them, for the first threshold.
SEED_DOCS = 64

_TERM_BYTE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_LOWEST = -(1 << 63)  # a null id among equal scores
SHARD = "docs array<long>, lengths binary, terms array<int>, dfs array<int>, places binary, tfs binary, n_docs long, n_terms long"


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of letters and digits of ASCII and of all other characters; only A-Z are lower-cased."""
    return text.encode().translate(_TERM_BYTE).split()


def build_shards(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, hits, counts, held_hits = [], [], [], [], 0
        n_docs = n_terms = 0

        def shard() -> pa.RecordBatch:
            found = np.concatenate([np.empty(0, np.int64), *hits]) * len(ids) + np.repeat(np.arange(len(ids)), counts)
            keys, tfs = np.unique(found, return_counts=True)
            terms, dfs = np.unique(keys // max(1, len(ids)), return_counts=True)
            places = (keys % max(1, len(ids))).astype("<i4")
            row = [ids, np.array(lengths, "<i8").tobytes(), terms.tolist(), dfs.tolist(), places.tobytes(), tfs.astype("<i4").tobytes(), n_docs, n_terms]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = terms_of(text or "")
                n_docs += bool(words)
                n_terms += len(words)
                own = [vocabulary[w] for w in words if w in vocabulary]
                if own:
                    ids.append(doc)
                    lengths.append(len(words))
                    hits.append(np.array(own, np.int64))
                    counts.append(len(own))
                    held_hits += len(own)
                if len(ids) >= SHARD_DOCS or held_hits >= SHARD_HITS:
                    yield shard()
                    ids, lengths, hits, counts, held_hits, n_docs, n_terms = [], [], [], [], 0, 0, 0
        if n_docs:
            yield shard()

    names = ["docs", "lengths", "terms", "dfs", "places", "tfs", "n_docs", "n_terms"]
    types = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return arrow_map(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), run, SHARD)


class Query(NamedTuple):
    item: object
    terms: dict[int, int]  # term -> its weight, times its repeats in the query


class Postings(NamedTuple):
    docs: np.ndarray
    impacts: np.ndarray  # before the weight
    most: int


class Shard:
    """A shard's postings with the impacts that the statistics give."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = row["docs"]
        lengths = np.frombuffer(row["lengths"], "<i8").tolist()
        damp = np.array([8 * (25 + 75 * x * n // total) for x in lengths], np.int64)  # Python's integers: the product may pass 64 bits
        docs, tfs = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["tfs"], "<i4").astype(np.int64)
        impacts = 1_000_000_000 * tfs // (1000 * tfs + damp[docs])
        ends = np.cumsum([0, *row["dfs"]]).tolist()
        self.postings = {t: Postings(docs[i:j], impacts[i:j], int(impacts[i:j].max())) for t, i, j in zip(row["terms"], ends, ends[1:], strict=False)}
        self.walks: dict[int, tuple[array, list[int]]] = {}

    def walk(self, term: int) -> array:
        """A term's documents for single steps."""
        if term not in self.walks:
            self.walks[term] = array("i", self.postings[term].docs.tobytes())
        return self.walks[term]

    def score(self, query: Query, docs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for term, weight in query.terms.items():
            if found := self.postings.get(term):
                at = np.minimum(np.searchsorted(found.docs, docs), len(found.docs) - 1)
                out += np.where(found.docs[at] == docs, weight * found.impacts[at], 0)
        return out

    def seed(self, query: Query, k: int) -> list[int]:
        """Up to ``k`` scores that documents of this shard have: of those with the rarest terms."""
        docs = np.empty(0, np.int32)
        for term in sorted((t for t in query.terms if t in self.postings), key=lambda t: len(self.postings[t].docs)):
            docs = np.union1d(docs, self.postings[term].docs[: 4 * SEED_DOCS])
            if len(docs) >= SEED_DOCS:
                break
        scores = self.score(query, docs)
        return sorted(scores[scores > 0].tolist(), reverse=True)[:k]

    def wand(self, query: Query, k: int, threshold: int) -> list[tuple[int, int]]:
        """Best ``k`` (score, place) with a score of ``threshold`` at least."""
        cursors = [[found.docs[0].item(), t, 0, w * found.most, w] for t, w in query.terms.items() if w and (found := self.postings.get(t))]
        heap: list[tuple[int, int, int]] = []  # score, minus id, place: the worst first
        while cursors:
            cursors.sort()
            bound, pivot = 0, -1
            for i, c in enumerate(cursors):
                bound += c[3]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            if cursors[0][0] == doc:
                score, past, n = 0, doc + 1, 0
                for c in cursors:
                    if c[0] != doc:
                        break
                    score += c[4] * int(self.postings[c[1]].impacts[c[2]])
                    n += 1
                if score >= threshold:
                    found = self.ids[doc]
                    entry = (score, -(_LOWEST if found is None else found), doc)
                    if len(heap) < k:
                        heappush(heap, entry)
                    elif entry[:2] > heap[0][:2]:
                        heapreplace(heap, entry)
                    if len(heap) == k:
                        threshold = max(threshold, heap[0][0])
            else:
                past, n = doc, pivot
            ended = False
            for c in cursors[:n]:
                walk = self.walk(c[1])
                at = c[2] = bisect_left(walk, past, c[2])
                if at < len(walk):
                    c[0] = walk[at]
                else:
                    c[0], ended = -1, True
            if ended:
                cursors = [c for c in cursors if c[0] >= 0]
        return [(score, place) for score, _, place in heap]


def _queries(block: DataFrame, item_col: str, text_col: str) -> dict:
    """Item -> its terms with repeats; the rows of an item add up."""
    found: dict = defaultdict(Counter)
    for item, text in block.select(item_col, text_col).collect():
        found[item].update(terms_of(text or ""))
    return found


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``."""
    integer_ids(docs, id_col)
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    size = items.agg(F.sum(F.octet_length(F.col(f"`{item_text_col}`").cast("string")))).first()[0] or 0
    n_blocks = -(-size // block_bytes)
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, doc_id long, score long")
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64(f"`{item_col}`"), F.lit(n_blocks)) == b)
        out = out.unionByName(_block_hits(spark, docs, _queries(block, f"`{item_col}`", f"`{item_text_col}`"), k, id_col, text_col, kind))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _block_hits(spark: SparkSession, docs: DataFrame, texts: dict, k: int, id_col: str, text_col: str, kind) -> DataFrame:
    """``item_id, doc_id, score`` of every shard's heaps."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for x in texts.values() for w in x}))}
    shards = materialize(build_shards(docs, vocabulary, id_col, text_col), "shards")
    n, total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    dfs = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n).cast("long") + 2) / (2 * F.col("df") + 1)))
    weights = dict(dfs.select("term", weight.cast("long")).collect())  # at most the block's vocabulary
    terms = [(item, {vocabulary[w]: weights[vocabulary[w]] * m for w, m in found.items() if vocabulary[w] in weights}) for item, found in texts.items()]
    queries = [Query(item, found) for item, found in terms if found]
    arrow_kind = to_arrow_type(kind)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, n, total):
            found = [(i, score) for i, q in enumerate(queries) for score in shard.seed(q, k)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([s for _, s in found], pa.int64())], names=["query", "score"])

    ranks = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    reached = arrow_map(shards, seeds, "query int, score long").withColumn("rank", ranks).where(F.col("rank") <= k)
    floors = {r["query"]: r["floor"] for r in reached.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).collect()}

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, n, total):
            found = [(q.item, shard.ids[place], score) for i, q in enumerate(queries) for score, place in shard.wand(q, k, floors.get(i, 1))]
            columns = [pa.array([x[j] for x in found], t) for j, t in enumerate((arrow_kind, pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return arrow_map(shards, heaps, f"item_id {kind.simpleString()}, doc_id long, score long")


def _shards(batches: Iterator[pa.RecordBatch], n: int, total: int) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard(batch.slice(i, 1).to_pylist()[0], n, total)


def oracle_sql(k: int = 10) -> str:
    """The same for ``benchmark`` and ``documents`` in DuckDB."""
    terms = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS doc, doc_id, text FROM documents),
words AS (SELECT doc, doc_id, {terms} FROM numbered),
sizes AS (SELECT doc, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY doc),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {terms} FROM benchmark) GROUP BY item_id, term),
tfs AS (SELECT doc, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term),
damped AS (SELECT doc, doc_id, 100 - 75 + (75 * n * docs) // terms AS m FROM sizes, whole),
scores AS (
    SELECT a.item_id, t.doc, any_value(d.doc_id) AS doc_id, sum(a.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * d.m)))::BIGINT AS score
    FROM asked a JOIN tfs t USING (term) JOIN weights w USING (term) JOIN damped d ON d.doc = t.doc GROUP BY a.item_id, t.doc),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {k}"""
