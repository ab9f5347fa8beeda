"""Vector packing: limits, whole results and padding, against the library's ids."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waveforge.llm import vector_packing
from waveforge.llm.vector_packing import Pool, Run

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start int, length int, id string, texts string, bears boolean"
r = random.Random(2)
TEXTS = [None, "", " ", "one", "é́ <|endoftext|> it's", "x" * 9000, *(" ".join(r.choice(["wave", "Forge", "été", "1 2", "\n"]) for _ in range(int(r.paretovariate(0.8) * 6))) for _ in range(700))]



def check(pieces, expected, capacity, max_segments, max_loss):
    """Every id lies in one piece; sequences are gapless, within the limits and free of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc, wanted in expected.items():
        parts = sorted(by_doc.pop(doc), key=lambda p: p["start"])
        if len(wanted) == 1:
            (ids,) = wanted
            assert [p["start"] for p in parts] == list(np.cumsum([0] + [p["length"] for p in parts[:-1]]))
            assert sum(p["length"] for p in parts) == len(ids) and {p["doc_tokens"] for p in parts} == {len(ids)}
            for p in parts:
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        else:
            assert sum(p["length"] for p in parts) == sum(map(len, wanted))
    assert not by_doc
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == list(np.cumsum([0] + [p["length"] for p in parts[:-1]]))
        size = sum(p["length"] for p in parts)
        assert size == capacity or size < capacity and size & (size - 1) == 0
        assert len(parts) <= max_segments and sum(p["loss_tokens"] for p in parts) <= max_loss
    return by_sequence


@pytest.mark.parametrize("parts, max_segments, max_loss", [(1, 64, None), (5, 64, None), (2, 3, None), (2, 64, 700), (3, 1, 1)])
def test_pieces_hold_each_id_once_within_the_limits(spark, parts, max_segments, max_loss):
    texts = TEXTS if max_loss != 1 else TEXTS[:5]
    rows = [(i, t, 1, 1, "x", "t", False) for i, t in enumerate(texts)] + [(3, texts[3], 1, 1, "x", "t", False), (None, "null id", 1, 1, "x", "t", False)]
    tokenizer, expected = Tokenizer.from_file(PATH), defaultdict(list)
    for doc, text, *_ in rows:
        expected[doc].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    found = vector_packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(parts), PATH, max_segments=max_segments, max_loss=max_loss).collect()
    sequences = check(found, expected, 2048, max_segments, max_loss or 2048)
    if max_segments == 64 and max_loss is None:  # nearly all sequences are full: at most 11 a task are not
        assert len(sequences) <= sum(len(x) for ids in expected.values() for x in ids) / 2048 + 11 * parts


def test_conversations_keep_to_the_limit_on_answers(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", None if (c, t) == (3, 1) else "word " * (5 + c * t % 90)) for c in range(200) for t in range(c % 5)]
    examples = vector_packing.conversation_examples(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3))
    found = vector_packing.pack(examples, PATH, capacity=512, max_segments=6, max_loss=150, id_col="conv_id", parts_col="parts").collect()
    tokenizer, expected, bears = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(int)
    for c, t, role, text in sorted(turns, key=lambda x: x[:2]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        expected[c] += ids
        last = t == c % 5 - 1
        bears[c] += (len(ids) + last) * (role == "assistant")
    check(found, {c: [[*ids, 1]] for c, ids in expected.items()}, 512, 6, 150)
    for c, n in bears.items():
        assert sum(p["loss_tokens"] for p in found if p["doc_id"] == c) == n


def test_dot_product_chooses_by_the_scarce_dimension():
    def item(tokens, loss):
        return Run("d", 0, np.zeros(tokens, np.uint32), np.concatenate([[0], np.minimum(np.arange(1, tokens + 1), loss)]), tokens)

    pool = Pool(100, 10, 20)
    for demand in [(40, 20)] * 4 + [(60, 0)] * 4:
        pool.add(item(*demand))
    while pool.total[0]:  # one of each kind fills a sequence; two of one kind would not
        assert sorted(x.demand for x in pool.next_sequence()) == [(40, 20), (60, 0)]


def test_small_pools_give_whole_results_too(spark, monkeypatch):
    monkeypatch.setattr(vector_packing, "POOL_TOKENS", 5000)
    pool, seen = Pool(64, 4, 64), 0
    for n in range(1, 200):
        pool.add(Run(n, 0, np.zeros(n, np.uint32), None, n))
        while pool.total[0] > 1000:
            seen += sum(len(x.ids) for x in pool.next_sequence())
    while pool.total[0]:
        size = sum(len(x.ids) for x in pool.next_sequence())
        assert size <= 64 and size & (size - 1) == 0
        seen += size
    assert seen == sum(range(1, 200))


def test_empty_table_and_wrong_limits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_packing.pack(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        Pool(10, 0, 5)
    text_ids = empty.select(F.col("id").alias("doc_id"), "text")
    assert vector_packing.pack(text_ids, PATH).schema["doc_id"].dataType.simpleString() == "string"
