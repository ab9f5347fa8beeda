"""Token counts: lengths only, in Arrow batches balanced by bytes.

Each task cuts its rows into runs of about ``batch_bytes`` of text, cuts long
texts at safe places, encodes all parts of a run in one call of the library and
returns sums of lengths; no id leaves the worker.  No shuffle: a document is counted where it is read.

Cases: null and empty texts count 0 bytes and 0 tokens; null ids stay null;
repeated rows stay rows; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import ByteEncoder, segments
from .shared import arrow_map, held, slices


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20, part_chars: int = 1 << 16) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` of its whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held(ByteEncoder, tokenizer)
        for batch in slices(batches, "text", batch_bytes):
            texts = batch.column("text")
            # an added token may itself hold a place to cut, so texts with one stay whole
            cut = [[x] if not x or any(t in x for t in enc.added) else segments(x, part_chars) for x in texts.to_pylist()]
            lengths = np.fromiter(map(len, enc.encode_all([part for parts in cut for part in parts])), np.int64)
            tokens = np.add.reduceat(lengths, np.cumsum([0, *map(len, cut[:-1])]))
            sizes = pc.binary_length(texts).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(tokens)], names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, count, f"`{id_col}` {kind}, n_bytes long, n_tokens long", holds=True)
