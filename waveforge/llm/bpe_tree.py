"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until parts are short; leaves are encoded alone.  Two
neighbours are joined by encoding a window around the seam afresh.  The window
grows until it starts and ends at *firm* places: between a character that is
not white space and white space after it.  No match of the pattern crosses a
firm place, on whichever side of it the text is cut, and the pattern's only
look-ahead reads forward across white space, which starts there; so the
matches outside the window are the same in the half and in the joined text,
and their tokens are final.  Where a side has no firm place the window takes
all of that side.  The join is associative, so any tree gives the ids of the
whole text.  Decoding maps every leaf's ids to bytes and concatenates.

Documents are rows of Arrow batches; nothing is shuffled.  Memory: one run of
texts and the ids of one text.

Cases: null text is the empty text (no ids); null ids stay null; repeated rows
stay rows; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import _SPACE
from .shared import arrow_map, held, slices

_FIRM = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


class TreeCodec:
    """The ids of a text by ranks and pattern, built up a tree; and back."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = 4096, window: int = 32):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf_chars, self.window = max(1, leaf_chars), max(1, window)

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.enc.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        a, b = self._firm_before(text, lo, mid), self._firm_after(text, mid, hi)
        tail = len(self.enc.encode_ordinary(text[a:mid]))
        head = len(self.enc.encode_ordinary(text[mid:b]))
        del left[len(left) - tail :]
        left += self.enc.encode_ordinary(text[a:b])
        left += right[head:]
        return left

    def _firm_before(self, text: str, lo: int, mid: int) -> int:
        width = self.window
        while mid - width > lo:
            if found := _FIRM.search(text, mid - width, mid):
                return found.start()
            width *= 2
        return lo

    def _firm_after(self, text: str, mid: int, hi: int) -> int:
        width = self.window
        while mid + width < hi:
            for found in _FIRM.finditer(text, mid + 1, mid + width):
                return found.start()
            width *= 2
        return hi

    def decode(self, ids: list[int], leaf: int = 4096) -> bytes:
        if len(ids) <= leaf:
            return self.enc.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: ``n_tokens``, ``ids_sha256`` of the decimal ids joined by commas and ``decoded_sha256`` of the decoded bytes.

    With ``keep_ids`` also the ids and the decoded bytes themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(TreeCodec, ranks_path, pattern)
        for batch in slices(batches, "text", 2 << 20):
            count, ids_hash, decoded_hash, all_ids, all_bytes = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text)
                decoded = codec.decode(ids)
                count.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                decoded_hash.append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
                    all_bytes.append(decoded)
            out = [batch.column("id"), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]
            if keep_ids:
                out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_bytes, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * keep_ids]
    return arrow_map(rows, run, schema, holds=True)
