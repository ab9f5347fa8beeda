"""Words and shingles of Arrow text batches as 64-bit hashes, a batch at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and each text's offsets among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    values = coded.dictionary
    ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4)
    data = memoryview(values.buffers()[2] or b"")
    digest = xxhash.xxh3_64_intdigest
    bounds = ends.tolist()
    table = np.fromiter((digest(data[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)), np.uint64, len(values))
    index = np.asarray(coded.indices)
    there = np.diff(ends)[index] > 0 if len(index) else np.zeros(0, bool)
    before = np.concatenate(([0], np.cumsum(there)))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return table[index[there]], before[offsets - offsets[0]]


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles; a text of fewer words is one shingle."""
    rolled = words.copy()
    for i in range(1, k):
        rolled[: len(words) - i] = rolled[: len(words) - i] * _ODD + words[i:]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        if hi - lo >= k:
            one = np.sort(rolled[lo : hi - k + 1])
            keep = np.empty(len(one), bool)
            keep[0] = True
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out.append(one[keep])
        elif hi > lo:
            whole = xxhash.xxh3_64_intdigest(words[lo:hi].tobytes(), seed=hi - lo)
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out
