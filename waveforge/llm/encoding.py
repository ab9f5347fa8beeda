"""Whole-text encoding with public vocabulary files.

:class:`WordEncoder` is for vocabularies whose pre-tokenizer drops white space: it is
a place where a text may be cut, so equal pieces need encoding once.  Where the
merges stand in the order of their ids, all distinct pieces of an array are encoded
in one call; pieces of unusual characters and other files go to the library.

:class:`ByteEncoder` is for byte-level vocabularies.  Its ids are those of the
``tokenizers`` library; where the file's merges stand in the order of their ids
(checked when it is loaded), the same merges are run by tiktoken, several times
faster.  Texts that hold an added token, and other kinds of files, go to the
library whole.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

# White space as the vocabularies' patterns see it (Unicode White_Space).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SAFE_CUT = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")
# The pre-token patterns of the vocabulary files.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_OR_LINE = regex.compile(_WORD_PATTERN + r"|\n")
# Pieces of these characters only are in normal form, print, and have lower case without context.
_PLAIN = "^[\x21-\x7e\u00a1-\u00ac\u00ae-\u024f]+$"
_END = "\0"  # ends a word or a part in the texts given to the merges
_PART = "\ue000<part>\ue000"  # stands between texts that are encoded in one call


def _byte_alphabet() -> list[str]:
    """Byte -> character of byte-level vocabularies: printable Latin-1 stays, the rest follows from U+0100 on."""
    same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in same else chr(next(rest)) for b in range(256)]


_ALPHABET = _byte_alphabet()


def segments(text: str, limit: int) -> list[str]:
    """Cut a text between a character and white space after it into parts of about ``limit`` characters.

    No pre-token of a byte-level vocabulary holds white space after another
    character, and the look-ahead of the white-space branch reads forward only,
    so the parts' ids are the text's ids.  A part without such a place stays longer.
    """
    parts, start = [], 0
    while len(text) - start > limit:
        found = _SAFE_CUT.search(text, start + limit - 1)
        if not found:
            break
        parts.append(text[start : found.end()])
        start = found.end()
    parts.append(text[start:])
    return parts


class WordEncoder:
    """Arrow arrays of texts -> all their ids and each text's offsets, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The distinct pieces between white space of a whole array are encoded once, in one call of
    the merges for all of them, and gathered by index.  Memory: the array, its pieces and ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.merges = None
        if _drops_space(spec) and (ranks := _word_ranks(spec["model"])):
            self.merges = tiktoken.Encoding("own", pat_str=f"[^{_END}]*{_END}", mergeable_ranks=ranks, special_tokens={})
            self.line = ranks[f"\n{_END}".encode()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.merges is None:
            rows = [self._library(x) if x else np.empty(0, self.dtype) for x in texts.to_pylist()]
            return np.concatenate([np.empty(0, self.dtype), *rows]), np.cumsum([0, *map(len, rows)])
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        ids, start, size = self._pieces(coded.dictionary)
        piece = np.asarray(coded.indices)
        n = size[piece]
        ends = np.cumsum(n)
        places = np.repeat(start[piece] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        bounds = np.asarray(lists.offsets).astype(np.int64)
        return ids[places], np.concatenate(([0], ends))[bounds - bounds[0]]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after another, and where each piece's ids start and how many they are."""
        plain = pc.match_substring_regex(pieces, _PLAIN)
        for added in self.added:
            plain = pc.and_not(plain, pc.match_substring(pieces, added))
        plain = np.asarray(plain.cast(pa.uint8())).astype(bool)
        start, size, all_ids, held = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        if plain.any():
            text = "\n".join(pieces.filter(pa.array(plain)).to_pylist()).lower() + "\n"
            ids = self.merges.encode_to_numpy(_END.join(_WORD_OR_LINE.findall(text)) + _END, disallowed_special=())
            line = ids == self.line  # the end of each piece, which has no line feed of its own
            ends = np.flatnonzero(line) - np.arange(np.count_nonzero(line))
            size[plain] = np.diff(ends, prepend=0)
            start[plain] = ends - size[plain]
            all_ids.append(ids[~line].astype(self.dtype))
            held = len(all_ids[0])
        rest = np.flatnonzero(~plain)
        for i, piece in zip(rest.tolist(), pieces.take(pa.array(rest)).to_pylist(), strict=True):
            if piece:
                all_ids.append(self._library(piece))
                start[i], size[i] = held, len(all_ids[-1])
                held += int(size[i])
        return np.concatenate([np.empty(0, self.dtype), *all_ids]), start, size

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)


def _word_ranks(model: dict) -> dict[bytes, int] | None:
    """bytes -> id of a vocabulary with an end-of-word mark whose merges stand in the order of their ids; None for any other.

    The mark becomes the byte ``_END``, which plain pieces don't hold: a word's last byte and the mark have a token of
    their own with an id below all merges, so they are joined first, as the vocabulary's units are.
    """
    mark = model.get("end_of_word_suffix")
    if model.get("type", "BPE") != "BPE" or not mark or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token")):
        return None
    to_byte = {c: b for b, c in enumerate(_ALPHABET)}

    def raw(token: str) -> bytes:
        last = token.endswith(mark)
        return bytes(to_byte[c] for c in (token[: -len(mark)] if last else token)) + _END.encode() * last

    merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
    vocab, units = model["vocab"], len(model["vocab"]) - len(merged)
    single = {x for x, i in vocab.items() if i < units}
    if any(vocab.get(x) != units + i for i, x in enumerate(merged)) or single != {*_ALPHABET, *(x + mark for x in _ALPHABET)}:
        return None
    try:
        ranks = {raw(x): i for x, i in vocab.items()}
    except KeyError:
        return None
    return ranks if len(ranks) == len(vocab) else None


def _drops_space(spec: dict) -> bool:
    """Whether each piece between white space has its ids by itself."""
    added, pre = spec.get("added_tokens") or [], spec.get("pre_tokenizer") or {}
    plain = not (spec.get("post_processor") or spec.get("truncation") or spec.get("padding"))
    plain &= not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in added)
    steps = pre.get("pretokenizers") or []
    norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []]
    return (
        plain
        and norm == ["NFC", "Replace", "Lowercase"]
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0]["behavior"] == "Removed"
        and steps[0]["invert"]
        and steps[0]["pattern"] == {"Regex": _WORD_PATTERN}
    )


class ByteEncoder:
    """Texts -> arrays of unsigned 32-bit ids, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.merges = None
        if ranks := _ranks(spec):
            self.part = max(ranks.values()) + 1
            self.merges = tiktoken.Encoding("own", pat_str=_BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={_PART: self.part})

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with one call of the merges for all that hold no added token."""
        out = [np.empty(0, np.uint32)] * len(texts)
        apart = [i for i, x in enumerate(texts) if x and (self.merges is None or _PART in x or any(t in x for t in self.added))]
        for i in apart:
            out[i] = self.encode(texts[i])
        apart = set(apart)
        joined = [i for i, x in enumerate(texts) if x and i not in apart]
        if joined:
            ids = self.merges.encode_to_numpy(_PART.join(texts[i] for i in joined), allowed_special={_PART}, disallowed_special=())
            ends = np.append(np.flatnonzero(ids == self.part), len(ids))
            for i, lo, hi in zip(joined, np.append(0, ends[:-1] + 1).tolist(), ends.tolist(), strict=True):
                out[i] = ids[lo:hi]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.merges is None or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.merges.encode_to_numpy(text, disallowed_special=())

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's own object, loaded when the first text needs it."""
        return Tokenizer.from_file(self.path)


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """bytes -> id of a byte-level vocabulary whose merges stand in the order of their ids; None for any other."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or any(spec.get(x) for x in ("normalizer", "post_processor", "truncation", "padding")):
        return None
    if model.get("type", "BPE") != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
    vocab, to_byte = model["vocab"], {c: b for b, c in enumerate(_ALPHABET)}
    if any(vocab.get(x) != 256 + i for i, x in enumerate(merged)) or len({*merged}) < len(merged):
        return None
    try:
        return {bytes(to_byte[c] for c in x): vocab[x] for x in [*_ALPHABET, *merged]}
    except KeyError:
        return None

