"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled from a bounded
sample of labelled texts.  A text is compressed with every dictionary; the
language whose dictionary makes it smallest wins.  Long texts are compressed in
parts, so that the dictionary and not the text's own past explains each part;
the sizes are summed over the whole text.

``score`` is the relative margin of the best over the second best size, 0 to 1;
``rejected`` marks documents whose margin is under ``min_margin`` and those
without a letter.

Bounds: ``docs_per_language`` texts, of each at most ``excerpt_chars``
characters, at most ``dict_bytes`` a language; the dictionaries travel to the
tasks in the function itself (languages x ``dict_bytes``).  Prediction covers
every whole text and shuffles nothing.

Cases: null text or text without a letter: ``und``, score 0, rejected; without
any labelled text every document is ``und``; with one language that language
wins with score 1; ties go to the first language in sorted order; repeated rows
stay rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import arrow_map, slices

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def train_dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 160, excerpt_chars: int = 1024, dict_bytes: int = 112 << 10) -> dict[str, bytes]:
    """lang -> raw dictionary content, from the ``docs_per_language`` texts of lowest hash in each language."""
    ids = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    excerpt = F.substring(F.col(text_col), 1, excerpt_chars)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "excerpt")
    picked = (
        ids.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), excerpt.alias("excerpt"))
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= docs_per_language)
        .orderBy("lang", "n")
        .collect()
    )
    out: dict[str, bytes] = {}
    for row in picked:
        text = _fold(row["excerpt"]).encode() + b"\n"
        have = out.setdefault(row["lang"], b"")
        if len(have) + len(text) <= dict_bytes:
            out[row["lang"]] = have + text
    return {k: v for k, v in sorted(out.items()) if v}


def _fold(text: str) -> str:
    """Lower-case letters with single spaces between runs: marks and digits say little about the language."""
    return _OTHER.sub(" ", text.lower()).strip()


def _parts(text: str, limit: int) -> Iterator[bytes]:
    for i in range(0, len(text), limit):
        yield text[i : i + limit].encode()


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", part_chars: int = 4096, level: int = 3, min_margin: float = 0.003) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` (columns of these names are replaced)."""
    langs = list(dictionaries)
    new = ["lang_pred", "score", "rejected"]
    base = docs.drop(*new)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False))
        for batch in slices(batches, text_col):
            pred, score = [], []
            for text in batch.column(text_col).to_pylist():
                lang, margin = _best(text, langs, made, part_chars)
                pred.append(lang)
                score.append(margin)
            rejected = [a == "und" or b < min_margin for a, b in zip(pred, score, strict=True)]
            added = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *new])

    schema = StructType(list(base.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return arrow_map(base, predict, schema)


def _best(text: str | None, langs: list[str], made: list, part_chars: int) -> tuple[str, float]:
    if not text or not langs or not _LETTER.search(text):
        return "und", 0.0
    parts = list(_parts(_fold(text), part_chars))
    sizes = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in zip(langs, made, strict=True))
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], min(1.0, max(0.0, 1 - sizes[0][0] / max(1, sizes[1][0])))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a document is kept out of training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
