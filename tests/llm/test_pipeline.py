"""Each stage of the corpus pipeline, and the chain, against brute force on a fixture with nulls, repeats and clashing columns."""

import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F
from tests.llm.test_text_operators import brute_components, check_packing, edited
from tokenizers import Tokenizer

import corpus_pipeline
from waveforge.llm import language_id, quality_rules, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, score string, lang_pred int, _id int, id int, start string, spans int, input_0 int, clean_text string, rejected string"
CLASH = ("k", "w", "sc", 3, 4, 5, "st", 6, 7, "ct", "re")
WORDS = {
    "aa": "the of and tion ing her with that from have this which their would there about other into more some".split(),
    "bb": "der und die schen ung keit nicht eine mit auch sich werden durch über zwischen wenn oder noch sehr gegen".split(),
}


def prose(n, lang, seed):
    """Sentences on lines of some ten words that no other seed makes."""
    r, out = random.Random(seed), []
    for i in range(n):
        out.append(r.choice(WORDS[lang]) + r.choice(WORDS[lang]) + (".\n" if i % 10 == 9 else ""))
    return " ".join(out).replace("\n ", "\n") + "."


PASSAGE = prose(75, "aa", 999)
BASE = prose(200, "bb", 500)
TEXTS = [
    *((prose(150, "aa", i), "aa") for i in range(30)), *((prose(150, "bb", 100 + i), "bb") for i in range(30)),
    (BASE, "bb"), (BASE, None), (edited(BASE, 3, 1), "bb"), (prose(90, "aa", 300) + "\n" + PASSAGE, "aa"), (PASSAGE + "\n" + prose(125, "aa", 301), "aa"),
    (None, "aa"), ("", "aa"), ("12345 678", "bb"), ("zwei Worte.", "bb"), ("home\nmenu\n" + prose(80, "aa", 302), "aa"), (" | ".join(["menu"] * 80), "aa"), (prose(3000, "bb", 303), None),
]
ROWS = [(i, t, lang, "s", 1, *CLASH) for i, (t, lang) in enumerate(TEXTS)] + [(3, TEXTS[3][0], "aa", "s", 1, *CLASH), (None, prose(100, "aa", 304), "aa", "s", 1, *CLASH)]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs, out = shared.materialize(spark.createDataFrame(ROWS, SCHEMA).repartition(3), "raw"), {}
    for name, stage in corpus_pipeline.STAGES:
        got = shared.materialize(stage(spark, docs, ""), name)
        out[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in got.collect()], got.columns)
        docs = got
    return out


def same_rows(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


def test_columns_pass_through(stages):
    for name, (_, rows, columns) in list(stages.items())[:-1]:
        assert columns == [x.split()[0] for x in SCHEMA.split(", ")], name
        assert rows and all(r[5:] == CLASH for r in rows), name


def test_language_stage(spark, stages):
    before, after, columns = stages["language_id"]
    train = spark.createDataFrame(before, SCHEMA).where(~language_id.held_out())
    made = {}
    for lang, content in language_id.train_dictionaries(train).items():
        made[lang] = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
    assert set(made) == {"aa", "bb"}

    def stays(text):
        if not text or not re.search(r"[^\W\d_]", text):
            return False
        folded = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
        sizes = sorted(sum(len(c.compress(folded[i : i + 4096].encode())) for i in range(0, len(folded), 4096)) for c in made.values())
        return 1 - sizes[0] / sizes[1] >= 0.003

    assert same_rows(after, [r for r in before if stays(r[1])])
    assert {r[0] for r in before} - {r[0] for r in after} >= {65, 66, 67}


def test_quality_stage(stages):
    before, after, _ = stages["quality_rules"]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    pattern = lambda x: re.compile(x.replace("(?iu)", "(?i)"), re.ASCII)

    def fails(line):
        bare, n = re.sub(r"[\x20\x09-\x0D]", "", line), len(word.findall(line))
        return (
            len(re.findall(quality_rules.SYMBOL_RE, bare)) * 5 > len(bare) or (n <= 20 and len(re.findall(quality_rules.SEPARATORS, line)) >= 3) or pattern(quality_rules.BOILERPLATE).search(line)
            or (n < 4 and (pattern(quality_rules.NAVIGATION).search(line) or not re.search(quality_rules.SENTENCE_END_RE, line))) or (n > 40 and not re.search(quality_rules.PUNCTUATION_RE, line))
        )

    want = []
    for r in before:
        w = word.findall(r[1])
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeated = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
        lines = list(dict.fromkeys(x for x in r[1].split("\n") if word.search(x)))
        clean = "\n".join(x for x in lines if not fails(x))
        chars = lambda t: sum(map(len, word.findall(t)))
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 1 - chars(clean) / chars(r[1]) <= 0.5:
            want.append((r[0], clean, *r[2:4], len(clean), *r[5:]))
    assert same_rows(after, want)
    assert 68 not in {r[0] for r in after} and len(after) > 60


def test_join_stage(stages):
    before, after, _ = stages["jaccard_join"]
    component = brute_components([(r[0], r[1]) for r in before if r[0] is not None])
    assert same_rows(after, [r for r in before if r[0] is None or component[r[0]][1] == r[0]])
    assert {60} <= {r[0] for r in after} and not {61, 62} & {r[0] for r in after}


def test_passage_stage(stages):
    before, after, _ = stages["substring_dedup"]
    text = {r[0]: r[1] for r in after}
    changed = {r[0] for r in before if text.get(r[0]) != r[1]}
    assert changed == {64}
    assert text[64].split() == prose(125, "aa", 301).split() and next(r[4] for r in after if r[0] == 64) == len(text[64])
    assert same_rows([r for r in after if r[0] != 64], [r for r in before if r[0] != 64])


def test_packing_stage(stages):
    import public_tokenizers

    before, after, columns = stages["best_fit_packing"]
    rows = [dict(zip(columns, r, strict=True)) for r in after]
    assert check_packing(rows, 1024) <= 1.1 * sum(r["length"] for r in rows) / 1024 + 1
    enc, held = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in rows:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
    want = {}
    for r in before:
        want[r[0]] = want.get(r[0], 0) + len(enc.encode(r[1], add_special_tokens=False).ids) + 1
    assert held == want


def test_chain_and_empty_table(spark, stages, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect()
    _, want, columns = stages["best_fit_packing"]
    at = [columns.index(c) for c in ("doc_id", "piece", "length", "ids_crc32")]
    assert same_rows(map(tuple, got), [tuple(r[i] for i in at) for r in want])
    (tmp_path / "empty").mkdir()
    docs.where(F.lit(False)).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
