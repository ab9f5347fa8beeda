r"""Quality rules, line first; DataFrame functions only.

Every line of a text is judged alone.  A line fails if it is

* navigation: several separators (``|``, ``>``, ``»``, ``·``) among few words, or a short menu entry,
* boilerplate: cookie and script notices, rights lines, placeholder text, calls to subscribe,
* badly punctuated: more than a fifth of its characters are symbols, or it is long and has no punctuation at all, or it has under four words and does not end like a sentence,
* equal to an earlier line.

Failing lines are removed; a document that loses more than ``max_lost`` of its
word characters is rejected, and so is one that fails the base checks (under 50
words, or over half of its words inside three-word windows found twice or more).

A text stays in its row: no shuffle.  Repeated windows are found by sorting a
text's own windows, O(n log n), and only where a window repeats.

Cases: null text counts as empty: all counts 0, ``base_failed``; blank lines are
neutral; repeated rows stay rows; columns of the result's names are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words and the symbols that are counted.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# Menu entries and boilerplate phrases, a line a language; further languages may be added to either list.
NAVIGATION = "(?iu)^\\W*(" + "|".join([
    r"home|menu|search|log ?in|sign (in|up)|next|previous|back to top|skip to (main )?content|read more|share|contact( us)?|about( us)?",
    r"startseite|menü|suche|anmelden|weiter|zurück|nach oben|mehr lesen|teilen|kontakt|über uns",
    r"accueil|recherche|connexion|suivant|précédent|haut de page|lire la suite|partager|à propos",
    r"inicio|menú|buscar|iniciar sesión|siguiente|anterior|volver arriba|leer más|compartir|contacto|acerca de",
]) + ")\\W*$"
BOILERPLATE = "(?iu)\\b(" + "|".join([
    r"we use cookies|accept (all )?cookies|enable javascript|javascript (is|must be) (disabled|enabled)|all rights reserved|terms (of (use|service)|and conditions)|privacy policy|lorem ipsum|subscribe to our|click here",
    r"wir verwenden cookies|alle rechte vorbehalten|allgemeine geschäftsbedingungen|hier klicken",
    r"nous utilisons des cookies|tous droits réservés|politique de confidentialité|cliquez ici",
    r"utilizamos cookies|todos los derechos reservados|política de privacidad|haga clic",
]) + ")\\b"
SEPARATORS = r"[|>»·•]"
SYMBOL_RE = r"[#*$%&|<>{}\[\]~^=+\\/_@]"
PUNCTUATION_RE = r"[.,;:!?…。，]"
SENTENCE_END_RE = r"[.!?…。:;,][\"')\]”’»]*\s*$"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE + "+"))


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails by itself."""
    bare = F.regexp_replace(line, SPACE_RE, "")
    n_words = F.size(_words(line))
    symbols = F.regexp_count(bare, F.lit(SYMBOL_RE))
    return (
        (symbols * 5 > F.length(bare))
        | ((n_words <= 20) & (F.regexp_count(line, F.lit(SEPARATORS)) >= 3))
        | line.rlike(BOILERPLATE)
        | ((n_words < 4) & (line.rlike(NAVIGATION) | ~line.rlike(SENTENCE_END_RE)))
        | ((n_words > 40) & ~line.rlike(PUNCTUATION_RE))
    )


def quality(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, max_lost: float = 0.5) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``clean_text``, ``lost`` (share of word characters), ``base_failed`` and ``kept``."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "lost", "base_failed", "kept"]
    work = ["_text", "_words", "_lines", "_grams", "_sorted", "_at", "_good"]
    base = docs.drop(*new, *work).withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    spaces = F.length(F.translate(F.col("_text"), SPACE, ""))
    step = base.select(
        "*",
        _words(F.col("_text")).alias("_words"),
        F.filter(F.split(F.col("_text"), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_lines"),
        spaces.cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate(F.col("_text"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    w = F.col("_words")
    grams = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    )
    step = step.select("*", grams.alias("_grams"), F.array_distinct("_lines").alias("_good"))
    repeats = F.size("_grams") > F.size(F.array_distinct("_grams"))
    placed = F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select(
        "*",
        F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_sorted"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_dup_lines"),
        n.cast("long").alias("n_words"),
    )
    s = F.col("_sorted")
    at = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    step = step.select(
        "*",
        F.array_sort(F.transform(at, lambda x: x["i"])).alias("_at"),
        F.array_join(F.filter("_good", lambda x: ~line_fails(x)), "\n").alias("clean_text"),
    )
    covered = F.aggregate(
        F.col("_at"),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    kept_chars = F.length(F.translate(F.col("clean_text"), SPACE, ""))
    step = step.select(
        "*",
        covered.cast("long").alias("n_repeat_words"),
        F.when(F.col("word_chars") == 0, F.lit(0.0)).otherwise(1 - kept_chars / F.col("word_chars")).alias("lost"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return step.select("*", failed.alias("base_failed"), (~failed & (F.col("lost") <= max_lost)).alias("kept")).drop(*work)


def oracle_sql(min_words: int = 50, max_repeat_percent: int = 50, max_lost: float = 0.5) -> str:
    """DuckDB SQL for the counts and verdicts of all ``documents``."""
    quoted = lambda x: "'" + x.replace("(?iu)", "(?i)").replace("'", "''") + "'"
    count = lambda text, pattern: f"len(regexp_extract_all({text}, {quoted(pattern)}))"
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents),
    w as (select doc_id, t, regexp_extract_all(t, {quoted(word)}) as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {quoted(word)})) as lines from d),
    grams as (select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
    repeated as (select doc_id, count(distinct place) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as place from (select *, count(*) over (partition by doc_id, g) as c from grams) where c > 1) group by doc_id),
    l as (select doc_id, line, regexp_replace(line, {quoted(SPACE_RE)}, '', 'g') as bare, {count('line', word)} as n from (select doc_id, unnest(list_distinct(lines)) as line from w)),
    good as (select doc_id, sum(length(bare)) as kept_chars from l where not ({count('bare', SYMBOL_RE)} * 5 > length(bare) or (n <= 20 and {count('line', SEPARATORS)} >= 3) or regexp_matches(line, {quoted(BOILERPLATE)})
      or (n < 4 and (regexp_matches(line, {quoted(NAVIGATION)}) or not regexp_matches(line, {quoted(SENTENCE_END_RE)}))) or (n > 40 and not regexp_matches(line, {quoted(PUNCTUATION_RE)}))) group by doc_id),
    b as (select doc_id, len(w) as n_words, length(regexp_replace(t, {quoted(SPACE_RE)}, '', 'g')) as word_chars, {count('t', '[#*$%&|<>]')} as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(kept_chars, 0) as kept_chars
      from w left join repeated using (doc_id) left join good using (doc_id)),
    f as (select *, n_words < {min_words} or 100 * n_repeat_words > {max_repeat_percent} * n_words as base_failed from b)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and case when word_chars = 0 then 0.0 else 1 - kept_chars / word_chars end <= {max_lost} as kept from f"""
