"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

`measures` gives the measured columns of a text, `THRESHOLDS` the bounds on them, and `verdict` turns
any such table into one boolean expression; no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.text import BLANKS, documents_of, let

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent words of prose, in small letters, for the stop-word ratio of texts in Latin script.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "as", "on", "are", "this", "be", "by", "from", "it", "at"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "est", "au"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "en", "que", "un", "una", "por", "con", "para", "se", "su", "al", "es", "no"],
    "it": ["il", "lo", "la", "i", "gli", "le", "di", "e", "che", "un", "una", "in", "per", "con", "non", "del", "della", "si", "è", "sono"],
    "pt": ["o", "a", "os", "as", "de", "do", "da", "e", "que", "em", "um", "uma", "para", "com", "não", "no", "na", "se", "por", "é"],
    "nl": ["de", "het", "een", "van", "en", "in", "is", "dat", "op", "te", "met", "voor", "niet", "zijn", "aan", "er", "om", "ook"],
}


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= numerator / denominator <= high; a text with denominator 0 or under `least`, or with a null numerator, passes."""

    numerator: str
    denominator: str
    low: float = float("-inf")
    high: float = float("inf")
    least: int = 1


#: Length, symbol, stop-word and line ratios of texts that are kept.
THRESHOLDS = (
    Rule("word_chars", "n_words", low=2.0, high=16.0),
    Rule("n_symbols", "n_words", high=0.25),
    Rule("n_symbols", "word_chars", high=0.1),
    Rule("n_stop_words", "n_words", low=0.03, least=40),  # null, and so passed, where most letters are not Latin
    Rule("n_dup_lines", "n_word_lines", high=0.5, least=4),
)


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window found twice or more: hash the windows, and only where some are equal sort
    them with their places; the places of equal ones then cover min(WINDOW, gap to the next place) words each.
    Windows are equal if their 64-bit hashes are."""
    n = F.size(words)
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))

    def beside(placed: Column) -> Column:
        return F.filter(placed, lambda x, k: (x["h"] == F.get(placed, k - 1)["h"]) | (x["h"] == F.get(placed, k + 1)["h"]))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.aggregate(
            F.sort_array(F.transform(let(placed, beside), lambda x: x["i"])),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(n > WINDOW, repeats).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules are made of; null and empty texts have zeros everywhere, n_stop_words is null
    for texts with more than one byte and a half a character.

    Each row is measured by itself: repeated rows and null ids come out as they went in.
    """
    rows = documents_of(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", words)
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    longest = max(map(len, stop)) + 2  # with a comma or two after it
    counted = rows.withColumn("lines", lines).select(
        "doc_id",
        _count(F.col("words")).alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (_count(F.col("lines")) - _count(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.when(F.octet_length("text") < 1.5 * F.length("text"), _count(F.filter("words", lambda w: (F.length(w) <= longest) & F.lower(F.rtrim(w, F.lit(".,"))).isin(stop)))).alias("n_stop_words"),
        _count(F.col("lines")).alias("n_word_lines"),
    )
    return counted


def verdict(rules: Sequence[Rule]) -> Column:
    """The table of rules as one boolean expression over the columns of measures()."""
    passed = F.lit(True)
    for r in rules:
        share = F.col(r.numerator) / F.nullif(F.col(r.denominator), F.lit(0))
        passed &= F.coalesce((F.col(r.denominator) < r.least) | share.between(r.low, r.high), F.lit(True))
    return passed


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measures() with base_failed (too short or too repetitive) and kept (not base_failed, and every rule passes)."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measures(docs, id_col, text_col).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
