"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is an expression over the text.  A rule's cost (seconds) and selectivity
(part of rows it rejects) are measured on a bounded sample; rules are then put in
order of rejection per cost and become one CASE expression, so a text that an early
rule rejects never pays for the later ones.  The order decides how fast the verdict
comes, never what it is.

Defined cases: a null text has no words; a text without words fails the
least-words rule; repeated rows are judged alike; an empty table gives an empty
result (and the rules stay in the order given).  Other columns stay untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelcat.llm.common import SPACES, word_count

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SAMPLE_ROWS = 500


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, SPACES, "")).cast("long")


def n_chars_of(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.char_length(F.translate(x, SPACES, "")) > 0)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return _bind(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def n_repeat_words(found: Column) -> Column:
    """Words of an array that lie in 3-word windows which occur at least twice.

    Windows are compared by a 64-bit hash within one text.  Texts whose windows all
    differ are done with one distinct; else (hash, place) pairs are sorted and the
    places of equal neighbours counted, each covering the words not covered before.
    """
    def marked(pairs: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(pairs) - 1)
        twice = F.filter(at, lambda j: F.coalesce(pairs[j]["h"] == F.get(pairs, j - 1)["h"], F.lit(False)) | F.coalesce(pairs[j]["h"] == F.get(pairs, j + 1)["h"], F.lit(False)))
        places = F.sort_array(F.transform(twice, lambda j: pairs[j]["i"]))
        return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                           lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    def counted(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_bind(pairs, marked))

    windows = F.transform(F.sequence(F.lit(0), F.size(found) - 3), lambda i: F.xxhash64(found[i], found[i + 1], found[i + 2]))
    return F.when(F.size(found) < 4, 0).otherwise(_bind(windows, counted)).cast("long")


class Measures:
    """Measures of a text as columns: those in ``known`` are there already, others are computed where a rule asks."""

    def __init__(self, text: Column, known: dict[str, Column] | None = None):
        self.text, self.known = text, known or {}

    def __getattr__(self, name: str) -> Column:
        return self.known[name] if name in self.known else _MEASURES[name](self.text)


_MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": word_count,
    "word_chars": word_chars,
    "n_symbols": lambda t: n_chars_of(t, SYMBOLS),
    "n_capitals": lambda t: n_chars_of(t, CAPITALS),
    "n_marks": lambda t: n_chars_of(t, "!"),
    "n_lines": lambda t: F.size(_lines(t)).cast("long"),
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": lambda t: _bind(words(t), n_repeat_words),
}


@dataclass(frozen=True)
class Rule:
    """``rejects``: measures of a text -> boolean column."""

    name: str
    rejects: Callable[[Measures], Column]


LEAST_WORDS = Rule("least_words", lambda m: m.n_words < 50)
REPEATS = Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words)
SYMBOL_RATIO = Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words)
SHOUTING = Rule("capitals", lambda m: 10 * m.n_capitals > 3 * m.word_chars)
EXCLAIMING = Rule("exclamation_marks", lambda m: 10 * m.n_marks > m.n_words)
SAME_LINES = Rule("duplicate_lines", lambda m: 2 * m.n_dup_lines > m.n_lines)
WORD_LENGTH = Rule("word_length", lambda m: ~m.word_chars.between(2 * m.n_words, 15 * m.n_words))
#: beyond the two base rules
FURTHER = (SYMBOL_RATIO, SHOUTING, EXCLAIMING, SAME_LINES, WORD_LENGTH)
RULES = (LEAST_WORDS, REPEATS, *FURTHER)


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, part rejected) by rejection per cost, measured on at most ``sample_rows`` rows."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("_text")
    rows = docs.select(text).take(sample_rows)  # as many input splits as that takes, not all of them
    sample = docs.sparkSession.createDataFrame(rows, "_text string").persist()

    def measured(rejects: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        n, gone = sample.agg(F.count(F.lit(1)), F.count_if(rejects)).first()
        return time.perf_counter() - began, n, gone

    try:
        measured(F.lit(False))
        floor = measured(F.lit(False))[0]
        out = []
        for r in rules:
            took, n, gone = measured(r.rejects(Measures(F.col("_text"))))
            out.append((r, max(took - floor, 1e-4), gone / n if n else 0.0))
    finally:
        sample.unpersist()
    return sorted(out, key=lambda x: -x[2] / x[1])


def verdict(measures: Measures, rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """Name of the first rule in order that rejects the text; null if none does.  Later rules aren't evaluated."""
    out = F.when(F.lit(False), F.lit(""))
    for r in rules:
        out = out.when(r.rejects(measures), F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects."""
    order = [r for r, _, _ in ordered_rules(docs, rules, sample_rows)]
    return docs.where(verdict(Measures(F.coalesce(F.col("text"), F.lit(""))), order).isNull())


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = FURTHER, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for every row.

    The base measures are results here, so they are computed for every text; the
    cascade of further rules runs only on texts that pass the base rules.
    """
    order = [r for r, _, _ in ordered_rules(docs, rules, sample_rows)]
    text = F.col("_text")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    parts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("_words", words(text))
    own = {"n_words": F.size("_words").cast("long"), "n_repeat_words": n_repeat_words(F.col("_words"))}
    measured = parts.select("doc_id", "_text", *((own[n] if n in own else _MEASURES[n](text)).alias(n) for n in base))
    known = Measures(text, {n: F.col(n) for n in base})
    failed = LEAST_WORDS.rejects(known) | REPEATS.rejects(known)
    return measured.withColumn("base_failed", failed).select(
        "doc_id", *base, "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(known, order).isNull()).alias("kept"))
