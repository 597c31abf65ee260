"""Quality rules: a table of thresholds, compiled into one projection of built-in expressions.

Every measure is an expression on one text; nothing is exploded, shuffled or handed to Python. A null text counts as
empty. An empty table gives an empty result; other columns of the input pass through filter_documents() untouched and
can't clash, as the measures live in one struct whose name is made unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD_GAP, fresh, text_or_empty

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "with", "for", "this", "a", "be", "have",
    "de", "la", "le", "les", "et", "des", "du", "un", "une", "que", "en", "pour", "est",
    "el", "los", "las", "y", "del", "por", "con", "una", "se", "su",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "ein", "eine", "auf", "dem",
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; a bound that is None doesn't bind."""

    measure: str
    low: float | None
    high: float | None


#: Thresholds beyond the base rule; each can be replaced or dropped by the caller.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.10),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.50),
    Rule("alpha_word_ratio", 0.60, None),
    Rule("bullet_line_ratio", None, 0.90),
    Rule("ellipsis_line_ratio", None, 0.50),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word", "stop_word_ratio",
    "dup_line_ratio", "alpha_word_ratio", "bullet_line_ratio", "ellipsis_line_ratio",
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_word_count(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array; words must be cheap to refer to.

    The windows' hashes are sorted with their positions, so that equal ones are neighbours: n log n, whatever repeats.
    """
    n = F.size(words)

    def counted(hashes: Column) -> Column:
        def paired(order: Column) -> Column:
            met = F.filter(
                F.arrays_zip(order.alias("a"), F.slice(order, 2, F.greatest(F.size(order) - 1, F.lit(0))).alias("b")),
                lambda z: z["a"]["h"] == z["b"]["h"],
            )
            places = F.array_distinct(F.flatten(F.transform(met, lambda z: F.array(z["a"]["i"], z["b"]["i"]))))
            covered = F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))
            return F.size(F.array_distinct(covered))

        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(order, paired))

    window = F.arrays_zip(F.slice(words, 1, n - 2), F.slice(words, 2, n - 2), F.slice(words, 3, n - 2))
    hashes = F.transform(window, lambda z: F.xxhash64(z["0"], z["1"], z["2"]))
    return F.when(n < 4, F.lit(0)).otherwise(_let(hashes, counted)).cast("long")


def measures(text: Column) -> Column:
    """A struct of the counts and ratios of a text."""
    def of(words: Column, lines: Column) -> Column:
        n = F.size(words).cast("long")
        per_word = F.greatest(n, F.lit(1)).cast("double")
        chars = F.length(F.regexp_replace(text, WORD_GAP, "")).cast("long")
        symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
        dup = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
        per_line = F.greatest(F.size(lines), F.lit(1)).cast("double")
        share = lambda array, test, whole: F.size(F.filter(array, test)) / whole
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"),
            repeated_word_count(words).alias("n_repeat_words"),
            (chars / per_word).alias("mean_word_chars"), (symbols / per_word).alias("symbols_per_word"),
            share(words, lambda w: F.lower(w).isin(*STOP_WORDS), per_word).alias("stop_word_ratio"),
            (dup / per_line).alias("dup_line_ratio"),
            share(words, lambda w: w.rlike("\\p{L}"), per_word).alias("alpha_word_ratio"),
            share(lines, lambda x: x.rlike("^[ \\t]*[-*\u2022]"), per_line).alias("bullet_line_ratio"),
            share(lines, lambda x: x.rlike("(\\.\\.\\.|\u2026)[ \\t\\r]*$"), per_line).alias("ellipsis_line_ratio"),
        )

    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return _let(words, lambda w: _let(lines, lambda x: of(w, x)))


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, kept) from the struct of measures()."""
    failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)
    kept = ~failed
    for rule in rules:
        if rule.low is not None:
            kept &= m[rule.measure] >= F.lit(float(rule.low))
        if rule.high is not None:
            kept &= m[rule.measure] <= F.lit(float(rule.high))
    return failed, kept


def score_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with one struct column of all measures, base_failed and kept, named quality (or with a number, if taken)."""
    name = fresh("quality", docs.columns)

    def judged(m: Column) -> Column:
        failed, kept = verdict(m, rules)
        return F.struct(*[m[n].alias(n) for n in MEASURES], failed.alias("base_failed"), kept.alias("kept"))

    # one expression: a filter on a field of it computes the measures once
    return docs.withColumn(name, _let(measures(text_or_empty(text)), judged))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    scored = score_documents(docs, rules, text)
    name = scored.columns[-1]
    return scored.where(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
