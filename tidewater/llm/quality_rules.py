"""Quality rules: a threshold table compiled into one Spark projection.

``measure`` computes per-document counts with built-in expressions only; ``RULES`` is the table of
thresholds over ratios of those counts, and ``verdict`` compiles any such table into one boolean
expression.  No user function, no shuffle: each document is judged where it is read.

Defined results: a null text counts as the empty text (no words, fails the base rule); repeated rows
give repeated results; an empty table gives an empty table; only ``doc_id`` and ``text`` are read,
so other columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, whole_text, words

# Frequent function words of the corpus languages.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "on", "be", "by", "this",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "pour", "dans", "qui", "au", "en", "sur",
    "der", "die", "das", "und", "ein", "den", "von", "zu", "mit", "ist", "nicht", "auf", "im", "für", "als", "sich",
    "el", "los", "las", "del", "y", "se", "por", "con", "su", "una", "no", "es", "lo",
]

# The threshold table: (metric, comparison, value); a document is kept when every line holds.
RULES: list[tuple[str, str, float]] = [
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 15.0),
    ("symbols_per_word", "<=", 0.25),
    ("stop_word_ratio", ">=", 0.02),
    ("dup_line_ratio", "<=", 0.5),
]

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PCT = 50


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _metrics() -> dict[str, Column]:
    return {
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "stop_word_ratio": _ratio("n_stop_words", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
    }


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    t = F.col("__t")
    w = F.col("__w")
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("__t"))
    split = base.select("doc_id", "__t", words(t).alias("__w"),
                        F.filter(F.split(t, "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]")).alias("__l"))
    n = F.size(w)
    grams = split.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3),
                                   lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("__g"))
    # Only documents that do repeat a window are sorted.
    g = F.col("__g")
    placed = grams.withColumn("__p", F.when(
        F.size(F.array_distinct(g)) < F.size(g),
        F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    p = F.col("__p")
    twice = placed.withColumn("__d", F.flatten(F.filter(
        F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))),
                   lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())))
    d = F.col("__d")
    covered = F.size(F.array_distinct(F.concat(d, F.transform(d, lambda i: i + 1), F.transform(d, lambda i: i + 2))))
    return twice.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                        F.when(p.isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"), "n_stop_words")


def verdict(rules: list[tuple[str, str, float]] = RULES) -> Column:
    """One boolean expression over the columns of ``measure`` for the whole table of rules."""
    metrics = _metrics()
    keep = F.lit(True)
    for name, how, value in rules:
        m = metrics[name]
        keep = keep & {">=": m >= value, "<=": m <= value}[how]
    return keep


def quality_rules(docs: DataFrame, rules: list[tuple[str, str, float]] = RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict and final verdict for every document."""
    m = measure(docs, id_col, text_col)
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(BASE_MAX_REPEAT_PCT) * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
