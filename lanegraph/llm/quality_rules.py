"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
failure bit per rule; a policy is a named, versioned set of rules, that is a mask, and is
applied to the ledger without touching a text again. Ablations are bitwise aggregations
over the distinct bit patterns (at most 2^rules rows, whatever the corpus).

All in DataFrame functions; nothing shuffles but the ablation's counts.

Defined cases: null or empty text has no words, so every count is 0 and it fails
``few_words``; texts of any length are measured whole; repeated and equal rows are judged
alike and stay as many as they were; an empty table gives an empty ledger; columns of the
input other than the text are carried through whatever their names, but those of MEASURES,
fail_bits and kept are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import SPACES, let, spare_names, spaced_words, whole_text

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_marks")


@dataclass(frozen=True)
class Rule:
    """A named test; ``fails`` is true for a document that breaks it."""

    bit: int
    name: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


RULES = (
    Rule(0, "few_words", lambda: _c("n_words") < 50),
    Rule(1, "repeated_windows", lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
    Rule(2, "many_words", lambda: _c("n_words") > 1_000_000),
    Rule(3, "short_words", lambda: _c("word_chars") < 2 * _c("n_words")),
    Rule(4, "long_words", lambda: _c("word_chars") > 20 * _c("n_words")),
    Rule(5, "symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule(6, "repeated_lines", lambda: 100 * _c("n_dup_lines") > 60 * _c("n_lines")),
    Rule(7, "few_letters", lambda: 100 * _c("n_letters") < 60 * _c("word_chars")),
    Rule(8, "shouting", lambda: 100 * _c("n_upper") > 50 * _c("n_letters")),
    Rule(9, "exclaiming", lambda: 100 * _c("n_marks") > 30 * _c("n_words")),
)

#: Versioned policies: the rules a document must not break.
POLICIES = {
    "base/1": ("few_words", "repeated_windows"),
    "web/1": tuple(r.name for r in RULES),
    "web/1-lenient": ("few_words", "repeated_windows", "symbols", "few_letters"),
}


def mask(policy: str) -> int:
    """The policy's rules as bits."""
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match the negation of ``pattern``, by deleting the rest."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more, the first included."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(p: Column) -> Column:
            again = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, count))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, covered))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with MEASURES (all long)."""
    body = whole_text(text)
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    kept = [c for c in docs.columns if c != text and c.lower() not in MEASURES]
    per_word, lined = spare_names(docs.columns, "words", "lines")
    words = let(spaced_words(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("again")))
    per_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return docs.select(
        *kept,
        words.alias(per_word),
        per_line.alias(lined),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _count(body, r"[^\p{L}]+").alias("n_letters"),
        _count(body, r"[^\p{Lu}]+").alias("n_upper"),
        (F.length(body) - F.length(F.translate(body, "!", ""))).cast("long").alias("n_marks"),
    ).select(
        *kept,
        F.col(f"{per_word}.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col(f"{lined}.n").alias("n_lines"),
        F.col(f"{lined}.dup").alias("n_dup_lines"),
        F.col(f"{per_word}.again").alias("n_repeat_words"),
        "n_letters",
        "n_upper",
        "n_marks",
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """measure() plus ``fail_bits``: bit k is set where rule k fails."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: str = "web/1") -> DataFrame:
    """The ledger with ``kept`` under the policy; no text is read."""
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(book: DataFrame, policy: str = "web/1") -> DataFrame:
    """Per rule of the policy: how many fail it, fail it alone, and are kept without it."""
    own = mask(policy)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(own)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if own >> r.bit & 1])
    return (
        patterns.select("bits", "n", F.inline(rules))
        .groupBy("rule", "bit")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
        .drop("bit")
    )
