"""Collocations against plain counting in Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lanegraph.llm import phrases


def expected(rows, least, first):
    words, f, inside = Counter(), Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    for (lang, g), n in f.items():
        if n >= least:
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        inside[lang, g[i:j]] = max(inside[lang, g[i:j]], n)
    found = {}
    for (lang, g), a in f.items():
        if len(g) > 1 and a >= least and inside[lang, g] < a:
            score, k = min((1000 * a * words[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            found.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, r, x[2].decode(), -x[1], x[3], x[4], words[lang], -x[0]) for lang, v in found.items() for r, x in enumerate(sorted(v)[:first], 1))


def odd_rows():
    r, vocabulary = random.Random(2), [f"w{i}" for i in range(30)] + ["A", "É", "b\x00c", "日本", " "]
    rows = []
    for _ in range(400):
        words = [r.choice(vocabulary[: int(2 + 33 * r.random() ** 2)]) + r.choice(["", "", "", ".", ", ", "\t", " . ", " ?! ", "\n"]) for _ in range(r.randint(0, 60))]
        rows.append((r.choice(["en", "de", None, "und"]), r.choice([" ", "  ", " \t"]).join(words)))
    return rows + [("en", None), ("en", ""), (None, None), ("x", "\t .. \n")] + [("en", "the same piece here again")] * 300 + [("en", "a b " * 20_000)]


@pytest.mark.parametrize(("least", "first"), [(3, 2000), (20, 50)])
def test_collocations(spark, least, first):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"m": F.lit("x"), "phrase": F.lit(1), "f": F.lit(2)})
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=least, first=first).collect()) == expected(rows, least, first)


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_score_beyond_64_bits(spark):
    a, n = 3_000_000_000, 7_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 4_000_000_000), ("en", "b", 5_000_000_000), ("en", "a b", a)], "lang string, phrase string, f long")
    row = phrases.best_cuts(counts, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row.score == 1000 * a * n // (4_000_000_000 * 5_000_000_000)


def test_pieces_are_counted_once_each(spark):
    rows = [("en", "One two. one  two"), ("en", "one\ttwo"), (None, "one two")]
    got = {(r.lang, r.piece): r.m for r in phrases.pieces(spark.createDataFrame(rows, "lang string, text string")).collect()}
    assert got == {("en", "one two"): 3, ("und", "one two"): 1}


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = odd_rows()[:150]
    monkeypatch.setattr(phrases, "BITS", 6)
    assert sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5).collect()) == expected(rows, 5, 2000)
