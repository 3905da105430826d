"""Exact search against comparing all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph.llm import exact_search


def expected(rows, k=20):
    by = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(64 * x) for x in v]
        by[i] = min(by.get(i, w), w)
    out = []
    for q, a in by.items():
        if q % 20 == 0:
            scores = sorted((-max(min(sum(x * y for x, y in zip(a, b, strict=False)), 2**63 - 1), -(2**63)), i) for i, b in by.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def vectors(n, dim, kind):
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    one = {"clusters": lambda: [x + r.gauss(0, 0.05) for x in r.choice(centres)], "ties": lambda: [r.choice([0.0, 0.02, -1.0]) for _ in range(dim)], "random": lambda: [r.gauss(0, 1) for _ in range(dim)]}[kind]
    return [(i, one()) for i in range(n)]


def odd():
    v = [(5, None), (None, [1.0, 2.0, 3.0, 4.0]), (400, [1.0, None, 2.0, 3.0]), (420, [math.nan] * 4), (440, [math.inf, 0.0, 0.0, 0.0]), (460, [1.0]), (480, []), (500, [1e17, -1e17, 3.0, 0.0])]
    return vectors(300, 4, "random") + v + [(501, [1e17, 1e16, 3.0, 0.0]), (20, [9.0] * 4), (0, [0.0] * 4), (-40, [-1.0, 2.0])] + vectors(100, 4, "random")


CASES = {
    "clusters": vectors(3000, 8, "clusters"), "ties": vectors(1500, 3, "ties"), "random": vectors(1200, 16, "random"), "odd": odd(), "few": vectors(21, 2, "random"), "one": vectors(1, 2, "random"),
    "none": [], "copies": [(i, [0.5, 0.25]) for i in range(900)], "empty vectors": [(i, []) for i in range(30)],
}


@pytest.mark.parametrize("name", list(CASES))
def test_search(spark, name):
    rows = spark.createDataFrame(CASES[name], "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1), "rank": F.lit(2), "score": F.lit(0)})
    assert sorted(tuple(r) for r in exact_search.search(rows, F.col("id") % 20 == 0).collect()) == expected(CASES[name])


def test_small_blocks(spark, monkeypatch):
    """Many blocks and short groups: what the bounds leave out is never among the best."""
    for name, size in (("BLOCK", 64), ("QUERIES", 3), ("GROUP", 8), ("SAMPLE", 600)):
        monkeypatch.setattr(exact_search, name, size)
    rows = CASES["clusters"][:1500]
    pairs, seen = exact_search._meeting, []
    monkeypatch.setattr(exact_search, "_meeting", lambda q, x: seen.append((q.count() * x.count(), pairs(q, x).count())) or pairs(q, x))
    assert sorted(tuple(r) for r in exact_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()) == expected(rows)
    assert seen[0][1] < 0.8 * seen[0][0]  # pairs of blocks were ruled out by their distances to the pivots


def test_bounds_hold():
    v = np.random.default_rng(0).integers(-60, 60, (300, 6))
    pivots = exact_search._pivots(v)
    d = np.sqrt(((v[:, None, :] - pivots[None]) ** 2).sum(2))
    gap = np.abs(d[:, None, :] - d[None]).max(2)
    norms = (v**2).sum(1)
    assert ((norms[:, None] + norms[None] - gap**2) / 2 >= v @ v.T - 1e-6).all()
