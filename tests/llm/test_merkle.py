"""The Merkle manifest against a tree built level by level in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lanegraph.llm import merkle

FIELDS = ["doc_id", "lang", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """What remains of the nodes, and the siblings of each, level by level."""
    ways, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        for way, (k, i) in zip(ways, enumerate(at), strict=True):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            way += run[: i % 8] + run[i % 8 + 1 :]
            at[k] = i // 8
        level = [digest(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], ways


def expected(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for i, lang, text in rows:
        groups.setdefault(lang, []).append((i, digest(field(i), field(lang), field(text))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])),) for g in order}
    below = {g: tree([leaf for _, leaf in v]) for g, (v,) in trees.items()}
    if not order:
        return []
    root, above = tree([below[g][0] for g in order])
    return sorted(
        (str(i), leaf, below[g][0], root, digest(*way, *above[k])) for k, g in enumerate(order) for (i, leaf), way in zip(trees[g][0], below[g][1], strict=True)
    )


def made(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({"leaf": F.lit("x"), "g": F.lit(1), "pos": F.lit(2.5), "other": F.col("doc_id") % 7})
    out = merkle.manifest(docs, FIELDS, carry=("other",))
    assert out.columns == ["doc_id", "lang", "other", "leaf", "subroot", "root", "path"]
    checked = out.select("*", merkle.folded(F.col("leaf"), F.col("path")).alias("f"), F.sha2(merkle.siblings(F.col("path")).cast("binary"), 256).alias("p")).collect()
    assert all(r.f == r.root and r.other == (None if r.doc_id is None else r.doc_id % 7) for r in checked)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.p) for r in checked)


@pytest.mark.parametrize("sizes", [{"en": 4097, "de": 4096, None: 9, "x": 1}, {"a": 1}, {}, {chr(97 + i): i + 1 for i in range(12)}], ids=["blocks", "one", "none", "groups"])
def test_manifest(spark, sizes):
    r, rows = random.Random(1), []
    for lang, n in sizes.items():
        for i in range(n):
            rows.append((r.choice([i, i, None, 5]), lang, r.choice([None, "", "same", f"t{i % 50}é"])))
    assert made(spark, rows) == expected(rows)


def test_one_hot_key_and_long_text(spark):
    rows = [(7, "en", "copy")] * 600 + [(None, "en", None)] * 30 + [(1, None, "x" * 2_000_000), (1, None, "")]
    assert made(spark, rows) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 500])
def test_traversal(n):
    leaves = [digest(str(k)) for k in range(n)]
    height = next(h for h in range(9) if 8**h >= n)
    ways = [[(at, others) for at, others in way] for way in merkle.traversal(leaves, height)]
    root, below = tree(leaves)
    assert ["".join(x for _, x in way) for way in ways] == ["".join(x) for x in below]
    for leaf, way in zip(leaves, ways, strict=True):
        for at, others in way:
            leaf = digest(others[: 64 * at], leaf, others[64 * at :])
        assert leaf == root


def test_a_change_breaks_the_proof(spark):
    rows = [(i, "en", f"Text {i}") for i in range(20)]
    out = merkle.manifest(spark.createDataFrame(rows, "doc_id long, lang string, text string"), FIELDS)
    other = merkle.leaf_of(F.col("doc_id"), F.lit("en"), F.lit("text 3"))
    assert [r.ok for r in out.filter("doc_id = 3").select((merkle.folded(other, F.col("path")) == F.col("root")).alias("ok")).collect()] == [False]
