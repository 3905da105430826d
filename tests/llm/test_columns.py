"""Columns of the input keep their values whatever they are called."""

import pytest
from pyspark.sql import functions as F

from lanegraph.llm import decontamination, host_reputation, near_dedup, packing, pu_quality, quality_rules, sentence_dedup, suffix_dedup, toxicity

from .conftest import prose

NAMES = "id tid tid2 id2 spans words lines pieces bucket many base rank at made ruled h g pos c n m w grp anchor body keys sig set_id component label k i x kind".split()
NAMES += [f"_{x}" for x in NAMES] + ["_w2", "_l", "_b", "Own"]


@pytest.fixture(scope="module")
def docs(spark):
    one = prose(1, 200) + ". " + prose(2, 90) + ". " + prose(3, 90) + ". "
    rows = [(k, t) for k, t in enumerate([one, one, prose(5, 150) + ". " + one, None, "", prose(6, 60)])]
    base = spark.createDataFrame(rows, "doc_id long, text string").withColumn("url", F.concat(F.lit("http://a.net/"), F.col("doc_id").cast("string")))
    return base.select("*", *[F.concat(F.lit(f"{x} "), F.col("doc_id").cast("string")).alias(x) for x in NAMES])


def labels(spark):
    return spark.createDataFrame([(0, 1, 1), (3, 0, 0), (5, 1, 0)], "doc_id long, toxic int, quality int")


OPERATORS = {
    "suffix_dedup": lambda s, d: suffix_dedup.deduplicate(d),
    "keep_firsts": lambda s, d: near_dedup.keep_firsts(d),
    "sentence_dedup": lambda s, d: sentence_dedup.deduplicate(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "pack": lambda s, d: packing.pack_documents(d),
    "ledger": lambda s, d: quality_rules.apply_policy(quality_rules.ledger(d)),
    "decontaminate": lambda s, d: decontamination.decontaminate(d, s.createDataFrame([(1, prose(2, 40))], "item_id long, text string")),
    "quality": lambda s, d: pu_quality.quality(d, labels(s)),
    "filter_urls": lambda s, d: host_reputation.filter_urls(d, s.createDataFrame([(1, 1)], "doc_id long, bad long"), key="doc_id"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_columns_pass(spark, docs, name):
    out = OPERATORS[name](spark, docs)
    rows = out.select("doc_id", *NAMES).collect()
    assert {r["doc_id"] for r in rows} >= {0, 3, 4, 5}
    assert all(r[x] == f"{x} {r['doc_id']}" for r in rows for x in NAMES)


@pytest.mark.parametrize("name", ["ledger", "pack", "suffix_dedup", "decontaminate"])
def test_results_are_the_same_without_them(spark, docs, name):
    plain = OPERATORS[name](spark, docs.select("doc_id", "text", "url"))
    many = OPERATORS[name](spark, docs).select(plain.columns)
    order = lambda df: sorted(map(str, df.collect()))
    if name == "pack":
        plain, many = plain.drop("sequence_id", "offset"), many.drop("sequence_id", "offset")
    assert order(plain) == order(many)
