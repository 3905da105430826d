"""Every stage of the pipeline against a brute-force version of it, on planted cases and odd rows."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lanegraph.llm import packing

from .conftest import prose
from .test_near_dedup import brute
from .test_others import brute_hits, gapless
from .test_suffix_dedup import covered

SMALL = "/root/testdata/sf0.001"
FIRST = 1_000_000


def planted(spark):
    """Documents of the smallest table and, with ids from FIRST on, copies, near copies, shared passages, benchmark passages and odd rows."""
    r = random.Random(6)
    items = [x["text"] for x in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect()]
    item = max((x for x in items if x), key=len)
    base, passage = prose(70, 300), prose(71, 60)
    near = base.split()
    near[5] = near[200] = "other"
    texts = [base, base, " ".join(near), None, "", " \n ", "one two"]
    texts += [f"{prose(80 + k, 50)} {passage} {prose(90 + k, 50)}" for k in range(5)]
    texts += [f"{prose(60 + k, 40)} {item} {prose(50 + k, 40)}" for k in range(2)] + [prose(40 + k, r.randint(30, 400)) for k in range(10)]
    rows = [(FIRST + k, t, "en", "planted", None if t is None else len(t)) for k, t in enumerate(texts)]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(3), passage


@pytest.fixture(scope="module")
def stages(spark):
    """(documents, passage, rows kept after each stage)."""
    docs, passage = planted(spark)
    kept, out = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, kept, SMALL), f"test-{name}")
        assert after.columns == docs.columns
        kept = after
        out.append({r["doc_id"]: r["text"] for r in kept.collect()})
        assert kept.count() == len(out[-1])
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
    return {r["doc_id"]: r["text"] for r in docs.collect()}, passage, out, packed


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]


def test_clean_documents_are_kept_by_toxicity(stages):
    docs, _, (clean, *_), _ = stages
    assert {k for k in docs if k >= FIRST} <= set(clean) and all(clean[k] == docs[k] for k in clean)
    assert 0.8 * len(docs) < len(clean) <= len(docs)


def test_one_of_each_near_group_stays(stages):
    _, _, (clean, unique, *_), _ = stages
    root = brute(sorted(clean.items()))
    assert set(unique) == {k for k in clean if root[k] == k} and all(unique[k] == clean[k] for k in unique)
    assert FIRST in unique and FIRST + 1 not in unique and FIRST + 2 not in unique


def test_repeated_strings_are_cut_but_the_first(stages):
    _, passage, (_, unique, cut, _), _ = stages
    keys = sorted(unique)
    data = [(unique[k] or "").encode() for k in keys]
    for k, d, gone in zip(keys, data, covered(data, corpus_pipeline.REPEATED_BYTES, "first"), strict=True):
        left = bytes(np.frombuffer(d, np.uint8)[~gone]).decode("utf-8", "ignore") if len(d) else ""
        if d and not left:
            assert k not in cut
        elif unique[k] is None:
            assert cut[k] is None
        elif cut[k] != left:  # whole characters stay where a cut would part them
            assert len(cut[k]) - len(left) <= 4 * (1 + int(np.diff(gone.astype(int)).clip(0).sum()))
    assert len(passage.split()) > 50 and sum(passage in (t or "") for t in unique.values()) == 5
    assert sum(passage in (t or "") for t in cut.values()) == 1


def test_benchmark_passages_go(stages, spark):
    _, _, (_, _, cut, pure), _ = stages
    items = [(r["item_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = {k for k, t in cut.items() if brute_hits((t or "").encode(), items)[0]}
    assert set(pure) == set(cut) - hit and len(hit) >= 1 and all(pure[k] == cut[k] for k in pure)


def test_packing_holds_all_that_is_left(stages):
    *_, (*_, pure), packed = stages
    encode, by = packing.encoder(packing.vocabulary_path()), {}
    for x in packed:
        by.setdefault(x["doc_id"], []).append(x)
    assert set(by) == set(pure)
    for k, t in pure.items():
        ids = np.array([*encode(t or ""), 0], "<u4")
        assert sum(x["length"] for x in by[k]) == len(ids) and all(zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"] for x in by[k])
    gapless(packed)


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        docs = corpus_pipeline.materialize(out, f"test-none-{name}") if name != "packing" else docs


def test_rows_repeated_with_their_id(spark):
    """They are one document: kept or dropped together, cut alike, packed each."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    kept = docs.union(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, SMALL), f"test-twice-{name}")
        n = {r["doc_id"]: r["count"] for r in kept.groupBy("doc_id").count().collect()}
        assert set(n.values()) == {2} and len({(r["doc_id"], r["text"]) for r in kept.collect()}) == len(n)
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
    gapless(out)
