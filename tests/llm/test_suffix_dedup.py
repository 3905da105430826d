import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lanegraph.llm import suffix_dedup as s


def covered(texts, length, keep):
    at = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            at.setdefault(t[p : p + length], []).append((d, p))
    out = [np.zeros(len(t), bool) for t in texts]
    for places in at.values():
        for d, p in places[1:] if keep == "first" else places if len(places) > 1 else []:
            out[d][p : p + length] = True
    return out


def bits(runs, n):
    out = np.zeros(n, bool)
    for a, b in runs:
        out[a:b] = True
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.sampled_from([2, 3, 4, 8, 12, 16]), st.sampled_from(["first", "none"]))
def test_compare_is_brute_force(texts, length, keep):
    for runs, want in zip(s.compare(texts, length, keep), covered(texts, length, keep), strict=True):
        assert (bits(runs, len(want)) == want).all()


def test_large_batches_sort_alike():
    keys = np.random.default_rng(1).integers(0, 50, (1 << 20) + 5).astype(np.uint64)
    order, rank = s._ranked(keys)
    assert (np.diff(keys[order].astype(np.int64)) >= 0).all() and (rank == keys + 1).all()


def planted(seed=4):
    r = random.Random(seed)
    word = lambda n: "".join(r.choices("abcdefghij é", k=n))
    shared, edge = word(900), word(450)
    texts = [word(300) + shared + word(200), word(700), shared[100:800] + word(50), word(100) + edge, edge + word(10), edge[:399], word(60) + edge[:395] + word(60)]
    texts += [word(500) + shared[:420] + word(30)] * 2 + [None, "", "x"] + [word(120) + shared[250:700] + word(90) for _ in range(12)]
    return texts


def run(spark, texts, keep, monkeypatch=None, group=None):
    if group:
        monkeypatch.setattr(s, "GROUP", group)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in s.deduplicate(docs, keep=keep, whole_characters=False).collect()}
    data = [(t or "").encode() for t in texts]
    for k, want in enumerate(covered(data, s.LENGTH, keep)):
        have = bits([(x["start"], x["end"]) for x in got[k]["removed"]], len(want))
        assert (have == want).all(), k
        assert bytes(got[k]["kept_bytes"]) == bytes(np.frombuffer(data[k], np.uint8)[~want])


def test_documents_both_ways(spark):
    run(spark, planted(), "none")
    run(spark, planted(), "first")


def test_hot_groups_are_dealt(spark, monkeypatch):
    run(spark, planted(5), "none", monkeypatch, group=2)
    run(spark, planted(5), "first", monkeypatch, group=2)


def repeated(spark, texts, cut):
    """Rows repeated with their id and text are one place in the order, and are cut alike."""
    rows = [(k, t) for k, t in enumerate(texts) for _ in range(1 + k % 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], bytes(r["kept"])) for r in cut(docs).collect())
    data = [(t or "").encode() for t in texts]
    want = [bytes(np.frombuffer(d, np.uint8)[~gone]) for d, gone in zip(data, covered(data, s.LENGTH, "first"), strict=True)]
    assert got == [(k, want[k]) for k, t in rows if want[k] or not data[k]]


def sharing():
    r = random.Random(8)
    word = lambda n: "".join(r.choices("abcdefghij", k=n))
    shared = word(900)
    return [word(500), word(700) + shared + word(600), word(600) + shared + word(700), word(600) + shared[50:] + word(500), None, word(650) + shared[:600] + word(300)]


def test_repeated_rows_keep_their_own(spark, monkeypatch):
    cut = lambda docs: s.deduplicate(docs, keep="first", whole_characters=False).filter("n_bytes = 0 or octet_length(kept_bytes) > 0").select("doc_id", F.col("kept_bytes").alias("kept"))
    repeated(spark, sharing(), cut)
    monkeypatch.setattr(s, "GROUP", 1)
    repeated(spark, sharing(), cut)


def test_repeated_rows_through_the_stages(spark):
    def cut(docs):
        near = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        return corpus_pipeline.cut_repeated_strings(spark, near, "").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("kept"))

    repeated(spark, sharing(), lambda docs: cut(docs.withColumn("n_chars", F.length("text").cast("long"))))


def test_texts_of_one_id_keep_one_copy(spark, monkeypatch):
    r = random.Random(9)
    word = lambda n: "".join(r.choices("abcdefghij", k=n))
    shared = word(1500)
    texts = [word(299) + x + shared + x + word(299) for x in "XYZ"]
    for group in (1024, 1):
        monkeypatch.setattr(s, "GROUP", group)
        out = s.deduplicate(spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string"), keep="first", whole_characters=False)
        kept = sorted(bytes(x["kept_bytes"]) for x in out.collect())
        assert sum(shared.encode() in x for x in kept) == 1 and sum(len(x) for x in kept) == 3 * 600 + 1500


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(s, "PIECE", 1000)
    text = np.random.default_rng(1).integers(97, 123, 5000).astype(np.uint8).tobytes()
    starts = [w for _, a, b, _ in s.anchors(text, 400, s._Powers()) for w in range(a, b + 1)]
    assert starts == list(range(5000 - 400 + 1))


def test_odd_rows(spark, odd_docs, no_docs):
    out = s.deduplicate(odd_docs, keep="none")
    assert out.count() == odd_docs.count() and {"score", "n_words"} <= set(out.columns)
    gone = {r["doc_id"]: r["n"] for r in out.select("doc_id", s.n_removed().alias("n")).collect()}
    assert gone[5] > 0 and gone[6] > 0 and gone[7] == 0 and gone[0] == 0
    assert s.deduplicate(no_docs).count() == 0


def test_query_is_brute_force(spark):
    got = {r["doc_id"]: r for r in entry.queries()["op1_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    data = [(r["text"] or "").encode() for r in docs]
    for r, d, want in zip(docs, data, covered(data, 400, "none"), strict=True):
        own = got[r["doc_id"]]
        assert (own["n_bytes"], own["n_removed"]) == (len(d), want.sum())
        assert own["n_spans"] == int((np.diff(np.concatenate(([0], want.astype(int)))) == 1).sum())
        assert own["kept_sha256"] == hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~want])).hexdigest()
