import itertools
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanegraph.llm import decontamination as d
from lanegraph.llm import host_reputation as h
from lanegraph.llm import packing as p
from lanegraph.llm import pu_quality as q
from lanegraph.llm import quality_rules as r
from lanegraph.llm import toxicity as t

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


# toxicity


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5).filter(bool), max_size=40))
def test_segments_are_maximal(scores):
    """Against the recursive definition: the best contiguous run, then the same left and right of it."""

    def best(lo, hi):
        top = None
        for a, b in itertools.combinations(range(lo, hi + 1), 2):
            s = sum(scores[a:b])
            if s > 0 and (top is None or s > top[0] or (s == top[0] and b - a < top[2] - top[1])):
                top = (s, a, b)
        return [] if top is None else best(lo, top[1]) + [(top[1], top[2], top[0])] + best(top[2], hi)

    got = t.segments(np.array(scores, float))
    want = best(0, len(scores))
    assert sum(s for *_, s in got) == sum(s for *_, s in want)
    assert all(s == sum(scores[a:b]) for a, b, s in got)
    assert max((s for *_, s in got), default=0) == max((s for *_, s in want), default=0)


def accuracy(spark, name):
    import __spark_entry__ as entry

    label = {"op5_toxicity": "toxic", "op9_pu_quality": "quality"}[name]
    out = entry.queries()[name](spark, LARGER).filter("held_out").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").toPandas()
    return (out.predicted == out[label]).mean(), (out.predicted[out[label] == 1] == 1).mean(), (out.predicted[out[label] == 0] == 0).mean()


def test_toxicity_held_out(spark):
    right, caught, clean = accuracy(spark, "op5_toxicity")
    assert right > 0.97 and caught > 0.85 and clean > 0.99


def test_quality_held_out(spark):
    right, kept, junk = accuracy(spark, "op9_pu_quality")
    assert right > 0.95 and kept > 0.97 and junk > 0.75


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_prior_without_negatives(prior):
    """Two overlapping clouds: the share of one among the mixture, from it and the mixture alone."""
    r = np.random.default_rng(3)
    cloud = lambda n, at: r.normal(at, 1, (n, 4))
    pos = cloud(3000, 1.2)
    web = np.concatenate([cloud(int(6000 * prior), 1.2), cloud(6000 - int(6000 * prior), -1.2)])
    assert abs(q.estimate_prior(pos, web) - prior) < 0.06


def test_negatives_are_not_used(spark):
    """Labels of 0 say nothing to the learner: the same scores without them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    score = lambda x: sorted((r["doc_id"], round(r["score"], 9)) for r in q.quality(docs, x).select("doc_id", "score").collect())
    assert score(labels) == score(labels.filter("quality = 1"))


def test_models_take_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (4, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    none = labels.limit(0)
    for docs, known in itertools.product((odd_docs, no_docs), (labels, none)):
        for out in (t.toxicity(docs, known), q.quality(docs, known)):
            rows = out.collect()
            assert len(rows) == docs.count() and all(0 <= x["score"] <= 1 for x in rows)
            again = {}
            for x in rows:  # equal texts are scored alike, null as empty
                assert again.setdefault(x["text"] or "", x["score"]) == x["score"]
    assert {x["score"] for x in q.quality(odd_docs, none).collect()} == {0.5}
    assert all(x["score"] < 0.5 for x in t.toxicity(odd_docs, none).collect())
    for toxic in (0, 1):  # of one label alone, every score lies on its side
        one = spark.createDataFrame([(k, toxic, 1) for k in range(3, 10)], labels.schema)
        assert {x["score"] >= 0.5 for x in t.toxicity(odd_docs, one).collect()} == {bool(toxic)}


# packing


def test_pieces_and_ids(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(p.vocabulary_path())
    texts = {x["doc_id"]: x["text"] or "" for x in odd_docs.collect()}
    out = p.pack_documents(odd_docs, keep_ids=True).collect()
    for k, text in texts.items():
        mine = sorted((x for x in out if x["doc_id"] == k), key=lambda x: x["piece"])
        copies = 2 if k == 5 else 1
        want = np.array([*slow.encode(text, add_special_tokens=False).ids, 0], "<u4")
        first = mine[::copies]
        assert b"".join(bytes(x["ids"]) for x in first) == want.tobytes()
        assert [x["length"] for x in first][1:] == [2048] * (len(first) - 1)
        assert all(zlib.crc32(bytes(x["ids"])) == x["ids_crc32"] for x in first)
        assert [x["start"] for x in first] == list(np.cumsum([0] + [x["length"] for x in first])[:-1])
    gapless(out)
    assert p.pack_documents(no_docs).count() == 0


def gapless(rows):
    by = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_search_is_bounded_in_memory():
    """2047 lengths and 300,000 pieces, as the widest histogram has them."""
    r = np.random.default_rng(1)
    hist = dict(zip(*(x.tolist() for x in np.unique(r.integers(1, 2048, 300_000), return_counts=True)), strict=True))
    tracemalloc.start()
    got = p.complete_bins(hist)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    used = {}
    for filling, n in got:
        assert sum(x * c for x, c in filling.items()) <= 2048
        for x, c in filling.items():
            used[x] = used.get(x, 0) + c * n
    assert used == hist


def test_fillings_are_all_the_undominated():
    counts = {1: 1, 2: 1, 3: 3, 4: 2, 9: 2}
    got = [f for _, f in p._fillings(counts, 20)]
    want = set()
    for a, b, c, d in itertools.product(range(2), range(2), range(4), range(3)):
        for e in (1, 2):
            f = {1: a, 2: b, 3: c, 4: d, 9: e}
            room = 20 - sum(x * n for x, n in f.items())
            if room >= 0 and not any(n < counts[x] and x <= room for x, n in f.items()):
                want.add(tuple(sorted((x, n) for x, n in f.items() if n)))
    assert len(got) == len(want) and {tuple(sorted(f.items())) for f in got} == want
    assert [sum(x * n for x, n in f.items()) for f in got] == sorted((sum(x * n for x, n in f.items()) for f in got), reverse=True)


def test_ids_of_a_whole_table_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    slow, quick = Tokenizer.from_file(p.vocabulary_path()), p.encoder(p.vocabulary_path())
    for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert list(quick(x["text"] or "")) == slow.encode(x["text"] or "", add_special_tokens=False).ids


def test_packing_query_is_whole(spark):
    """The query's digests against texts encoded anew; places gapless; as few sequences as the lower bound."""
    import __spark_entry__ as entry

    quick = p.encoder(p.vocabulary_path())
    out = entry.queries()["op6_packing"](spark, SMALL).collect()
    by = {}
    for x in out:
        by.setdefault(x["doc_id"], []).append(x)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(docs) == len(by)
    for d in docs:
        ids = np.array([*quick(d["text"] or ""), 0], "<u4")
        assert sum(x["length"] for x in by[d["doc_id"]]) == len(ids)
        assert all(zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"] for x in by[d["doc_id"]])
    gapless(out)
    assert len({x["sequence_id"] for x in out}) == max(-(-sum(x["length"] for x in out) // 2048), sum(x["length"] > 1024 for x in out))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=9))
def test_bins_are_optimal(sizes):
    def least(left, bins):
        if not left:
            return len(bins)
        return min(least(left[1:], bins[:k] + [bins[k] + left[0]] + bins[k + 1 :]) for k in range(len(bins)) if bins[k] + left[0] <= 10) if any(b + left[0] <= 10 for b in bins) and len(bins) >= bound else min(
            [least(left[1:], [*bins, left[0]])] + [least(left[1:], bins[:k] + [bins[k] + left[0]] + bins[k + 1 :]) for k in range(len(bins)) if bins[k] + left[0] <= 10]
        )

    bound = -(-sum(sizes) // 10)
    hist = {}
    for x in sizes:
        hist[x] = hist.get(x, 0) + 1
    got = p.complete_bins(hist, 10)
    used = {}
    for filling, n in got:
        assert sum(x * c for x, c in filling.items()) <= 10
        for x, c in filling.items():
            used[x] = used.get(x, 0) + c * n
    assert used == hist
    if len(sizes) <= 6:
        assert sum(n for _, n in got) == least(sorted(sizes, reverse=True), [])


# decontamination


def brute_hits(text, items, size=10):
    w, hit, named = d.words_of(text), set(), set()
    for item, other in items:
        v = d.words_of(other)
        n = min(size, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    named.add(item)
    return hit, sorted(named)


@pytest.mark.parametrize("block", [1_000_000, 12])
def test_windows_are_brute_force(spark, block):
    one = " ".join(f"k{i}" for i in range(14))
    items = [(1, one), (2, "Tiny item"), (3, None), (4, ""), (30, one), (5, "k0 k1 " * 12), (None, "lost words here")]
    texts = [None, "", one.upper(), "x " + one + " y", "tiny, item! tiny item", "k0 k1 " * 20, " ".join(one.split()[:9]), "lost words here", one[10:] + " " + one]
    docs = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)], "doc_id long, text string, item_ids string")
    out = d.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=block).select("doc_id", "hit_spans", "item_ids", "n_words", d.n_hit().alias("n")).collect()
    known = [(k, (x or "").encode()) for k, x in items if k is not None]
    for x in out:
        hit, named = brute_hits((texts[x["doc_id"]] or "").encode(), known)
        assert {i for s in x["hit_spans"] for i in range(s["start"], s["end"])} == hit and x["item_ids"] == named and x["n"] == len(hit)


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y")], "doc_id long, text string")
    out = d.decontaminate(docs, spark.createDataFrame([("k10", "b c"), ("k9", "c d"), (None, "x y")], "item_id string, text string"), block_words=2)
    assert {x["doc_id"]: x["item_ids"] for x in out.collect()} == {1: ["k10", "k9"], 2: []}


def test_no_benchmark(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(odd_docs, none).filter("size(hit_spans) > 0").count() == 0
    assert d.decontaminate(no_docs, none).count() == 0


# quality rules and host reputation


def test_ledger_odd_rows(spark, odd_docs, no_docs):
    book = r.apply_policy(r.ledger(odd_docs))
    rows = {x["doc_id"]: x for x in book.collect()}
    assert rows[0]["n_words"] == 0 and rows[0]["fail_bits"] & 1 and not rows[0]["kept"]
    assert rows[8]["n_words"] == 30_000 and "score" in book.columns
    assert r.ledger(no_docs).count() == 0
    drops = {x["rule"]: x for x in r.ablations(book, "web/1").collect()}
    assert drops["few_words"]["n_failed"] == sum(1 for x in book.collect() if x["n_words"] < 50)


def test_ablations_are_bit_counts(spark):
    book = r.ledger(spark.read.parquet(f"{SMALL}/documents.parquet"))
    bits = [x["fail_bits"] for x in book.select("fail_bits").collect()]
    for x in r.ablations(book).collect():
        rule = next(k for k in r.RULES if k.name == x["rule"])
        assert x["n_kept_without"] == sum((b & ~(1 << rule.bit)) == 0 for b in bits) and x["n_failed_alone"] == sum(b == 1 << rule.bit for b in bits)


def test_urls_odd_rows(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.ORG:80/es/x?q#f"), (4, "https://a.com"), (5, "x://b.org?z"), (6, "http://org/"), (7, "http://u@bad.net/p"), (7, "http://u@bad.net/p"), (None, "http://n.net/")]
    pages = spark.createDataFrame([(*x, "k") for x in rows], "page_id long, url string, mean string")
    none = spark.createDataFrame([], "page_id long, bad long")
    out = {x["page_id"]: x for x in h.filter_urls(pages, none).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["verdict"]) == ("", "", "allow")
    assert out[3]["host"] == "www.example.org:80" and out[3]["rule"] is None
    assert (out[4]["host"], out[4]["path"], out[4]["rule"]) == ("a.com", "", None) and out[6]["rule"] == "org/"
    bad = spark.createDataFrame([(100 + k, int(k < 48)) for k in range(50)], "page_id long, bad long")
    many = pages.unionByName(spark.createDataFrame([(100 + k, f"http://{'bad' if k < 48 else 'ok'}.net/{k}", None) for k in range(50)], pages.schema))
    said = {x["host"]: x["verdict"] for x in h.filter_urls(many, bad).collect()}
    assert said["bad.net"] == "block" and said["ok.net"] == "allow"
    assert h.filter_urls(pages.limit(0), bad).count() == 0
