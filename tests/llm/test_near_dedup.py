import itertools
import random

import numpy as np
import pytest

from lanegraph.llm import near_dedup as n

from .conftest import prose


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, percent=75):
    sets = {k: shingles(t) for k, t in rows}
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {k: root(k) for k in sets}


def near_copies(seed=3):
    r = random.Random(seed)
    rows = []
    for g in range(12):
        base = prose(100 + g, 150).split()
        for _ in range(r.choice([1, 2, 9, 45])):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"z{r.random()}"
            rows.append(" ".join(w))
    passage = prose(999, 60)
    rows += [passage + " " + prose(2000 + k, 60) for k in range(60)] + ["a b c", "A b  c", "a b d", "", None, "x"]
    r.shuffle(rows)
    return list(enumerate(rows))


def found(spark, rows, percent=75):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r["id"]: r["component_id"] for r in n.near_duplicates(docs, percent=percent).collect()}


def test_components_are_brute_force(spark):
    rows = near_copies()
    assert found(spark, rows) == brute(rows)


def test_blocks_and_pairs_agree(spark, monkeypatch):
    rows = near_copies(8)
    monkeypatch.setattr(n, "SMALL", 2)
    monkeypatch.setattr(n, "BLOCK_BYTES", 8000)
    assert found(spark, rows) == brute(rows)


def test_other_percent(spark):
    rows = near_copies(9)
    r = random.Random(2)
    for g in range(20):
        base = prose(500 + g, 120).split()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[: r.randint(70, 110)] + prose(600 + g, 20).split()))]
    assert brute(rows, 50) != brute(rows)
    assert found(spark, rows, 50) == brute(rows, 50)


@pytest.mark.parametrize("percent", [75, 50, 90])
def test_pairs_within_the_bound_share_a_key_and_are_near(percent):
    r, s = np.random.default_rng(5), n.scheme(percent)
    for _ in range(300):
        a = r.integers(0, 65536, s.size).astype(np.uint16)
        b = a.copy()
        at = r.choice(s.chunks * n.WIDTH, s.bound, replace=False)
        b[at] = r.integers(0, 65536, len(at))
        b[s.chunks * n.WIDTH :] = r.integers(0, 65536, s.size - s.chunks * n.WIDTH)
        assert set(n.keys_of(a, s.chunks)) & set(n.keys_of(b, s.chunks))
        assert s.near((a & 255).astype(np.uint8), (b & 255).astype(np.uint8))


@pytest.mark.parametrize("percent", [75, 50])
def test_recall_at_the_limit(percent):
    """Pairs at exactly the similarity: all of 2000 share a key and are near."""
    r, s = np.random.default_rng(11), n.scheme(percent)
    for _ in range(2000):
        every = r.integers(0, 2**63, 200).astype(np.uint64)
        cut = (200 - 2 * percent) // 2
        one, two = every[: 200 - cut], every[cut:]
        assert 100 * (200 - 2 * cut) == percent * 200
        x, y = n.signature(one, s.size), n.signature(two, s.size)
        assert set(n.keys_of(x, s.chunks)) & set(n.keys_of(y, s.chunks))
        assert s.near((x & 255).astype(np.uint8), (y & 255).astype(np.uint8))


def test_odd_rows(spark, odd_docs, no_docs):
    got = n.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["id"]: r for r in got}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[5]["kept"]
    assert by[0]["n_shingles"] == 0 and by[0]["component_id"] == 0 and by[1]["component_id"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert set(n.keep_firsts(odd_docs).columns) == set(odd_docs.columns)
    assert n.near_duplicates(no_docs).count() == 0


def test_one_id_with_several_texts(spark):
    """In any order of the rows: each of an id's texts is compared, and what is like either joins it."""
    a, b = prose(1, 120), prose(2, 120)
    near = lambda t: t + " and one more"
    rows = [(1, a), (1, b), (2, near(b)), (3, near(a)), (7, prose(5, 90)), (9, prose(6, 90)), (9, prose(5, 90))]
    want = {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}
    for order in (rows, rows[::-1], sorted(rows, key=lambda x: str(x[1]))):
        assert found(spark, order) == want
    many = [(5, prose(300 + k, 60)) for k in range(200)] + [(400 + k, near(prose(300 + 7 * k, 60))) for k in range(20)] + [(900, prose(900, 60))]
    assert found(spark, many) == {5: 5, 900: 900} | {400 + k: 5 for k in range(20)}
