"""The written prefix index against looking at every label."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lanegraph.operators import search
from lanegraph.stage import fresh_path

RECORD = "id long, kind string, label string, category string, address string, addr_lon double, addr_lat double, lon double, lat double"


def words(label):
    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", label.lower()) if w))


def expected(records, queries, limit=6):
    out = []
    for qid, q, lon, lat in queries:
        ts = words(q)
        if len(q.strip()) < 2 or not ts:
            continue
        hits = []
        for r in records:
            if all(any(w.startswith(t) for w in words(r[2])) for t in ts):
                d2 = 0.0 if None in (lon, lat, r[7], r[8]) else ((r[7] - lon) * 0.7) ** 2 + (r[8] - lat) ** 2
                hits.append((r[1] != "p", d2, r[0]))
        out += [(qid, k, h[2]) for k, h in enumerate(sorted(hits)[:limit], 1)]
    return sorted(out)


def town():
    r = random.Random(3)
    records = []
    for k in range(1500):
        lon, lat = (None, None) if k % 301 == 7 else (r.gauss(0, 1) ** 3, r.gauss(0, 1) ** 3)
        poi = k % 9 == 0
        label = f"{r.choice(['oak', 'pine', 'oat'])} {r.choice(['market', 'books'])}" if poi else f"{100 + k % 400} {r.choice(['oak', 'oak', 'oak', 'pine', 'lakeshore'])} way"
        records.append((k, "p" if poi else "a", label, None, None, None, None, lon, lat))
    return records + [(5000, "p", "lonely museum", "c", "5 oak way", 1.0, 2.0, 40.0, 40.0)]


@pytest.mark.parametrize("short", [256, 0])
def test_hits_are_those_of_all_labels(spark, monkeypatch, short):
    monkeypatch.setattr(search, "SHORT", short)
    records = town()
    r = random.Random(4)
    queries = [(k, r.choice(["oa", "oak", "pine way", "oak market", "1", "15 oa", "way oak", "lakesh", "museum", "xyz", "o", " ", "oak zzz", "lon mus"]), r.gauss(0, 2), r.gauss(0, 2)) for k in range(80)] + [(900, "oak", None, None), (901, "oa", 500.0, -500.0)]
    index = spark.createDataFrame(records, RECORD)
    asked = spark.createDataFrame(queries, "query_id long, q string, lon double, lat double")
    got = search.search(index, asked).collect()
    assert sorted((x["query_id"], x["rank"], x["id"]) for x in got) == expected(records, queries)
    one = next(x for x in got if x["id"] == 5000)
    assert (one["address"], one["lon"], one["lat"]) == ("5 oak way", 1.0, 2.0)
    assert search.search(index.limit(0), asked).collect() == [] and search.search(index, asked.limit(0)).collect() == []


def test_a_search_opens_its_stems_only(spark):
    path = fresh_path(spark, "index")
    index = spark.createDataFrame(town(), RECORD)
    search.write_index(index, path)
    every = spark.read.parquet(f"{path}/postings").select("bucket").distinct().count()
    asked = spark.createDataFrame([(1, "museum", 0.0, 0.0)], "query_id long, q string, lon double, lat double")
    plan = search.find.__wrapped__(spark, path, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert every > 20 and re.search(r"bucket#\d+ (=|IN) ", plan)


def test_a_word_that_all_labels_have_ranks_few(spark, monkeypatch):
    """Of 20,000 labels that begin alike, those in cells near the queries are compared."""
    rows = spark.range(20_000).select(
        "id", F.lit("a").alias("kind"), F.concat(F.col("id"), F.lit(" oak way")).alias("label"), *[F.lit(None).cast(t).alias(c) for c, t in (("category", "string"), ("address", "string"), ("addr_lon", "double"), ("addr_lat", "double"))],
        (F.col("id") % 200 / 10).alias("lon"), (F.floor(F.col("id") / 200) / 10).alias("lat"),
    )
    asked = spark.range(10).select(F.col("id").alias("query_id"), F.lit("oa").alias("q"), (F.col("id") * 1.7).alias("lon"), (F.col("id") * 0.9).alias("lat"))
    seen, real = [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: seen.append(name) or real(df, name))
    got = search.search(rows, asked).collect()
    assert len(got) == 60 and seen.count("search-near") <= 2  # six are found in the finest cells, or one level up
    for x in got:
        assert ((x["lon"] - x["query_id"] * 1.7) * 0.7) ** 2 + (x["lat"] - x["query_id"] * 0.9) ** 2 < 0.1
