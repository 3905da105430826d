"""Plans with SQL give DuckDB's rows on the small tables."""

import re
import threading

import duckdb
import pytest

from lanegraph.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def value(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_same_rows(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    cur = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_the_others_end(spark, name):
    """Plans without SQL run to their end in a bounded time and give rows of a stable schema."""
    ended = threading.Timer(240, spark.sparkContext.cancelAllJobs)
    ended.start()
    try:
        df = catalog.queries()[name](spark, FOLDER)
        assert len(df.collect()) > 0 and df.schema == catalog.queries()[name](spark, FOLDER).schema
    finally:
        ended.cancel()


@pytest.mark.parametrize("name", ["poi_addresses", "racks", "edge_snap", "nearest_nodes"])
def test_no_table_is_multiplied_with_another(spark, name):
    """Nested loops only meet one-row tables: the greatest node id, and the two directions of a street."""
    plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    for k, line in enumerate(plan):
        if re.search(r"Join (Cross|Inner)\s*$|Join Cross", line):
            depth = line.index("Join")
            below = []
            for under in plan[k + 1 :]:
                if len(under) - len(under.lstrip(" :+-")) <= depth:
                    break
                below.append(under)
            assert any(re.search(r"Aggregate \[max|LocalRelation|OneRowRelation|Range \(", x) for x in below), line


def test_every_plan_is_named_once():
    assert len(catalog.queries()) > 50 and set(catalog.oracle_sql()) <= set(catalog.queries())
