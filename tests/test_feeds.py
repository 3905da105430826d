"""Pages as a data source, style expressions, nearest places at any distance, cells along a line, ways with gaps."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph.functions import style
from lanegraph.operators import grid, ordered
from lanegraph.sources import paged


def layer(spark, n):
    rows = spark.range(n).select(F.col("id"), F.create_map(F.lit("name"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("n"), F.col("id") % 3)), F.lit("size"), F.col("id").cast("string")).alias("properties"))
    return rows.select("id", "properties", F.lit("Point").alias("kind"), F.array(F.col("id") / 2, F.lit(1.0)).alias("coordinates"))


@pytest.mark.parametrize("n", [0, 1, 40, 41, 205])
def test_pages_to_the_last(spark, tmp_path, n):
    """Pages of 20, also where the last is full, and where there is none."""
    paged.save_pages(layer(spark, n), f"{tmp_path}/p", "id", 20)
    rows = paged.read_pages(spark, f"{tmp_path}/p", ["size", "name", "none"])
    got = sorted((int(r["size"]), r["name"], r["none"], json.loads(r["coordinates"])) for r in rows.collect())
    assert got == [(k, f"n{k % 3}" if k % 5 else None, None, [k / 2, 1.0]) for k in range(n)]
    assert rows.rdd.getNumPartitions() == max(1, -(-n // 20))


def test_filters_go_to_the_reader(spark, tmp_path):
    paged.save_pages(layer(spark, 100), f"{tmp_path}/p", "id", 30)
    rows = paged.read_pages(spark, f"{tmp_path}/p", ["size", "name"])
    for where in ("name = 'n1'", "name in ('n0', 'n2') and size like '1%'", "name is null", "name <> 'n1'", "not (name in ('n1', 'n2'))", "name <=> null", "size > '5' and name = 'n2'", "length(name) = 2 or size = '7'"):
        some = rows.filter(where)
        want = sorted(r["size"] for r in layer(spark, 100).select(F.col("properties")["size"].alias("size"), F.col("properties")["name"].alias("name")).filter(where).collect())
        assert sorted(r["size"] for r in some.collect()) == want, where
    plan = _explained(spark, rows.filter("name = 'n1' and length(size) = 1"))
    assert "EqualTo(name,n1)" in plan and "Condition : (length(size" in plan  # the length is left to Spark


def _explained(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_requests_for_the_last_page():
    for last in (0, 1, 2, 3, 9, 1000):
        asked = []
        assert paged.last_page(lambda k, last=last, asked=asked: asked.append(k) or k < last) == last
        assert len(asked) <= 2 * math.log2(last + 2) + 2
    assert paged.page_size({}) == 1000 and paged.page_size({"maxRecordCount": 5000}) == 2000 and paged.page_size({"maxRecordCount": 0}) == 1000
    assert not paged.has_more({"features": [], "exceededTransferLimit": True}) and paged.has_more({"features": [1], "properties": {"exceededTransferLimit": True}})


def test_style_by_hand(spark):
    rows = [("a", 1.0, True), ("", 0.0, False), (None, None, None), ("b", 2.5, True)]
    df = spark.createDataFrame(rows, "t string, n double, b boolean")
    s = style.Style({"t": (F.col("t"), style.TEXT), "n": (F.col("n"), style.NUMBER), "b": (F.col("b"), style.TRUTH)}, 12)
    t, n, b = ["get", "t"], ["get", "n"], ["get", "b"]
    cases = [
        (["==", t, "a"], [True, False, False, False]), (["!=", t, "a"], [False, True, True, True]), (["in", t, ["literal", ["a", "b"]]], [True, False, False, True]), (["!", ["to-boolean", t]], [False, True, True, False]),
        (["to-boolean", n], [True, False, False, True]), (["all", b, ["any", ["==", n, 1], ["==", n, 2]]], [True, False, False, False]), (["has", "t"], [True, True, False, True]), (["==", n, "1"], [False] * 4),
        (["==", ["get", "gone"], t], [False, False, True, False]), (["==", ["match", t, ["a", "x"], True, "b", False, False], True], [True, False, False, False]), (["all"], [True] * 4), (["any"], [False] * 4),
    ]
    got = df.select(*[s.test(e).alias(f"c{k}") for k, (e, _) in enumerate(cases)]).collect()
    assert [[r[k] for r in got] for k in range(len(cases))] == [want for _, want in cases]
    values = [
        (["step", n, "low", 1, "mid", 2, "high"], ["mid", "low", None, "high"]), (["interpolate", ["linear"], n, 0, 10, 2, 20], [15.0, 10.0, None, 20.0]), (["interpolate", ["linear"], ["zoom"], 10, 1.5, 14, 3.5], [2.5] * 4),
        (["concat", ["to-string", n], " ft"], ["1 ft", "0 ft", " ft", "2.5 ft"]), (["match", t, "a", 7, 9], [7.0, 9.0, 9.0, 9.0]),
    ]
    got = df.select(*[s.column(e).alias(f"c{k}") for k, (e, _) in enumerate(values)]).collect()
    assert [[r[k] for r in got] for k in range(len(values))] == [want for _, want in values]
    for bad in (["frob", 1], ["__init__"], ["interpolate", ["cubic-bezier"], 1, 1, 2]):
        with pytest.raises((ValueError, TypeError)):
            s.column(bad)
    assert len(style.LAYERS) == 16


def test_nearest_at_any_distance(spark):
    """Against all pairs: a crowd of 10^5 in one spot, outliers on both sides, ties, places held twice, a single target."""
    r = np.random.default_rng(6)
    crowd = 0.5 + r.random((100_000, 2)) * 1e-7
    rest = np.concatenate([r.normal(0, 1, (400, 2)), [[500.0, -500.0], [500.0, -500.0], [2.0, 2.0], [2.0, 4.0]]])
    targets = np.concatenate([crowd, rest])
    points = np.concatenate([r.normal(0, 1, (150, 2)), 0.5 + r.random((50, 2)) * 1e-7, [[-1e4, 1e4], [499.0, -499.0], [2.0, 3.0], [0.5, 0.5]]])
    t = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(targets)] + [(999_999, None, 0.0)], "id long, tx double, ty double").repartition(8)
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)] + [(7777, None, 1.0)], "k long, px double, py double")
    got = {x["k"]: (x["id"], x["d2"]) for x in grid.nearest_anywhere(p, t, "k", "id").collect()}
    assert len(got) == len(points)
    for k, (x, y) in enumerate(points):
        d2 = (x - targets[:, 0]) * (x - targets[:, 0]) + (y - targets[:, 1]) * (y - targets[:, 1])
        assert got[k] == (int(d2.argmin()), d2.min())
    one = grid.nearest_anywhere(p, t.filter("id = 5"), "k", "id").collect()
    assert len(one) == len(points) and {x["id"] for x in one} == {5}
    assert grid.nearest_anywhere(p, t.limit(0), "k", "id").collect() == []


def test_cells_along_lines(spark):
    """A diagonal of thousands of cells has thousands of rows, not their square, and every cell near the line is there."""
    rows = [(1, 0.0, 0.0, 4.0, 4.0), (2, 4.0, 0.3, 0.0, 0.31), (3, 1.0, 3.0, 1.0, 0.0), (4, 2.0, 2.0, 2.0, 2.0), (5, -122.000001, 47.0, -122.0, 47.9)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    cells = {}
    for x in grid.filed_lines(df, ("x0", "y0", "x1", "y1"), 0.001, 0.0005).collect():
        cells.setdefault(x["id"], []).append((x["_cx"], x["_cy"]))
    assert all(len(c) == len(set(c)) for c in cells.values()) and len(cells[1]) < 21_000 and len(cells[2]) < 20_000 and len(cells[3]) < 10_000
    r = np.random.default_rng(1)
    for k, x0, y0, x1, y1 in rows:
        own = set(cells[k])
        for share, angle, off in r.random((300, 3)):
            x, y = x0 + share * (x1 - x0) + 0.0005 * off * math.cos(7 * angle), y0 + share * (y1 - y0) + 0.0005 * off * math.sin(7 * angle)
            assert (math.floor(x / 0.001), math.floor(y / 0.001)) in own


def test_long_segments_that_cross(spark):
    """Trails thousands of cells long: each crossing pair once, as by all pairs."""
    r = np.random.default_rng(2)
    ends = [(k, *(float(v) for v in row)) for k, row in enumerate(r.random((60, 4)) * 3)]
    a = spark.createDataFrame(ends, "i long, ax0 double, ay0 double, ax1 double, ay1 double")
    b = spark.createDataFrame(ends, "j long, bx0 double, by0 double, bx1 double, by1 double")
    got = sorted((x["i"], x["j"]) for x in grid.segments_meeting(a, b, 0.01, (["i"], ["j"]), strict=True).collect())

    def turn(p, q, s):
        return np.sign((q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0]))

    want = []
    for i, *e in ends:
        for j, *f in ends:
            p, q, s, t = e[:2], e[2:], f[:2], f[2:]
            if turn(p, q, s) * turn(p, q, t) < 0 and turn(s, t, p) * turn(s, t, q) < 0:
                want.append((i, j))
    assert got == sorted(want) and len(got) > 200


def test_ways_with_gaps(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [3, 9]), (3, [8, 1]), (4, [2, 7, 6])], "way_id long, nodes array<long>")
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in (1, 2, 3, 5, 6, 7, 9)], "node long, lon double, lat double")
    got = sorted((r["way_id"], [p["node"] for p in r["points"]]) for r in ordered.split_known_ways(ways, nodes).collect())
    # way 1 is cut at 2 and 3 and loses the rest behind 3, as 4 is not known; way 3 begins at an unknown node
    assert got == [(1, [1, 2]), (1, [2, 3]), (2, [3, 9]), (4, [2, 7, 6])]
    some = sorted((r["way_id"], [p["node"] for p in r["points"]]) for r in ordered.split_known_ways(ways, nodes, F.col("lon") > 2.5).collect())
    assert some == [(1, [2, 3]), (2, [3, 9]), (4, [2, 7, 6])]


def test_ways_with_gaps_are_shuffled_by_node_and_by_way_only(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3])], "way_id long, nodes array<long>")
    nodes = spark.createDataFrame([(1, 1.0, 0.0)], "node long, lon double, lat double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ordered.split_known_ways(ways, nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the ways' nodes by node, their counts by node, the coordinates by node, and what they make by way
    assert plan.count("Exchange hashpartitioning(") == 4 and plan.count("hashpartitioning(way_id") == 1
