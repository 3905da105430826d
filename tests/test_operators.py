"""Operators without SQL, and small cases worked by hand."""

import functools
import gzip
import hashlib
import heapq
import math
import os
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph import stage
from lanegraph.functions import geo, tags, text
from lanegraph.operators import audit, components, elevation, grid, matching, ordered, propagation, routing
from lanegraph.operators.components import connected_components
from lanegraph.plans import fixtures, travel
from lanegraph.sources import manifest
from lanegraph.streaming import last_fix

FOLDER = "/root/testdata/sf0.001"


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(50)]
    star = [(1000, 2000 + k) for k in range(60)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain + star, "src long, dst long")).collect()}
    assert {got[k] for k in range(51)} == {0} and got[2059] == 1000 and got[5000] == 5000
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_by_rounds_and_at_once(spark):
    r = np.random.default_rng(4)
    rows = [(int(a), int(b)) for a, b in zip(r.integers(0, 900, 500), r.integers(0, 900, 500), strict=True)] + [(5000 + k, 5001 + k) for k in range(300)] + [(7000, 7100 + k) for k in range(200)] + [(None, 3), (9000, 9000)]
    up = {x: x for e in rows if e[0] is not None for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in rows:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    edges = spark.createDataFrame(rows, "src long, dst long").repartition(3)
    for last in (500_000, 10, 0):
        assert {x["node"]: x["component"] for x in connected_components(edges, last_edges=last).collect()} == {x: root(x) for x in up}


def test_paths_are_dijkstra(spark):
    w = routing.Weights.of(routing.PRESETS["comfort"], sidewalks=True)
    edges = travel._edges(spark, FOLDER)
    steps = routing.transitions(edges, travel._nodes(spark, FOLDER), w)
    pairs = spark.createDataFrame([(1, 5, 47), (2, 60, 21), (3, 10, 92), (4, 7, 7), (5, 3, 99999)], "pair_id long, start long, goal long")
    got = {r["pair_id"]: r for r in routing.shortest_paths(edges, steps, pairs).collect()}
    e = {r["edge_id"]: r for r in edges.filter("cost is not null").collect()}
    after = {}
    for r in steps.collect():
        after.setdefault(r["prev_edge"], []).append((r["next_edge"], r["cost"]))

    def best(start, goal):
        heap = [(r["cost"], k) for k, r in e.items() if r["src"] == start]
        heapq.heapify(heap)
        done = {}
        while heap:
            g, k = heapq.heappop(heap)
            if k in done:
                continue
            done[k] = g
            if e[k]["dst"] == goal:
                return g
            for n, c in after.get(k, ()):
                if n in e and n not in done:
                    heapq.heappush(heap, (g + c, n))

    for k, a, b in ((1, 5, 47), (2, 60, 21), (3, 10, 92)):
        assert got[k]["cost"] == pytest.approx(best(a, b))
        path = got[k]["path"]
        assert e[path[0]]["src"] == a and e[path[-1]]["dst"] == b
        assert got[k]["feet"] == pytest.approx(sum(e[x]["len_ft"] for x in path))
    assert 4 not in got and 5 not in got


def _ways(edges, steps):
    after = {}
    for r in steps:
        after.setdefault(r["prev_edge"], []).append((r["next_edge"], r["cost"]))
    return {r["edge_id"]: r for r in edges}, after


def test_paths_between_points_on_edges(spark):
    """Against Dijkstra over edge states that begins and ends inside edges."""
    w = routing.Weights.of(routing.PRESETS["comfort"], sidewalks=True)
    edges = travel._edges(spark, FOLDER)
    steps = routing.transitions(edges, travel._nodes(spark, FOLDER), w)
    e, after = _ways(edges.collect(), steps.collect())
    back = {(r["seg_id"], r["src"]): k for k, r in e.items()}
    ids = sorted(k for k, r in e.items() if r["cost"] is not None)
    asked = [(1, ids[10], ids[180]), (2, ids[33], ids[34]), (3, ids[90], ids[5]), (4, ids[200], ids[120]), (5, ids[7], ids[7])]
    share = {k: (1 + k % 9) / 10 for _, a, b in asked for k in (a, b)}
    points = spark.createDataFrame([(k, k, e[k]["len_ft"] * t, e[k]["len_ft"] * (1 - t)) for k, t in share.items()], "point_id long, edge_id long, from_ft double, to_ft double")
    pairs = spark.createDataFrame(asked, "pair_id long, start long, goal long")
    got = {r["pair_id"]: r for r in routing.paths_between(edges, steps, routing.with_reverse(points, edges), pairs).collect()}

    def parts(k):
        r = e[k]
        other = back.get((r["seg_id"], r["dst"]))
        return r, e[other] if other is not None and e[other]["cost"] is not None else None, r["len_ft"] * share[k]

    for pair, a, b in asked:
        r, other, at = parts(a)
        heap = [(r["cost"] * (1 - share[a]), a, r["len_ft"] - at)] + ([(other["cost"] * share[a], other["edge_id"], at)] if other else [])
        goal, reverse, along = parts(b)
        exits = {goal["src"]: (goal["cost"] * share[b], along)}
        if reverse:
            exits[goal["dst"]] = (reverse["cost"] * (1 - share[b]), goal["len_ft"] - along)
        heapq.heapify(heap)
        done, best = set(), (math.inf, 0)
        while heap:
            g, k, feet = heapq.heappop(heap)
            if k in done:
                continue
            done.add(k)
            if e[k]["dst"] in exits:
                best = min(best, (g + exits[e[k]["dst"]][0], feet + exits[e[k]["dst"]][1]))
            for n, c in after.get(k, ()):
                if n in e and n not in done:
                    heapq.heappush(heap, (g + c, n, feet + e[n]["len_ft"]))
        assert (pair in got) == (best[0] < math.inf)
        if pair in got:
            assert got[pair]["cost"] == pytest.approx(best[0]) and got[pair]["feet"] == pytest.approx(best[1])
    assert len(got) >= 3


def test_one_way_per_node_is_no_cheaper(spark):
    w = routing.Weights.of(routing.PRESETS["comfort"], sidewalks=True)
    edges = travel._edges(spark, FOLDER)
    steps = routing.transitions(edges, travel._nodes(spark, FOLDER), w)
    pairs = spark.createDataFrame([(1, 5, 47), (2, 60, 21), (3, 10, 92)], "pair_id long, start long, goal long")
    exact, node = ({r["pair_id"]: r["cost"] for r in routing.shortest_paths(edges, steps, pairs, by=by).collect()} for by in ("edge", "node"))
    assert set(exact) == set(node) and all(node[k] >= exact[k] - 1e-6 for k in exact)


def test_slices_of_a_line(spark):
    p = lambda x: F.struct(F.lit(float(x)).alias("lon"), F.lit(0.0).alias("lat"))
    line = F.array(*[p(x) for x in (0, 1, 2, 3)])
    r = spark.range(1).select(geo.slice_to_end(line, p(1.5), F.lit(2), True).alias("a"), geo.slice_to_end(line, p(1.5), F.lit(2), False).alias("b")).first()
    assert [x["lon"] for x in r["a"]] == [1.5, 2, 3] and [x["lon"] for x in r["b"]] == [1.5, 1, 0]


def test_spread_prefers_the_nearer_then_the_higher_source(spark):
    edges = spark.createDataFrame([(1, 2, 100.0), (2, 3, 100.0), (3, 4, 100.0), (4, 5, 100.0)], "u long, v long, len double")
    seeds = spark.createDataFrame([(1, "cutting"), (5, "bridge")], "node_id long, category string")
    got = {r["node_id"]: (r["dist"], r["category"]) for r in propagation.spread(edges, seeds, 200.0).collect()}
    assert got == {1: (0, "cutting"), 2: (100, "cutting"), 3: (200, "bridge"), 4: (100, "bridge"), 5: (0, "bridge")}


def test_inner_nodes_are_weighted_means(spark):
    segs = spark.createDataFrame([(1, 10, 11, 50.0), (1, 11, 12, 100.0), (1, 11, 13, 25.0), (1, 13, 14, 10.0), (2, 20, 21, 5.0)], "grp long, u long, v long, len_ft double")
    nodes = spark.createDataFrame([(10, 0.0, True), (11, 5.0, False), (12, 90.0, True), (13, 1.0, False), (14, 40.0, True), (20, 1.0, False), (21, 2.0, False)], "node long, elev_ft double, boundary boolean")
    for most in (2000, 1, 0):
        got = {r["node"]: r["elev_ft"] for r in elevation.level_groups(segs, nodes, most=most).collect()}
        assert set(got) == {11, 13}
        assert got[11] == pytest.approx((0 / 50 + 90 / 100 + got[13] / 25) / (1 / 50 + 1 / 100 + 1 / 25), abs=1e-4)
        assert got[13] == pytest.approx((got[11] / 25 + 40 / 10) / (1 / 25 + 1 / 10), abs=1e-4)
        assert 0 <= min(got.values()) and max(got.values()) <= 90


def test_large_groups_are_solved_exactly(spark):
    """A chain and a lattice of 5000 inner nodes each, above ``most``, against a direct solve."""
    r = np.random.default_rng(2)
    chain = [(1, k, k + 1, float(r.integers(5, 50))) for k in range(5001)]
    tall, wide = 50, 101
    at = lambda i, j: 100_000 + i * wide + j
    lattice = [(2, at(i, j), at(i + a, j + b), float(r.integers(5, 50))) for i in range(tall) for j in range(wide) for a, b in ((0, 1), (1, 0)) if i + a < tall and j + b < wide]
    fixed = {0: 0.0, 5001: 100.0} | {at(0, j): float(r.integers(0, 90)) for j in range(0, wide, 3)} | {at(tall - 1, j): float(r.integers(0, 90)) for j in range(0, wide, 5)}
    names = sorted({x for _, u, v, _ in chain + lattice for x in (u, v)})
    nodes = spark.createDataFrame([(x, fixed.get(x, 7.0), x in fixed) for x in names], "node long, elev_ft double, boundary boolean")
    got = {x["node"]: x["elev_ft"] for x in elevation.level_groups(spark.createDataFrame(chain + lattice, "grp long, u long, v long, len_ft double"), nodes).collect()}
    assert set(got) == set(names) - set(fixed)
    along = np.cumsum([0.0] + [x[3] for x in chain])
    assert all(got[k] == pytest.approx(100 * along[k] / along[-1], abs=1e-6) for k in range(1, 5001))
    inner = [x for x in names if x >= 100_000 and x not in fixed]
    place = {x: k for k, x in enumerate(inner)}
    a, b = np.zeros((len(inner),) * 2), np.zeros(len(inner))
    for _, u, v, feet in lattice:
        for x, y in ((u, v), (v, u)):
            if x in place:
                a[place[x], place[x]] += 1 / feet
                if y in place:
                    a[place[x], place[y]] -= 1 / feet
                else:
                    b[place[x]] += fixed[y] / feet
    assert np.allclose([got[x] for x in inner], np.linalg.solve(a, b), atol=1e-6)


def test_climb_of_an_even_profile(spark):
    p = F.array(*[F.struct(F.lit(float(d)).alias("along"), F.lit(float(z)).alias("elev")) for d, z in ((0, 0), (10, 1), (150, 15), (300, 0))])
    r = spark.range(1).select(elevation.resample(p, 75.0).alias("e")).select("e", elevation.climb_metrics(F.col("e"), F.lit(False)).alias("up"), elevation.climb_metrics(F.col("e"), F.lit(True)).alias("down")).first()
    assert r["e"]["step"] == 75 and r["e"]["elevs"] == pytest.approx([0, 7.5, 15, 7.5, 0])
    assert r["up"]["uphill_ft"] == 15 and r["up"]["max_uphill"] == 0.1 and r["up"]["steep_ft2"] == pytest.approx(2 * 75 * 0.08**2, abs=1e-3)
    assert r["down"] == r["up"]


def test_unlike_alternates(spark):
    own = spark.createDataFrame([(1, [1, 2, 3, 4, 5])], "pair_id long, geoms array<int>")
    other = spark.createDataFrame([(1, "quieter", [1, 2, 9, 8]), (1, "direct", [1, 2, 3, 4, 5]), (1, "flatter", [1, 2, 9, 8, 7])], "pair_id long, twist string, geoms array<int>")
    assert [(r["twist"], r["like"]) for r in routing.distinct_alternates(own, other).collect()] == [("flatter", 0.4)]
    three = spark.createDataFrame([(1, "quieter", [10, 11]), (1, "direct", [20, 21]), (1, "flatter", [30, 31])], other.schema)
    assert sorted(r["twist"] for r in routing.distinct_alternates(own, three).collect()) == ["direct", "quieter"]


def test_weights_and_penalties(spark):
    w = routing.Weights.of(routing.PRESETS["comfort"])
    assert w.twisted("quieter").s1 == 1.0 and w.twisted("direct").s2 == 1.0 and routing.Weights.of({}).s3 == 0.5
    lanes = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 2.0, 3.5, 5.0, 5.1)], "l double")
    got = [r["p"] for r in lanes.select(routing.crossing_penalty(w, F.col("l")).alias("p")).collect()]
    assert got[:6] == pytest.approx([0, 0, 280, 560, 1680, 2240]) and got[6] is None


def test_text_by_hand(spark):
    rows = [("Northeast 65th Street", "NE 65th St", "NE 65th St"), ("Streetside Northeastern", "Streetside Northeastern", "Streetside Northeastern"), ("north Lake Street Northeast", "N Lake St NE", "north Lake St NE")]
    df = spark.createDataFrame(rows, "s string, a string, b string")
    assert all(r[0] == r["a"] and r[1] == r["b"] for r in df.select(text.normalize_address(F.col("s")), text.abbreviate_label(F.col("s")), "a", "b").collect())


def test_interval_union_and_gaps(spark):
    iv = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 8.0), (1, 9.0, 20.0), (2, 3.0, 4.0)], "k long, lo double, hi double")
    assert {r["k"]: r["covered"] for r in ordered.covered_length(iv, "k").collect()} == {1: 20.0, 2: 1.0}
    path = spark.createDataFrame([(1, 0, "Oak St", 50.0), (1, 1, None, 40.0), (1, 2, "Oak St bike lane", 60.0), (1, 3, "", 200.0), (1, 4, "Oak St", 9.0)], "route_id long, pos long, name string, len_ft double")
    assert [r["name"] for r in ordered.fill_short_gaps(path).orderBy("pos").collect()] == ["Oak St", "Oak St", "Oak St bike lane", None, "Oak St"]


def test_polygon_and_lines(spark):
    ring = F.array(F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))]))
    pts = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (3.9, 3.9)], "x double, y double")
    assert [r[0] for r in pts.select(geo.in_rings(F.col("x"), F.col("y"), ring)).collect()] == [True, False, True]
    line = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (3, 0), (3, 1))])
    p = spark.range(1).select(geo.point_at(line, F.lit(0.5)).alias("p")).first()["p"]
    assert (p["lon"], p["lat"]) == (2.0, 0.0)


def test_bearing_bounds(spark):
    b = spark.range(1).select(geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(-1e-9), F.lit(1.0))).first()[0]
    assert 0 <= b < 360 and math.isclose(b, 360, abs_tol=1e-3)


def test_overlap_and_diff(spark):
    got = spark.range(1).select(audit.overlap(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3), F.lit(4))), audit.overlap(F.array().cast("array<int>"), F.array(F.lit(1)))).first()
    assert got[0] == 0.5 and got[1] == 0.0
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "url string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("z", "4")], "url string, hash string")
    assert sorted(r["url"] for r in audit.manifest_diff(a, b).collect()) == ["y", "z"]


def test_levels_from_tags(spark):
    df = spark.createDataFrame([(4, None), (0, 1), (0, 0), (256, 2), (64, None)], "f int, l int")
    got = [tuple(r) for r in df.select(tags.needs_correction(F.col("f"), F.col("l")), tags.edge_category(F.col("f"), F.col("l"))).collect()]
    assert got == [(True, "bridge"), (True, "layered(+1)"), (False, "other"), (False, "layered(+2)"), (True, "untagged-crossing")]


def test_points_snap_to_the_main_component(spark):
    at = {1: (0.0, 0.0), 2: (0.001, 0.0), 3: (0.002, 0.0), 8: (0.0, 0.0002), 9: (0.001, 0.0002), 10: (0.0022, 0.0002)}
    nodes = spark.createDataFrame([(k, *v) for k, v in at.items()], "node_id long, lon double, lat double")
    pairs = [(1, 1, 2), (2, 2, 3), (3, 8, 9)]
    edges = spark.createDataFrame([(k, a, b, 245.0, False, *at[a], *at[b]) for k, a, b in pairs], "edge_id long, src long, dst long, len_ft double, is_sidewalk boolean, slon double, slat double, dlon double, dlat double")
    points = spark.createDataFrame([(1, 0.0005, 0.0002), (2, 0.0032, 0.0004)], "point_id long, px double, py double")
    got = {r["point_id"]: (r["kind"], r["edge_id"], r["node_id"]) for r in matching.snap(points, edges, nodes).collect()}
    assert got == {1: ("edge", 1, None), 2: ("node", None, 3)}


def test_streams_of_several_batches(spark, tmp_path):
    """One file a batch: state is carried on; the watermark of the first batch drops late rows from the third on (event 6)."""
    folder = tmp_path / "tables"
    day = lambda d, h: f"timestamp'2024-01-{d:02d} {h:02d}:10:00'"
    batches = [[(1, 10, day(10, 5), 1.0), (2, 11, day(10, 5), 2.0)], [(3, 10, day(11, 7), 4.0), (4, 12, day(1, 1), 9.0)], [(5, 11, day(11, 8), 8.0), (6, 10, day(5, 1), 16.0), (7, 12, day(11, 7), 32.0)]]
    for k, rows in enumerate(batches):
        values = ", ".join(f"({e}L, {t}, {u}L, 'view', {v}D, '')" for e, u, t, v in rows)
        spark.sql(f"select * from values {values} as t(event_id, ts, user_id, event_type, value, props)").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        for p in (folder / "events.parquet").glob("part-*.parquet"):
            new = p.with_name(f"seen-{k}-{p.name}")
            p.rename(new)
            os.utime(new, (1_700_000_000 + 60 * k,) * 2)
    got = {r["user_id"]: r["event_id"] for r in last_fix.last_fixes(spark, str(folder), 1).collect()}
    assert got == {10: 3, 11: 5, 12: 7}
    hours = {(r["hour"], r["n"], r["total"]) for r in last_fix.hourly_counts(spark, str(folder), 1).collect()}
    assert hours == {("2024-01-01 01", 1, 9.0), ("2024-01-10 05", 2, 3.0), ("2024-01-11 07", 2, 36.0), ("2024-01-11 08", 1, 8.0)}


def test_files_of_a_folder(spark):
    got = {r["url"]: r for r in manifest.files(spark, f"{FOLDER}/*.parquet").collect()}
    paths = sorted(Path(FOLDER).glob("*.parquet"))
    assert set(got) == {p.name for p in paths}
    for p in paths:
        data = p.read_bytes()
        r = got[p.name]
        assert (r["size"], r["hash"]) == (len(data), hashlib.sha256(data).hexdigest()[:16]) and gzip.decompress(gzip.compress(data, 6)) == data and 0 < r["zipped"] < len(data) * 1.1
    t = manifest.totals(manifest.files(spark, f"{FOLDER}/*.parquet")).first()
    assert t["n_files"] == len(paths) and t["size"] == sum(p.stat().st_size for p in paths) and t["fetched"] == sum(r["zipped"] for r in got.values())


def test_stages_ask_for_a_shared_folder_on_a_cluster():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage.shared_folder(Session)


def test_rounding_goes_by_the_scaled_double(spark):
    import duckdb

    values = [0.5045, 1.15, 0.125, -0.125, 4.35, 8.15, 0.0, 16.45, 1.005] + [k / 10000 for k in range(5, 20000, 370)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", geo.rounded(F.col("v"), 3).alias("got"), F.round("v", 3).alias("other")).collect()
    want = [duckdb.execute("SELECT round(?::DOUBLE, 3)", [r["v"]]).fetchone()[0] for r in rows]
    assert [r["got"] for r in rows] == want and [r["other"] for r in rows] != want
    up, grade, steep = elevation.even_metrics(F.lit(130.0), F.lit(257.7))
    r = spark.range(1).select(geo.rounded(grade, 3).alias("g")).first()
    assert r["g"] == duckdb.execute("SELECT round(round(130e0/257.7e0, 4), 3)").fetchone()[0] == 0.504


def test_manifest_streams_files_of_any_bytes(spark, tmp_path):
    r = np.random.default_rng(5)
    data = {"empty": b"", "feed": b"\n", "feeds": b"\n\n", "mark": b"\xef\xbb\xbfa\n", "marked": b"\xef\xbb\xbf", "open": b"a\r\nb", "a b%20.bin": r.bytes(700_000), "flat": b"x" * 300_000, "own.gz": gzip.compress(b"abc")}
    for name, b in data.items():
        (tmp_path / name).write_bytes(b)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = manifest.files(spark, f"{tmp_path}/*")
        got = {x["url"]: (x["size"], x["zipped"], x["hash"]) for x in found.collect()}
        content = manifest.files(spark, f"{FOLDER}/*.parquet").filter("url = 'lineitem.parquet'")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # Spark does not list files of no bytes
    assert got == {n: (len(b), len(gzip.compress(b, 6)), hashlib.sha256(b).hexdigest()[:16]) for n, b in data.items() if b}
    # no file's content is a value of a row, but for packed ones
    assert "MapInArrow" in content


def test_cell_joins_are_shuffled_and_equals_take_the_lowest(spark):
    """A filed side is never broadcast, however small its table looks; only the nearest pairs are sorted."""
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, 0.4, 0.0)], "id long, ax double, ay double")
    others = spark.createDataFrame([(9, 0.5, 0.0), (4, -0.5, 0.0), (7, 0.0, 0.9), (8, 0.4, 0.05)], "n long, bx double, by double")
    sizes = []

    def near(p):
        sizes.append("_bound" in p.columns)
        return grid.points_near_points(p, others, 1.0)

    got = grid.nearest_of(points, near, "id", "d2", ["n"])
    assert sorted((x["id"], x["n"]) for x in got.collect()) == [(1, 8), (3, 8)] and sizes == [False, True]
    one = grid.nearest_of(points, lambda p: grid.points_near_points(p, others.filter("n <> 8"), 1.0), "id", "d2", ["n"])
    assert {x["id"]: x["n"] for x in one.collect()} == {1: 4, 3: 9}
    segs = others.select("n", F.col("bx").alias("x0"), F.col("by").alias("y0"), (F.col("bx") + 0.1).alias("x1"), F.col("by").alias("y1"))
    for df in (near(points), grid.points_near_segments(points, segs, 1.0, px="ax", py="ay")):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def shuffled_only(monkeypatch, module):
    """Plans of the stage tables that ``module`` writes, by name."""
    plans = []

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stage.materialize(df, name)

    monkeypatch.setattr(module, "materialize", kept)
    return plans


def test_contraction_and_the_map_join_by_shuffles(spark, monkeypatch):
    """What grows with the tables is not sent through the driver, however few bytes its table takes."""
    plans = shuffled_only(monkeypatch, components)
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + F.when(F.col("id") % 10 < 9, 1).otherwise(0)).alias("dst"))
    got = connected_components(edges, last_edges=0)
    assert {(x["node"], x["component"]) for x in got.collect()} == {(n, n - n % 10) for n in range(300)}
    plans.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    plans += [(n, fixtures.relation(spark, "/root/testdata/sf0.001", n)._jdf.queryExecution().executedPlan().toString()) for n in ("islands", "dir", "addresses")]
    assert sum("SortMergeJoin" in p for _, p in plans) > 5 and [n for n, p in plans if "BroadcastHashJoin" in p] == []


def test_crowded_keys_are_dealt(spark, monkeypatch):
    """Points that crowd at one cell are dealt over tasks by their key, and meet all of its targets once."""
    left = spark.range(1000).select("id", F.when(F.col("id") < 900, 7).otherwise(F.col("id")).alias("cell"))
    right = spark.createDataFrame([(7, "a"), (7, "b"), (950, "c"), (2000, "d")], "cell long, what string")
    got = grid.dealt_join(left, right, "cell", "id", dealt=100)
    assert got.columns == ["cell", "id", "what"]
    assert sorted((x["id"], x["what"]) for x in got.collect()) == sorted([(i, w) for i in range(900) for w in "ab"] + [(950, "c")])
    monkeypatch.setattr(grid, "dealt_join", functools.partial(grid.dealt_join, dealt=8))
    targets = [(k, (k * 37 % 101) / 10, (k * 53 % 97) / 10) for k in range(400)]
    points = [(k, 30.0 + k % 3, -20.0) if k < 60 else (k, (k * 29 % 103) / 10, (k * 31 % 89) / 10) for k in range(120)]
    near = grid.nearest_anywhere(spark.createDataFrame(points, "p long, px double, py double"), spark.createDataFrame(targets, "t long, tx double, ty double"), "p", "t", most=2)
    best = {k: min(((x - a) * (x - a) + (y - b) * (y - b), t) for t, a, b in targets) for k, x, y in points}
    assert {x["p"]: (x["d2"], x["t"]) for x in near.collect()} == best
    assert grid.nearest_anywhere(spark.createDataFrame(points, "p long, px double, py double"), spark.createDataFrame([], "t long, tx double, ty double"), "p", "t").count() == 0


def test_levels_join_by_shuffles(spark, monkeypatch):
    """Only the list of the large groups is broadcast, while nodes are eliminated and put back too."""
    plans = shuffled_only(monkeypatch, elevation)
    segs = spark.range(29).select(F.lit(0).cast("bigint").alias("grp"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("len_ft"))
    segs = segs.union(spark.createDataFrame([(50, 50, 51, 2.0), (50, 51, 52, 2.0)], segs.schema))
    nodes = spark.range(53).select(F.col("id").alias("node"), F.col("id").cast("double").alias("elev_ft"), F.col("id").isin(0, 29, 50, 52).alias("boundary"))
    got = elevation.level_groups(segs, nodes, most=4)
    assert {x["node"]: round(x["elev_ft"], 9) for x in got.collect()} == {n: n for n in [*range(1, 29), 51]}
    joins = [line for _, p in plans for line in p.split("\n") if "BroadcastHashJoin" in line]
    assert len([n for n, _ in plans if n == "level-stars"]) > 1 and [x for x in joins if not re.search(r"Join \[grp#\d+L\], \[grp#\d+L\], Left(Semi|Anti)", x)] == []
