"""Paths over an overlay of cells against Dijkstra over edge states, and quadtree cells."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph.operators import grid, overlay, routing, tree
from lanegraph.operators.cell import Cell

STATE = "edge_id long, src long, dst long, cost double, len_ft double, dlon double, dlat double"


def town(seed, wide, tall, missing=0.15):
    """Edges of a jittered lattice both ways, some missing or blocked, and transitions with turn costs."""
    r = np.random.default_rng(seed)
    at = {k: (-122.0 + 0.001 * (k % wide) + float(r.random()) * 3e-4, 47.0 + 0.001 * (k // wide) + float(r.random()) * 3e-4) for k in range(wide * tall)}
    edges = []
    for k in at:
        for n in (k + 1, k + wide):
            if n in at and (n != k + 1 or n % wide) and r.random() > missing:
                feet = 250.0 + float(r.random()) * 300
                for a, b in ((k, n), (n, k)):
                    if r.random() > 0.1:
                        edges.append((len(edges), a, b, None if r.random() < 0.03 else feet * (1 + 2 * float(r.random())), feet, *at[b]))
    out = {}
    for e in edges:
        out.setdefault(e[1], []).append(e)
    steps = [(e[0], n[0], n[3] + float(r.choice([0.0, 0.0, 250.0, 700.0]))) for e in edges for n in out.get(e[2], ()) if n[3] is not None and n[2] != e[1]]
    return edges, steps


def dijkstra(edges, steps, starts, exits):
    """Least cost from the states ``starts`` (state: cost) to an exit (node: cost)."""
    own, after = {e[0]: e for e in edges}, {}
    for a, b, c in steps:
        after.setdefault(a, []).append((b, c))
    heap, done, best = [(g, k) for k, g in starts.items()], set(), None
    heapq.heapify(heap)
    while heap:
        g, k = heapq.heappop(heap)
        if k in done:
            continue
        done.add(k)
        if own[k][2] in exits:
            total = g + exits[own[k][2]]
            best = total if best is None else min(best, total)
        for n, c in after.get(k, ()):
            if n not in done:
                heapq.heappush(heap, (g + c, n))
    return best


@pytest.mark.parametrize(("most", "lot"), [(24, 4), (4000, 1024)])
def test_paths_across_cells(spark, monkeypatch, most, lot):
    """Goals all over the map, many pairs from one cell, cells of a few states, and one cell that holds all."""
    monkeypatch.setattr(overlay, "LOT", lot)
    edges, steps = town(3, 11, 17)
    r = np.random.default_rng(1)
    pairs = [(k, int(a), int(b)) for k, (a, b) in enumerate(r.integers(0, 187, (25, 2)))] + [(100 + k, 0, 150 + k) for k in range(15)] + [(200, 5, 5), (201, 3, 99999)]
    df = spark.createDataFrame(edges, STATE)
    tr = spark.createDataFrame(steps, "prev_edge long, next_edge long, cost double")
    cells = overlay.build(df, tr, most)
    sizes = [x["n"] for x in cells.places.groupBy("cell").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= most and (len(sizes) > 20) == (most == 24)
    got = {x["pair_id"]: x for x in routing.shortest_paths(df, tr, spark.createDataFrame(pairs, "pair_id long, start long, goal long"), cells=cells).collect()}
    own, cost = {e[0]: e for e in edges}, {(a, b): c for a, b, c in steps}
    found = 0
    for k, a, b in pairs:
        want = None if a == b else dijkstra(edges, steps, {e[0]: e[3] for e in edges if e[1] == a and e[3] is not None}, {b: 0.0})
        assert (k in got) == (want is not None)
        if want is not None:
            found += 1
            path = got[k]["path"]
            assert got[k]["cost"] == pytest.approx(want) and own[path[0]][1] == a and own[path[-1]][2] == b
            assert own[path[0]][3] + sum(cost[x] for x in zip(path, path[1:], strict=False)) == pytest.approx(want)
            assert got[k]["feet"] == pytest.approx(sum(own[x][4] for x in path))
    assert found > 25


def test_entries_and_exits_inside_edges(spark):
    """Several entries with costs of their own, exits that cost, and a goal in the cell of the start."""
    edges, steps = town(8, 9, 9)
    usable = [e for e in edges if e[3] is not None]
    r = np.random.default_rng(2)
    entries, exits = [], []
    for pair in range(12):
        for e in r.choice(len(usable), 2, replace=False):
            entries.append((pair, usable[e][0], float(r.random() * 900), 7.0, []))
        exits += [(pair, int(n), float(r.random() * 900), 3.0, -122.0, 47.0) for n in r.integers(0, 81, 2)]
    exits = [x if x[0] else (0, usable[0][2], *x[2:]) for x in exits]
    entries = [x if x[0] else (0, usable[0][0], *x[2:]) for x in entries]
    node = {e[2]: e[5:] for e in edges}
    # the place only steers the search and must not lie farther than the goal: all exits of a pair share the nearest corner here
    exits = [(p, n, c, f, *node[n]) for p, n, c, f, _, _ in exits if n in node]
    exits = [next(x for x in exits if x[0] == p) for p in sorted({x[0] for x in exits})]
    df, tr = spark.createDataFrame(edges, STATE), spark.createDataFrame(steps, "prev_edge long, next_edge long, cost double")
    got = {
        x["pair_id"]: x
        for x in overlay.search(overlay.build(df, tr, 30), df, spark.createDataFrame(entries, "pair_id long, edge_id long, g double, feet double, path array<long>"), spark.createDataFrame(exits, "pair_id long, node_id long, cost double, feet double, lon double, lat double")).collect()
    }
    for p, n, c, _, _, _ in exits:
        starts = {}
        for q, e, g, _, _ in entries:
            if q == p:
                starts[e] = min(g, starts.get(e, g))
        want = dijkstra(edges, steps, starts, {n: c})
        assert (p in got) == (want is not None)
        if want is not None:
            assert got[p]["cost"] == pytest.approx(want) and got[p]["feet"] == pytest.approx(10.0 + sum({e[0]: e[4] for e in edges}[x] for x in got[p]["path"]))


def test_rounds_follow_cells_and_not_edges(spark, monkeypatch):
    """A road of 600 edges in cells of 100 states takes some ten rounds a pass."""
    edges = [(k, k, k + 1, 300.0, 250.0, -122.0 + 0.001 * (k + 1), 47.0) for k in range(600)]
    steps = [(k, k + 1, 300.0) for k in range(599)]
    df, tr = spark.createDataFrame(edges, STATE), spark.createDataFrame(steps, "prev_edge long, next_edge long, cost double")
    cells = overlay.build(df, tr, 100)
    n, rounds, cross = cells.cells.count(), [], overlay.materialize
    monkeypatch.setattr(overlay, "materialize", lambda d, name: rounds.append(name) or cross(d, name))
    row = routing.shortest_paths(df, tr, spark.createDataFrame([(1, 0, 600)], "pair_id long, start long, goal long"), cells=cells).first()
    assert row["cost"] == 600 * 300.0 and row["path"] == list(range(600))
    assert rounds.count("overlay-front") <= 2 * (n + 2) < 60


def test_quad_cells(spark):
    """No cell above the most, but for rows of one place; far outliers and a crowd in one point."""
    r = np.random.default_rng(4)
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(r.normal(0, 1, (3000, 2)))] + [(3000 + k, 0.5 + float(r.random()) * 1e-6, 0.5) for k in range(2000)]
    rows += [(5000 + k, 7.0, 7.0) for k in range(300)] + [(6000, 1e6, -1e6), (6001, None, 1.0), (6002, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = grid.quad_cells(df, "x", "y", 50).collect()
    assert len(got) == len(rows) and {x["id"] for x in got if x["cell"] is None} == {6001, 6002}
    sizes, places = {}, {}
    for x in got:
        sizes[x["cell"]] = sizes.get(x["cell"], 0) + 1
        places.setdefault(x["cell"], set()).add((x["x"], x["y"]))
    deep = {c for c in sizes if c is not None and c >> (2 * grid.DEEPEST) == grid.DEEPEST}
    assert all(n <= 50 or c in deep for c, n in sizes.items() if c is not None)
    assert grid.quad_cells(df.limit(0), "x", "y", 50).count() == 0 and grid.quad_cells(df.filter("id between 5000 and 5300"), "x", "y", 50).select("cell").distinct().count() == 1


def test_rounds_follow_the_tree_and_not_the_cells(spark, monkeypatch):
    """A road of 600 edges in some 50 cells: as many stage tables as the tree is deep, not as cells are passed; ``layer`` is a street's own."""
    edges = [(k, k, k + 1, 300.0, 250.0, -122.0 + 0.001 * (k + 1), 47.0, None) for k in range(600)]
    df, tr = spark.createDataFrame(edges, STATE + ", layer int"), spark.createDataFrame([(k, k + 1, 300.0) for k in range(599)], "prev_edge long, next_edge long, cost double")
    cells = overlay.build(df, tr, 16)
    stages = []
    for module in (overlay, tree):
        monkeypatch.setattr(module, "materialize", lambda d, name, cross=module.materialize: stages.append(name) or cross(d, name))
    row = routing.shortest_paths(df, tr, spark.createDataFrame([(1, 0, 600)], "pair_id long, start long, goal long"), cells=cells).first()
    assert row["cost"] == 600 * 300.0 and row["path"] == list(range(600)) and cells.cells.count() > 35
    assert len(stages) < 20 and "overlay-front" not in stages


def test_wide_cuts_are_searched_by_rounds(spark, monkeypatch):
    """Where a cell's matrix is too large for a task there is no tree, and costs are the same; graphs over the same places stay apart."""
    edges, steps = town(5, 7, 9)
    both = [(2 * e[0] + r, 2 * e[1] + r, 2 * e[2] + r, None if e[3] is None else e[3] * (1 + r), *e[4:], r) for r in range(2) for e in edges]
    df = spark.createDataFrame(both, STATE + ", graph int")
    tr = spark.createDataFrame([(2 * a + r, 2 * b + r, c * (1 + r)) for r in range(2) for a, b, c in steps], "prev_edge long, next_edge long, cost double")
    asked = spark.createDataFrame([(2 * k + r, 2 * a + r, 2 * b + r) for r in range(2) for k, (a, b) in enumerate([(0, 62), (40, 3), (8, 9)])], "pair_id long, start long, goal long")
    cost = lambda cells: {x["pair_id"]: round(x["cost"], 6) for x in routing.shortest_paths(df, tr, asked, cells=cells).collect()}
    joined = overlay.build(df, tr, 40)
    monkeypatch.setattr(tree, "WIDEST", 3)
    apart = overlay.build(df, tr, 40)
    assert joined.above is not None and apart.above is None
    got = cost(joined)
    assert got == cost(apart) and got and all(got[2 * k + 1] == pytest.approx(2 * got[2 * k]) for k in range(3) if 2 * k in got)


@pytest.mark.parametrize("widest", [1 << 24, 3])
def test_totals_and_shared_streets_are_those_of_the_paths(spark, monkeypatch, widest):
    """Sums and common streets, told cell by cell, against the paths spelled out; streets with ends in two cells count once, with a tree and without."""
    monkeypatch.setattr(tree, "WIDEST", widest)
    monkeypatch.setattr(overlay, "LOT", 4)
    edges, steps = town(6, 8, 9)
    at, runs = {}, 3
    for e in edges:
        at.setdefault((min(e[1:3]), max(e[1:3])), len(at))
    every = [(runs * e[0] + r, runs * e[1] + r, runs * e[2] + r, None if e[3] is None else e[4] * (1 + (e[0] * (r + 2)) % 7), *e[4:], r, at[min(e[1:3]), max(e[1:3])]) for r in range(runs) for e in edges]
    price = {e[0]: e[3] for e in every}
    df = spark.createDataFrame(every, STATE + ", graph int, geom long")
    tr = spark.createDataFrame([(runs * a + r, runs * b + r, price[runs * b + r] + 100.0 * r) for r in range(runs) for a, b, _ in steps], "prev_edge long, next_edge long, cost double")
    asked = spark.createDataFrame([(runs * k + r, runs * a + r, runs * b + r) for r in range(runs) for k, (a, b) in enumerate([(0, 71), (0, 70), (64, 7), (8, 9), (30, 31)])], "pair_id long, start long, goal long")
    cells = overlay.build(df, tr, 24 if widest > 3 else 120)
    assert (cells.above is None) == (widest == 3)
    spelled = {x["pair_id"]: x for x in routing.shortest_paths(df, tr, asked, cells=cells).collect()}
    summed = {x["pair_id"]: x for x in routing.shortest_paths(df, tr, asked, cells=cells, spelled=False).collect()}
    assert set(spelled) == set(summed) and len(spelled) > 8
    for k, x in spelled.items():
        assert summed[k]["cost"] == x["cost"] and summed[k]["feet"] == pytest.approx(x["feet"]) and summed[k]["n_edges"] == len(x["path"])
    geom, want = {e[0]: e[-1] for e in every}, {}
    for k, x in spelled.items():
        for g in {geom[e] for e in x["path"]}:
            want[k // runs, g] = want.get((k // runs, g), 0) | 1 << k % runs
    counts = {}
    for (base, _), mask in want.items():
        counts[base, mask] = counts.get((base, mask), 0) + 1
    common = overlay.shared(cells, df, *routing.node_ends(df, asked), runs)
    assert {(x["base"], x["mask"]): x["n"] for x in common.collect()} == counts
    lists = spark.createDataFrame([(k // runs, k % runs, [geom[e] for e in x["path"]]) for k, x in spelled.items()], "pair_id long, run int, geoms array<long>")
    twist = F.element_at(F.array(F.lit("direct"), F.lit("quieter")), F.col("run"))
    by_lists = routing.distinct_alternates(lists.filter("run = 0").drop("run"), lists.filter("run > 0").withColumn("twist", twist).drop("run"))
    assert sorted(routing.distinct_by_counts(common, ["direct", "quieter"]).collect()) == sorted(by_lists.collect())


def test_a_way_does_not_go_in_rings():
    """States 0 and 1 lie in one place: a step between them costs nothing, either way."""
    none = {n: [] for n in ("entries", "outs", "out_cost", "out_state", "out_cell")}
    cell = Cell({"states": [10, 11, 12], "lon": [0.0] * 3, "lat": [0.0] * 3, "feet": [0.0, 0.0, 5.0], "geom": [0, 1, 2], "split": [False] * 3, "a": [1, 0, 1], "b": [0, 1, 2], "c": [0.0, 0.0, 5.0], **none})
    assert cell.path(0, 2) == [11, 12] and cell.path(1, 2) == [12] and cell.way(2, 2) == []
