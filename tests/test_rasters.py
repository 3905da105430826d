"""Contour lines, list ranking and raster tiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph.operators import contours, elevation
from lanegraph.operators.chains import rank_chains
from lanegraph.sources import tiles


def raster_of(spark, a):
    return spark.createDataFrame([(i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "row long, col long, v double")


def test_chains_and_rings(spark):
    r = np.random.default_rng(5)
    items, want = [], {}
    for group in (1, 2):
        ids = r.permutation(400).tolist()
        for size, ring in ((1, False), (2, False), (130, False), (1, True), (2, True), (97, True), (64, True)):
            some, ids = ids[:size], ids[size:]
            for k, x in enumerate(some):
                items.append((group, x, some[k - 1] if k or ring else None))
            first = some.index(min(some)) if ring else 0
            want |= {(group, x): (some[first], (k - first) % size, ring) for k, x in enumerate(some)}
    got = {(x["g"], x["id"]): (x["chain"], x["pos"], x["closed"]) for x in rank_chains(spark.createDataFrame(items, "g long, id long, prev long"), ["g"]).collect()}
    assert got == want
    assert rank_chains(spark.createDataFrame([], "g long, id long, prev long"), ["g"]).collect() == []


def test_pieces_pass_between_corners(spark):
    raster = spark.createDataFrame([(0, 0, 0.0), (0, 1, 10.0), (1, 0, 0.0), (1, 1, 10.0), (0, 2, 0.0), (1, 2, 20.0)], "row long, col long, v double")
    got = {(r["col"], frozenset([(r["x0"], r["y0"]), (r["x1"], r["y1"])])) for r in contours.pieces(raster, [5.0]).collect()}
    assert got == {(0, frozenset([(0.5, 0.0), (0.5, 1.0)])), (1, frozenset([(1.5, 0.0), (2.0, 0.25)]))}


@pytest.mark.parametrize("kind", ["hill", "tied", "gaps"])
def test_lines_hold_every_piece(spark, kind):
    """Each piece is in one line, next to its neighbours; lines end at the border or at gaps; ``tied`` has corners at the levels, where lines meet."""
    r = np.random.default_rng(7)
    a = 30 * np.exp(-((np.arange(14)[:, None] - 6) ** 2 + (np.arange(17)[None] - 8) ** 2) / 12) + r.random((14, 17))
    if kind != "hill":
        a = r.integers(0, 4, (14, 17)).astype(float)
    if kind == "gaps":
        a[4, 5] = a[9, 9] = a[10, 2] = np.nan
    levels = [0.5, 10.0, 20.0] if kind == "hill" else [1.0, 2.0, 3.0]
    found = contours.pieces(raster_of(spark, a), levels)
    rows = found.collect()
    trails = contours.trails(found).collect()
    assert len(rows) > 20 and len(trails) == len(rows) == len({(x["level"], x["tail"]) for x in trails}) == len({(x["level"], x["head"]) for x in trails})
    by = {}
    for x in sorted(trails, key=lambda x: x["pos"]):
        by.setdefault((x["level"], x["line"]), []).append(x)
    edge = lambda e: not (0 < (e >> 32) < a.shape[0] - 1) or not (0 < (e & 0xFFFFFFFF) // 2 < a.shape[1] - 1)
    for line in by.values():
        assert [x["pos"] for x in line] == list(range(len(line)))
        for x, y in zip(line, line[1:] + line[:1] * line[0]["closed"], strict=False):
            assert x["head"] == y["tail"] and (x["x1"], x["y1"]) == pytest.approx((y["x0"], y["y0"]))
        if not line[0]["closed"] and kind != "gaps":
            assert edge(line[0]["tail"]) and edge(line[-1]["head"])
    lines = contours.lines(found).collect()
    feet = lambda p: sum(math.dist((a["x"], a["y"]), (b["x"], b["y"])) for a, b in zip(p, p[1:], strict=False))
    assert len(lines) == len(by) and sum(x["n_pieces"] for x in lines) == len(rows)
    for level in levels:
        assert sum(feet(x["points"]) for x in lines if x["level"] == level) == pytest.approx(sum(math.dist((p["x0"], p["y0"]), (p["x1"], p["y1"])) for p in rows if p["level"] == level))
    few = {(x["level"], x["line"]): x["points"] for x in contours.lines(found, 0.3).collect()}
    for x in lines:
        q = [(p["x"], p["y"]) for p in few[x["level"], x["line"]]]
        assert len(q) <= len(x["points"]) and q[0] == (x["points"][0]["x"], x["points"][0]["y"])
        for p in x["points"]:
            assert min(_off((p["x"], p["y"]), a, b) for a, b in zip(q, q[1:] or q, strict=False)) <= 0.3 + 1e-9


def _off(p, a, b):
    d = (b[0] - a[0], b[1] - a[1])
    t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2))) if a != b else 0
    return math.dist(p, (a[0] + t * d[0], a[1] + t * d[1]))


def test_a_stem_that_ends_in_a_triangle(spark):
    """Three peaks at the level that touch in corners: walks by coordinates went round such rings for ever."""
    a = np.zeros((6, 8))
    a[2, 1:5] = a[1, 4] = a[3, 5] = a[2, 6] = 5.0
    found = contours.pieces(raster_of(spark, a), [5.0])
    lines = contours.lines(found).collect()
    assert sum(x["n_pieces"] for x in lines) == found.count() and all(x["closed"] for x in lines)


def smoothed_by_numpy(a, has):
    n, m = a.shape
    med = np.full(a.shape, np.nan)
    for i in range(n):
        for j in range(m):
            near = a[max(i - 2, 0) : i + 3, max(j - 2, 0) : j + 3]
            if has[i, j] and (~np.isnan(near)).any():
                med[i, j] = np.nanmedian(near)
    w = np.exp(-(np.arange(-8, 9) ** 2) / 8)

    def blur(line, own):
        out = np.full(len(line), np.nan)
        for i in range(len(line)):
            at = [(line[i + d], x) for d, x in zip(range(-8, 9), w, strict=True) if 0 <= i + d < len(line) and not np.isnan(line[i + d])]
            if own[i] and at:
                out[i] = sum(v * x for v, x in at) / sum(x for _, x in at)
        return out

    for axis in (0, 1):
        med = np.array([blur(x, o) for x, o in zip(np.moveaxis(med, axis, -1), np.moveaxis(has, axis, -1), strict=True)])
        med = np.moveaxis(med, -1, axis)
    return med


@pytest.mark.parametrize("side", [10, 16, 256])
def test_smoothing_across_tiles(spark, side):
    r = np.random.default_rng(3)
    a = r.integers(0, 50, (37, 29)).astype(float)
    a[r.random(a.shape) < 0.2] = np.nan
    a[5:14, 3:20] = np.nan
    has = r.random(a.shape) > 0.1
    rows = [(i - 12, j + 5, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if has[i, j]]
    raster = spark.createDataFrame(rows, "row long, col long, v double")
    got = {(x["row"] + 12, x["col"] - 5): x["v"] for x in elevation.smooth_raster(raster, side=side).collect()}
    a[~has] = np.nan
    want = smoothed_by_numpy(a, has)
    assert set(got) == set(zip(*(x.tolist() for x in np.nonzero(~np.isnan(want))), strict=True))
    assert all(v == pytest.approx(want[k]) for k, v in got.items())
    assert spark.sql("show tables").filter("tableName like 'tiles%'").count() == 0


def test_only_borders_are_shuffled(spark):
    """The tiles' side of the stencil has no exchange: the table is bucketed by place."""
    raster = spark.range(4000).select((F.col("id") / 40).cast("long").alias("row"), (F.col("id") % 40).alias("col"), F.col("id").cast("double").alias("v"))
    with tiles.bucketed(tiles.tiles(raster, 16), 8) as table:
        plan = tiles.stencil(table, 4, lambda v, has: v[4:-4, 4:-4], 16)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "to_tr" in plan.split("Exchange hashpartitioning")[1].split("\n")[0]
        with pytest.raises(ValueError, match="halo"):
            tiles.stencil(table, 17, lambda v, has: v, 16)


def test_windows_open_their_bands_only(spark, tmp_path):
    raster = spark.range(40_000).select(F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"), F.col("id").cast("double").alias("v"))
    tiles.write_tiles(tiles.tiles(raster, 8), f"{tmp_path}/r")
    some = tiles.read_window(spark, f"{tmp_path}/r", (300, 340), (8, 15), 8)
    read = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in read and "GreaterThanOrEqual(tr,37)" in read and "LessThanOrEqual(tr,42)" in read
    assert len({x[0].rsplit("/", 1)[0] for x in some.select(F.input_file_name()).distinct().collect()}) == 1
    got = {(x["row"], x["col"]): x["v"] for x in tiles.window_cells(spark, f"{tmp_path}/r", (300, 340), (9, 14), 8).collect()}
    assert got == {(i, j): float(20 * i + j) for i in range(300, 341) for j in range(9, 15)}
    assert tiles.window_cells(spark, f"{tmp_path}/r", (9000, 9010), (0, 3), 8).count() == 0


def test_tiles_of_odd_cells(spark):
    cells = spark.createDataFrame([(0, 0, 2.0), (0, 0, 1.0), (0, 0, None), (-1, -1, float("nan")), (-9, 3, 7.0)], "row long, col long, v double")
    assert {(x["row"], x["col"]): x["v"] for x in tiles.cells(tiles.tiles(cells, 4), 4).collect()} == {(0, 0): 1.0, (-1, -1): None, (-9, 3): 7.0}
