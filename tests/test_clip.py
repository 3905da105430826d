"""Lines clipped to polygons against fine sampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph.functions import geo


def rings_of(*rings):
    return F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ring]) for ring in rings])


def clipped(spark, lines, *rings):
    rows = [(k, [(float(x), float(y)) for x, y in line]) for k, line in lines.items()]
    df = spark.createDataFrame(rows, "id long, points array<struct<lon:double,lat:double>>")
    out = {}
    for r in sorted(geo.clip_lines(df, rings_of(*rings), "id").collect(), key=lambda r: (r["id"], r["part"])):
        out.setdefault(r["id"], []).append([(p["lon"], p["lat"]) for p in r["points"]])
    return out


def test_parts_by_hand(spark):
    square, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]
    lines = {
        1: [(-5, 5), (15, 5)],  # through the hole
        2: [(1, 1), (2, 2), (3, 1)],  # inside
        3: [(-5, -5), (-1, 20)],  # outside
        4: [(2, 5), (4, 5), (2, 6)],  # touches the hole's edge and turns back
        5: [(5, -1), (5, 1), (11, 1), (11, 8), (9, 8)],  # out and in again
        6: [(1, 9)],
        7: [(-2, 2), (2, -2)],  # past the corner outside
        8: [(2, 4), (4, 6), (5, 8)],  # through a corner of the hole
    }
    got = clipped(spark, lines, square, hole)
    assert got[1] == [[(0, 5), (4, 5)], [(6, 5), (10, 5)]] and got[2] == [[(1, 1), (2, 2), (3, 1)]]
    assert 3 not in got and 6 not in got and 7 not in got
    assert [p[0] for p in got[4]] == [(2, 5)] and got[4][0][-1] == (2, 6)
    assert got[5] == [[(5, 0), (5, 1), (10, 1)], [(10, 8), (9, 8)]]
    assert len(got[8]) == 1 and got[8][0][0] == (2, 4) and got[8][0][-1] == (5, 8)


@pytest.mark.parametrize("seed", [1, 2])
def test_lengths_are_those_inside(spark, seed):
    """Random walks over a jagged star with two holes: each part inside, and as long in all as the sampled line inside."""
    r = np.random.default_rng(seed)
    ring = lambda cx, cy, size, n: [(cx + size * (0.6 + 0.4 * r.random()) * math.cos(2 * math.pi * k / n), cy + size * (0.6 + 0.4 * r.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rings = [ring(0, 0, 10, 17), ring(2, 2, 2, 7), ring(-3, -2, 2, 5)]
    lines = {k: (np.cumsum(r.normal(0, 3, (25, 2)), axis=0)).tolist() for k in range(20)}
    got = clipped(spark, lines, *rings)

    def inside(x, y):
        odd = np.zeros(len(x), bool)
        for one in rings:
            for (ax, ay), (bx, by) in zip(one, one[1:] + one[:1], strict=True):
                odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
        return odd

    many = 0
    for k, line in lines.items():
        want = 0.0
        for a, b in zip(line, line[1:], strict=False):
            t = (np.arange(4000) + 0.5) / 4000
            want += math.dist(a, b) * inside(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])).mean()
        parts = got.get(k, [])
        many += len(parts) > 1
        assert sum(math.dist(p, q) for part in parts for p, q in zip(part, part[1:], strict=False)) == pytest.approx(want, abs=0.2)
        for part in parts:
            for p, q in zip(part, part[1:], strict=False):
                assert inside(np.array([(p[0] + q[0]) / 2]), np.array([(p[1] + q[1]) / 2])).all()
    assert many > 5


def test_segments_beside_a_polygon_are_told_by_its_box(spark):
    square = rings_of([(0, 0), (4, 0), (4, 4), (0, 4)])
    rows = [(1, -3.0, 1.0, -1.0, 1.0), (2, 1.0, 9.0, 1.0, 5.0), (3, -1.0, 2.0, 5.0, 2.0), (4, -2.0, -2.0, 6.0, -1.0), (5, 4.0, 1.0, 9.0, 1.0), (6, 1.0, 1.0, 2.0, 2.0), (7, None, 1.0, 2.0, 2.0), (8, -1.0, 3.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double").select("id", geo.inside_parts(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], square).alias("p"))
    got = {r["id"]: [(round(s["t0"], 6), round(s["t1"], 6)) for s in r["p"]] for r in df.collect()}
    assert got == {1: [], 2: [], 3: [(0.166667, 0.833333)], 4: [], 5: [], 6: [(0.0, 1.0)], 7: [], 8: []}
    # the cuts are computed in one place of the plan, behind the box
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1 and plan.index("CASE WHEN") < plan.index("array_sort(")
