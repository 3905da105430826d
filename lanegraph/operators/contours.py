"""Contour lines of a raster: pieces by marching squares, put in order by list ranking.

A piece runs through one cell from one grid edge (``tail``) to another (``head``) with the higher
ground on its right (rows run downwards). Two cells share a grid edge, and where a line leaves
one it enters the other, so every edge has one piece that ends on it and one that begins: pieces
form chains and rings, also where lines of a level meet in one corner because the raster holds
that very value there. Places are compared by grid edge, never by coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.operators.chains import rank_chains
from lanegraph.stage import discard, materialize, scoped


def pieces(raster: DataFrame, levels: list[float]) -> DataFrame:
    """level, row, col (of the cell), tail, head, x0, y0, x1, y1 of every piece.

    ``raster``: row, col, v; cells with a corner that is missing, null or not a number have no
    piece. A corner at a level counts as above it. A saddle is split by its mean.
    """
    known = raster.filter("v is not null and not isnan(v)")
    at = lambda name, dr, dc: known.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("v").alias(name))
    cells = at("a", 0, 0).join(at("b", 0, 1), ["row", "col"]).join(at("c", 1, 1), ["row", "col"]).join(at("d", 1, 0), ["row", "col"])
    c = cells.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).filter((F.least("a", "b", "c", "d") < F.col("level")) & (F.greatest("a", "b", "c", "d") >= F.col("level")))
    x, y, lev = F.col("col").cast("double"), F.col("row").cast("double"), F.col("level")
    cut = lambda p, q: (lev - F.col(p)) / (F.col(q) - F.col(p))
    edge = lambda r, k, upright: F.shiftleft((F.col("row") + r).cast("bigint"), 32) + 2 * (F.col("col") + k) + upright
    split = lambda p, q: (F.col(p) < lev) != (F.col(q) < lev)
    # a line leaves a cell by a side if the corner to its right, looking out, is high
    side = lambda e, px, py, right: F.struct(e.alias("e"), px.alias("x"), py.alias("y"), (F.col(right) >= lev).alias("out"))
    top, right = side(edge(0, 0, 0), x + cut("a", "b"), y, "b"), side(edge(0, 1, 1), x + 1, y + cut("b", "c"), "c")
    bottom, left = side(edge(1, 0, 0), x + cut("d", "c"), y + 1, "d"), side(edge(0, 0, 1), x, y + cut("a", "d"), "a")
    hits = F.array_compact(F.array(F.when(split("a", "b"), top), F.when(split("b", "c"), right), F.when(split("d", "c"), bottom), F.when(split("a", "d"), left)))
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    same = ((F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 < lev) == (F.col("a") < lev)
    four = F.when(same, F.array(pair(top, right), pair(bottom, left))).otherwise(F.array(pair(top, left), pair(right, bottom)))
    both = c.withColumn("hits", hits).select("level", "row", "col", F.inline(F.when(F.size("hits") == 4, four).otherwise(F.array(pair(F.get("hits", F.lit(0)), F.get("hits", F.lit(1)))))))
    way = both.select("level", "row", "col", F.when(F.col("p.out"), F.struct("q", "p")).otherwise(F.struct(F.col("p").alias("q"), F.col("q").alias("p"))).alias("w"))
    return way.select("level", "row", "col", F.col("w.q.e").alias("tail"), F.col("w.p.e").alias("head"), F.col("w.q.x").alias("x0"), F.col("w.q.y").alias("y0"), F.col("w.p.x").alias("x1"), F.col("w.p.y").alias("y1"))


@scoped("contour-trails")
def trails(found: DataFrame) -> DataFrame:
    """The pieces with line, pos (from 0 along it) and closed; every piece lies in one line, at one place."""
    before = found.select("level", F.col("head").alias("tail"), F.col("tail").alias("prev"))
    ranked = rank_chains(found.select("level", "tail").join(before, ["level", "tail"], "left").withColumnRenamed("tail", "id"), ["level"])
    return found.join(ranked.withColumnsRenamed({"id": "tail", "chain": "line"}), ["level", "tail"])


def lines(found: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """level, line, closed, n_pieces and points (x, y) of every line, simplified to ``tolerance`` where it is above 0.

    Equal points next to one another are one. A closed line begins and ends with the tail of its least grid edge.
    """
    kept = materialize(found, "contour-pieces")
    ordered = trails(kept).groupBy("level", "line", "closed").agg(F.sort_array(F.collect_list(F.struct("pos", "x0", "y0", "x1", "y1"))).alias("s"))
    point = lambda p, x, y: F.struct(p[x].alias("x"), p[y].alias("y"))
    end = F.element_at("s", -1)
    points = F.concat(F.transform("s", lambda p: point(p, "x0", "y0")), F.array(point(end, "x1", "y1")))
    rows = ordered.select("level", "line", "closed", F.size("s").alias("n_pieces"), points.alias("points"))
    apart = F.filter("points", lambda p, i: (i == 0) | (p != F.get(F.col("points"), F.greatest(i - 1, F.lit(0)))))
    out = materialize(rows.withColumn("points", apart), "contour-lines")
    discard(kept)
    return out.mapInArrow(_simplify(tolerance), out.schema) if tolerance > 0 else out


def _simplify(tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("points")
            some = [[{"x": x, "y": y} for x, y in simplified([(p["x"], p["y"]) for p in line], tolerance)] for line in b.column(k).to_pylist()]
            yield b.set_column(k, "points", pa.array(some, b.schema.field(k).type))

    return run


def simplified(path: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """The path without points closer than ``tolerance`` to the line between those that stay, farthest points first."""
    p = np.array(path)
    keep, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        (x, y), d = p[i], p[j] - p[i]
        inner, size = p[i + 1 : j], float(np.hypot(*d))
        off = np.abs(d[0] * (inner[:, 1] - y) - d[1] * (inner[:, 0] - x)) / size if size else np.hypot(inner[:, 0] - x, inner[:, 1] - y)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return [tuple(x) for x in p[keep].tolist()]
