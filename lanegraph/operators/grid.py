"""Radius joins on a uniform grid.

One side is indexed in every cell it may reach, the other in the one cell that holds it; the
join is on the cell, so its partitions follow the map, and the exact test comes after it. It is
always shuffled: what is filed has many times the rows that Spark's estimate of its table says,
and by that a side of a gigabyte was broadcast. Cells are as wide as
the radius or wider. A pair meets in one cell only, so nothing is deduplicated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.functions import geo
from lanegraph.stage import materialize, scoped


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("bigint")


def _cells(lo: Column, hi: Column, size: float, pad: float) -> Column:
    return F.sequence(_cell(lo - pad, size), _cell(hi + pad, size))


def filed(df: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], size: float, pad: float) -> DataFrame:
    """Rows in every cell their padded box covers, as _cx, _cy."""
    return df.withColumn("_cx", F.explode(_cells(*x, size, pad))).withColumn("_cy", F.explode(_cells(*y, size, pad)))


def placed(df: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    return df.withColumn("_cx", _cell(x, size)).withColumn("_cy", _cell(y, size))


def points_near_points(a: DataFrame, b: DataFrame, radius: float, ax="ax", ay="ay", bx="bx", by="by", box: bool = False) -> DataFrame:
    """Pairs within ``radius`` (in the columns' unit), or within its box; adds ``d2``, the squared distance."""
    at = (F.col(bx), F.col(by))
    left = placed(a, F.col(ax), F.col(ay), radius)
    right = filed(b, (at[0], at[0]), (at[1], at[1]), radius, radius)
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    near = (F.abs(dx) <= radius) & (F.abs(dy) <= radius) if box else dx * dx + dy * dy <= radius * radius
    return left.join(right.hint("merge"), ["_cx", "_cy"]).drop("_cx", "_cy").filter(near).withColumn("d2", dx * dx + dy * dy)


def filed_lines(df: DataFrame, ends: tuple[str, str, str, str], size: float, pad: float) -> DataFrame:
    """Rows in every cell that the segment comes within ``pad`` of (and a few at its sides), as _cx, _cy.

    Column by column: the part of the segment over a column, and ``pad`` more on each side, gives the column's
    cells, so a segment has as many rows as cells it passes, not as its bounding box holds.
    """
    x0, y0, x1, y1 = (F.col(c) for c in ends)
    swap = x1 < x0
    lx, ly = F.when(swap, x1).otherwise(x0), F.when(swap, y1).otherwise(y0)
    hx, hy = F.when(swap, x0).otherwise(x1), F.when(swap, y0).otherwise(y1)
    # rounding may move a cut by a part in 10^9 of a cell
    reach = pad + size * 1e-9
    slope = F.when(hx > lx, (hy - ly) / (hx - lx)).otherwise(F.lit(0.0))

    def cells(cx: Column) -> Column:
        left, right = F.greatest(lx, cx * size - reach), F.least(hx, (cx + 1) * size + reach)
        a, b = ly + (left - lx) * slope, ly + (right - lx) * slope
        a, b = F.when(hx > lx, a).otherwise(ly), F.when(hx > lx, b).otherwise(hy)
        return F.struct(cx.alias("_cx"), F.sequence(_cell(F.least(a, b) - reach, size), _cell(F.greatest(a, b) + reach, size)).alias("_cys"))

    columns = F.transform(F.sequence(_cell(lx - reach, size), _cell(hx + reach, size)), cells)
    return df.select("*", F.inline(columns)).select(*df.columns, "_cx", F.explode("_cys").alias("_cy"))


def points_near_segments(
    points: DataFrame, segs: DataFrame, radius: float, px="px", py="py", ends=("x0", "y0", "x1", "y1"), cell: float | None = None, sx: float = 1.0, sy: float = 1.0, limit: float | None = None
) -> DataFrame:
    """Pairs of points and segments within ``radius`` degrees (or ``limit`` in scaled units), with ``t`` and ``dist``."""
    size = max(cell or radius, radius)
    x0, y0, x1, y1 = (F.col(c) for c in ends)
    left = placed(points, F.col(px), F.col(py), size)
    right = filed_lines(segs, ends, size, radius)
    t, dist = geo.project(F.col(px), F.col(py), x0, y0, x1, y1, sx, sy)
    return left.join(right.hint("merge"), ["_cx", "_cy"]).drop("_cx", "_cy").withColumn("t", t).withColumn("dist", dist).filter(F.col("dist") <= (radius if limit is None else limit))


def segments_meeting(a: DataFrame, b: DataFrame, size: float, keys: tuple[list[str], list[str]], a_ends=("ax0", "ay0", "ax1", "ay1"), b_ends=("bx0", "by0", "bx1", "by1"), strict: bool = False) -> DataFrame:
    """Pairs of segments that meet (or, strictly, cross), once each: by ``keys``, the columns that tell a row of ``a`` and of ``b``.

    Segments that meet share the cell of a point they share; where they pass several cells together, the pair is
    tested in each and kept once.
    """
    p, q = [F.col(c) for c in a_ends], [F.col(c) for c in b_ends]
    test = (geo.segments_cross if strict else geo.segments_meet)((p[0], p[1]), (p[2], p[3]), (q[0], q[1]), (q[2], q[3]))
    both = filed_lines(a, a_ends, size, 0.0).join(filed_lines(b, b_ends, size, 0.0).hint("merge"), ["_cx", "_cy"])
    return both.drop("_cx", "_cy").filter(test).dropDuplicates([*keys[0], *keys[1]])


def nearest(pairs: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first pair of each ``by`` in the order, by a partial minimum (no window, no sort of a hot key)."""
    rest = [c for c in pairs.columns if c not in by]
    best = F.min(F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(order)], *[F.col(c) for c in rest])).alias("_best")
    return pairs.groupBy(*by).agg(best).select(*by, *[F.col(f"_best.{c}") for c in rest])


def nearest_of(points: DataFrame, near: Callable[[DataFrame], DataFrame], key: str, far: str, order: list[str]) -> DataFrame:
    """The first of the pairs ``near(points)`` of every point by ``far`` (a number), then ``order``.

    Least distances are found first, in a hash aggregate of one number a point; pairs beyond them
    go in the join, so what is sorted is a pair a point (or its equals) and not all that is in reach.
    """
    bound = near(points).groupBy(key).agg(F.min(far).alias("_bound"))
    first = near(points.join(bound.hint("merge"), key)).filter(F.col(far) <= F.col("_bound")).drop("_bound")
    return nearest(first, [key], [F.col(far), *[F.col(c) for c in order]])


#: Rows of a key that one task joins, where keys may be crowded.
DEALT = 1 << 16


def dealt_join(left: DataFrame, right: DataFrame, on: str, by: str, dealt: int = DEALT) -> DataFrame:
    """``left`` joined to ``right``, which has few rows a key, by a shuffle; a key with more than ``dealt`` rows of ``left`` is dealt by ``by`` over several tasks.

    Only such keys are broadcast, with the number of their parts: a row for ``dealt`` rows of ``left`` at most.
    """
    crowded = left.groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") > dealt).select(on, F.ceil(F.col("_n") / dealt).cast("bigint").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    one = left.join(F.broadcast(crowded), on, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts)).drop("_parts")
    two = right.join(F.broadcast(crowded), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
    return one.join(two.hint("merge"), [on, "_part"]).drop("_part")


#: Deepest level of a quadtree, levels a round goes down, and levels whose cells are broadcast where all points meet them.
DEEPEST, DOWN, TOP = 24, 3, 6


def quad_cells(rows: DataFrame, x: str, y: str, most: int, name: str = "cell") -> DataFrame:
    """``rows`` with ``name``, the largest cell of a quadtree around each place that holds at most ``most`` rows.

    Cells are numbers that tell level and place; see quad_box(). Rounds go down three levels
    at a time, only with the rows of cells that are still too full, which are counted as partial
    sums; those of the top levels are few and broadcast, the others shuffled. Cells of the
    deepest level may hold more: rows of one place stay together. Rows without a place have a
    null cell.
    """
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    box = quad_extent(known, x, y)
    at = lambda c, lo: F.floor((F.col(c) - lo) / box[2] * (1 << DEEPEST)).cast("bigint")
    todo, level = known.withColumn("_qx", at(x, box[0])).withColumn("_qy", at(y, box[1])), 0
    done: list[DataFrame] = [rows.filter(F.col(x).isNull() | F.col(y).isNull() | F.isnan(x) | F.isnan(y)).withColumn(name, F.lit(None).cast("bigint"))]
    while True:
        down = min(DOWN, DEEPEST - level)
        keys = [[F.shiftright(c, DEEPEST - level - k).alias(f"{c}{k}") for c in ("_qx", "_qy")] for k in range(down + 1)]
        counts = todo.groupBy(*keys[down]).agg(F.count("*").alias("n"))
        for k in range(down):
            counts = counts.withColumns({f"{c}{k}": F.shiftright(f"{c}{down}", down - k) for c in ("_qx", "_qy")})
        n = [F.sum("n").over(Window.partitionBy(f"_qx{k}", f"_qy{k}")) for k in range(down + 1)]
        depth = F.lit(down)
        for k in reversed(range(down)):
            depth = F.when(n[k] <= most, k).otherwise(depth)
        spot = F.shiftleft(f"_qx{down}", DEEPEST) + F.col(f"_qy{down}")
        sized = counts.select(spot.alias("_at"), depth.alias("_depth"), ((n[down] > most) & F.lit(level + down < DEEPEST)).alias("_more"))
        sized = F.broadcast(sized) if level + down <= TOP else sized.hint("merge")
        here = todo.select("*", *keys[down]).withColumn("_at", spot).join(sized, "_at")
        code = lambda k: quad_code(F.lit(level + k), F.shiftright(f"_qx{down}", down - k), F.shiftright(f"_qy{down}", down - k))  # noqa: B023, E731
        cell = code(down)
        for k in range(down):
            cell = F.when(F.col("_depth") == k, code(k)).otherwise(cell)
        placed_ = materialize(here.select(*rows.columns, "_qx", "_qy", "_more", cell.alias(name)), "quad-cells")
        done.append(placed_.filter("not _more").select(*rows.columns, name))
        todo, level = placed_.filter("_more").drop("_more", name), level + down
        if level >= DEEPEST or todo.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def quad_extent(rows: DataFrame, x: str, y: str) -> tuple[float, float, float]:
    """Least x and y, and the side of a square that holds all places inside its upper bounds."""
    x0, y0, x1, y1 = rows.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return (0.0, 0.0, 1.0) if x0 is None else (x0, y0, (max(x1 - x0, y1 - y0) or 1.0) * 1.000001)


def quad_code(level: Column, cx: Column, cy: Column) -> Column:
    """The number of a cell."""
    return F.shiftleft(level.cast("bigint"), 2 * DEEPEST) + F.shiftleft(cx, DEEPEST) + cy


def quad_box(code: Column, box: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """Least x and y of a cell, and its side; ``box``: the tree's extent."""
    level, low = F.shiftright(code, 2 * DEEPEST), (1 << DEEPEST) - 1
    side = F.lit(box[2]) / F.pow(F.lit(2.0), level)
    return F.lit(box[0]) + F.shiftright(code, DEEPEST).bitwiseAND(low) * side, F.lit(box[1]) + code.bitwiseAND(F.lit(low)) * side, side


def quad_parent(code: Column, up: Column) -> Column:
    """The cell ``up`` levels above."""
    low, level = (1 << DEEPEST) - 1, F.shiftright(code, 2 * DEEPEST)
    above = lambda c: F.floor(c / F.pow(F.lit(2.0), up)).cast("bigint")
    return quad_code(level - up, above(F.shiftright(code, DEEPEST).bitwiseAND(low)), above(code.bitwiseAND(F.lit(low))))


@scoped("nearest")
def nearest_anywhere(points: DataFrame, targets: DataFrame, key: str, target: str, px="px", py="py", tx="tx", ty="ty", most: int = 64) -> DataFrame:
    """Each point's nearest target at any distance: key, target, d2; of equals the lowest target. No row if there are no targets.

    Targets (one to a place, the lowest) are dealt to the cells of a quadtree that hold at most
    ``most``, so crowds lie in many small cells and empty land in few. A first round gives every
    point a bound: the distance to the representative of the smallest cell above it that has
    one. Further rounds go down the tree from the root, three levels at a time, to the cells
    that lie within the bound and no others, and tighten it by the representatives they meet;
    the targets of the last cells are compared. Points without a place have no row.

    The tree's top (TOP levels, some 5500 cells at most) is broadcast, as all points meet there;
    cells below it are joined by shuffles, however few bytes they take on disk, and cells
    where points crowd (all beyond the map's edge do) are dealt over several tasks.
    """
    places = targets.filter(F.col(tx).isNotNull() & F.col(ty).isNotNull() & ~F.isnan(tx) & ~F.isnan(ty)).groupBy(F.col(tx).alias("tx"), F.col(ty).alias("ty")).agg(F.min(target).alias(target))
    placed_ = materialize(quad_cells(places, "tx", "ty", most, "leaf"), "nearest-targets")
    box = quad_extent(placed_, "tx", "ty")
    level = lambda c: F.shiftright(c, 2 * DEEPEST)
    leaves = placed_.groupBy("leaf").agg(F.min(F.struct(target, "tx", "ty")).alias("r")).select(F.col("leaf").alias("node"), "r", F.lit(True).alias("last"))
    # The cells above a leaf that were too full, at every third level, up to the root.
    ups = F.transform(F.filter(F.sequence(F.lit(0), F.lit(DEEPEST), F.lit(DOWN)), lambda k: k < level(F.col("node"))), lambda k: quad_parent(F.col("node"), (level(F.col("node")) - k).cast("int")))
    inner = leaves.select("r", F.explode(ups).alias("node")).groupBy("node").agg(F.min("r").alias("r")).select("node", "r", F.lit(False).alias("last"))
    step = F.when(level(F.col("node")) == 0, 0).otherwise(F.pmod(level(F.col("node")) - 1, F.lit(DOWN)) + 1).cast("int")
    nodes = materialize(leaves.unionByName(inner).withColumn("parent", F.when(level(F.col("node")) > 0, quad_parent(F.col("node"), step))), "nearest-nodes")
    asked = materialize(points.filter(F.col(px).isNotNull() & F.col(py).isNotNull() & ~F.isnan(px) & ~F.isnan(py)).select(key, F.col(px).cast("double").alias("px"), F.col(py).cast("double").alias("py")), "nearest-points")
    d2 = lambda x, y: (F.col("px") - x) * (F.col("px") - x) + (F.col("py") - y) * (F.col("py") - y)
    # The point's own way down the tree: a point outside goes by the nearest place inside.
    at = lambda c, lo: F.least(F.greatest(F.floor((F.col(c) - lo) / box[2] * (1 << DEEPEST)), F.lit(0)), F.lit((1 << DEEPEST) - 1)).cast("bigint")
    top, deep = F.broadcast(nodes.filter(level(F.col("node")) <= TOP)), nodes.filter(level(F.col("node")) > TOP)
    levels = [r[0] for r in nodes.select(level(F.col("node"))).distinct().collect()]
    above = lambda some: asked.select(key, "px", "py", F.explode(_ancestors(at("px", box[0]), at("py", box[1]), some)).alias("node"))
    met = above([k for k in levels if k <= TOP] or [0]).join(top.select("node", "r"), "node")
    if max(levels, default=0) > TOP:
        met = met.unionByName(dealt_join(above([k for k in levels if k > TOP]), deep.select("node", "r"), "node", key))
    bound = met.groupBy(key).agg(F.min(d2(F.col("r.tx"), F.col("r.ty"))).alias("bound"))
    front = materialize(_rooted(asked.join(bound.hint("merge"), key), nodes), "nearest-front")
    done: list[DataFrame] = []
    x, y, side = quad_box(F.col("node"), box)
    away = lambda c, lo: F.greatest(lo - F.col(c), F.col(c) - lo - side, F.lit(0.0))
    # cells are placed with rounding: a part in 10^9 of the extent is allowed for
    off = lambda c, lo: F.greatest(away(c, lo) - box[2] * 1e-9, F.lit(0.0))
    depth = 0
    while True:
        depth += DOWN
        done.append(front.filter("last").select(key, "px", "py", "node", "bound"))
        open_ = front.filter("not last")
        if open_.isEmpty():
            break
        open_ = open_.select(key, "px", "py", "bound", F.col("node").alias("parent"))
        below = open_.join(top.filter("parent is not null"), "parent") if depth <= TOP else dealt_join(open_, deep.filter("parent is not null"), "parent", key)
        seen = below.filter(off("px", x) * off("px", x) + off("py", y) * off("py", y) <= F.col("bound")).withColumn("near", d2(F.col("r.tx"), F.col("r.ty")))
        tight = Window.partitionBy(key)
        front = materialize(seen.withColumn("bound", F.least("bound", F.min("near").over(tight))).filter(off("px", x) * off("px", x) + off("py", y) * off("py", y) <= F.col("bound")).select(key, "px", "py", "bound", "node", "last"), "nearest-front")
    last = done[0]
    for d in done[1:]:
        last = last.unionByName(d)
    pairs = lambda p: dealt_join(p, placed_.withColumnRenamed("leaf", "node"), "node", key).withColumn("d2", d2(F.col("tx"), F.col("ty")))
    return nearest_of(last.drop("bound"), pairs, key, "d2", [target]).select(key, target, "d2")


def _ancestors(qx: Column, qy: Column, levels: list[int]) -> Column:
    """The cells of the levels that hold a place, given in units of the deepest level."""
    return F.array(*[quad_code(F.lit(k), F.shiftright(qx, DEEPEST - k), F.shiftright(qy, DEEPEST - k)) for k in levels])


def _rooted(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points at the root, whose number is 0."""
    return points.withColumn("node", F.lit(0).cast("bigint")).join(F.broadcast(nodes.filter("node = 0").select("node", "last")), "node")
