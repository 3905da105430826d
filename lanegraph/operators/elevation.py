"""Elevation: raster sampling, profiles, climb metrics, and correction across structures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.functions import geo
from lanegraph.sources import tiles
from lanegraph.stage import discard, materialize, scoped

#: Grade that costs nothing, and feet between resampled points.
STEEP, SPACING_FT = 0.02, 75.0


def sample_raster(points: DataFrame, raster: DataFrame, width: int, height: int, origin: tuple[float, float], size: tuple[float, float], key: str = "node_id") -> DataFrame:
    """Bilinear value at every point (key, lon, lat), one decimal; outside or without data 0.

    ``raster``: row, col, v. The four cells around a point are exploded and joined, their
    weighted values added up.
    """
    col, row = (F.col("lon") - origin[0]) / size[0], (F.col("lat") - origin[1]) / size[1]
    p = points.select(key, col.alias("x"), row.alias("y")).withColumn("c0", F.greatest(F.least(F.floor("x"), F.lit(width - 2)), F.lit(0))).withColumn("r0", F.greatest(F.least(F.floor("y"), F.lit(height - 2)), F.lit(0)))
    fx, fy = F.col("x") - F.col("c0"), F.col("y") - F.col("r0")
    corner = lambda dr, dc, w: F.struct((F.col("r0") + dr).alias("row"), (F.col("c0") + dc).alias("col"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(0, 1, fx * (1 - fy)), corner(1, 0, (1 - fx) * fy), corner(1, 1, fx * fy))
    inside = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
    cells = p.filter(inside).select(key, F.inline(corners)).join(raster, ["row", "col"])
    sums = cells.groupBy(key).agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.count("v").alias("n"))
    return points.select(key).join(sums.filter("n = 4 and not isnan(v)"), key, "left").select(key, F.round(F.coalesce("v", F.lit(0.0)), 1).alias("elev_ft"))


@scoped("raster-stats")
def raster_stats(raster: DataFrame) -> DataFrame:
    """Range, spread and 99th percentile (interpolated, exact) of the values.

    The percentile's two neighbours by rank are found among counts of equal values, ranked in
    ranges by value; only the ranges' counts meet in one task.
    """
    v = raster.filter("v is not null and not isnan(v)").select(F.col("v").cast("double").alias("v"))
    counts = materialize(v.groupBy("v").agg(F.count("*").alias("n")).repartitionByRange("v").withColumn("part", F.spark_partition_id()), "raster-counts")
    sizes = counts.groupBy("part").agg(F.sum("n").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ranked = counts.withColumn("upto", inside).join(sizes.select("part", before.alias("before")), "part").select("v", (F.col("before") + F.col("upto")).alias("upto"))
    at = 0.99 * max((counts.agg(F.sum("n")).first()[0] or 0) - 1, 0)
    low, high = ranked.agg(F.min(F.when(F.col("upto") > int(at), F.col("v"))), F.min(F.when(F.col("upto") >= at + 1, F.col("v")))).first()
    p99 = None if low is None else low + (at - int(at)) * (high - low)
    return v.agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.stddev_pop("v").alias("std_v"), F.lit(p99).cast("double").alias("p99_v"))


def _at(profile: Column, target: Column) -> Column:
    """Elevation of a profile (array of struct(along, elev)) at a distance."""
    k = F.greatest(F.least(F.size(F.filter(profile, lambda p: p["along"] < target)), F.size(profile) - 1), F.lit(1))
    a, b = F.get(profile, k - 1), F.get(profile, k)
    return F.when(b["along"] > a["along"], a["elev"] + (target - a["along"]) / (b["along"] - a["along"]) * (b["elev"] - a["elev"])).otherwise(a["elev"])


def resample(profile: Column, spacing: float = SPACING_FT) -> Column:
    """struct(step, elevs): elevations at even steps of about ``spacing`` feet."""
    total = F.element_at(profile, -1)["along"]
    n = F.greatest(F.lit(1), F.bround(total / spacing).cast("int"))
    return F.struct((total / n).alias("step"), F.transform(F.sequence(F.lit(0), n), lambda i: _at(profile, F.when(i < n, i * total / n).otherwise(total))).alias("elevs"))


def climb_metrics(even: Column, reverse: Column) -> Column:
    """struct(uphill_ft, max_uphill, steep_ft2) of an even profile, walked backwards where ``reverse``."""
    elevs = F.when(reverse, F.reverse(even["elevs"])).otherwise(even["elevs"])
    rises = F.zip_with(F.slice(elevs, 1, F.size(elevs) - 1), F.slice(elevs, 2, F.size(elevs)), lambda a, b: F.greatest(b - a, F.lit(0.0)))
    step = even["step"]
    add = lambda f: F.aggregate(rises, F.lit(0.0), lambda acc, x: f(acc, x))
    over = lambda x: F.greatest(x / step - STEEP, F.lit(0.0))
    return F.struct(
        geo.rounded(add(lambda acc, x: acc + x), 2).alias("uphill_ft"), geo.rounded(add(lambda acc, x: F.greatest(acc, x / step)), 4).alias("max_uphill"), geo.rounded(add(lambda acc, x: acc + step * over(x) * over(x)), 3).alias("steep_ft2")
    )


def even_metrics(rise: Column, feet: Column) -> tuple[Column, Column, Column]:
    """Uphill feet, greatest grade and steepness of a straight profile."""
    up = (feet > 0) & (rise > 0)
    over = F.greatest(rise / feet - STEEP, F.lit(0.0))
    zero = F.lit(0.0)
    return F.when(up, geo.rounded(rise, 2)).otherwise(zero), F.when(up, geo.rounded(rise / feet, 4)).otherwise(zero), F.when(up, geo.rounded(feet * over * over, 2)).otherwise(zero)


#: Inner nodes of a group that one task solves; MEETING: neighbours of a node that is eliminated, at first.
MOST, MEETING = 2000, 6


@scoped("level")
def level_groups(segs: DataFrame, nodes: DataFrame, most: int = MOST) -> DataFrame:
    """Elevation of the inner nodes of every group of segments (grp, u, v, len_ft): the weighted mean of their neighbours'.

    ``nodes``: node, elev_ft, boundary; boundary nodes keep their elevation, groups without one
    are left out. The equations are solved exactly at every size. Groups of at most ``most``
    inner nodes are solved in one call each. In larger ones, nodes that have few neighbours and
    are not next to one another are eliminated by joins (a chain's segments add up, a star
    becomes the mesh of its ends), round by round, until the rest fits; then they are put back
    in reverse order. A street graph shrinks by a factor per round. One that does not, because
    all its nodes meet hundreds of others, raises an error; nothing unfinished is returned.
    Joins are shuffled but for the list of the large groups, a row for ``most`` inner nodes or more.
    """
    fixed = nodes.filter("boundary").select(F.col("node").alias("other"), "elev_ft")
    links = segs.filter("u <> v").select("grp", F.col("u").alias("node"), F.col("v").alias("other"), (1 / F.greatest("len_ft", F.lit(1e-6))).alias("w"))
    links = links.unionByName(links.select("grp", F.col("other").alias("node"), F.col("node").alias("other"), "w"))
    rows = links.join(nodes.filter("not boundary").select("node").hint("merge"), "node", "left_semi").join(fixed.hint("merge"), "other", "left")
    # A node's ties to the boundary are one conductance ``wf`` and its current ``bf``; the rest are links between inner nodes.
    held = F.col("elev_ft").isNotNull()
    ground = materialize(rows.groupBy("grp", "node").agg(F.sum(F.when(held, F.col("w")).otherwise(0.0)).alias("wf"), F.sum(F.when(held, F.col("w") * F.col("elev_ft")).otherwise(0.0)).alias("bf")), "level-ground")
    inner = materialize(rows.filter(~held).groupBy("grp", "node", "other").agg(F.sum("w").alias("w")), "level-links")
    sizes = ground.groupBy("grp").agg(F.count("*").alias("n"), F.max("wf").alias("tied"))
    good = materialize(sizes.filter("tied > 0").select("grp", "n"), "level-sizes")
    ground, inner = (x.join(good.select("grp").hint("merge"), "grp", "left_semi") for x in (ground, inner))
    large = F.broadcast(good.filter(F.col("n") > most).select("grp"))
    stars, meeting, n_before = [], MEETING, None
    if not large.isEmpty():
        todo_g, todo_l = (materialize(x.join(large, "grp", "left_semi"), "level-todo") for x in (ground, inner))
        ground, inner = ground.join(large, "grp", "left_anti"), inner.join(large, "grp", "left_anti")
        while True:
            star, todo_g, todo_l = _eliminate(todo_g, todo_l, meeting)
            stars.append(star)
            left = todo_g.groupBy("grp").agg(F.count("*").alias("n"))
            n, widest = left.agg(F.sum("n").alias("n"), F.max("n").alias("m")).first()
            if not n or widest <= most:
                break
            if n_before is not None and n > 0.98 * n_before:
                meeting *= 2
                if meeting > 400:
                    raise ValueError(f"a group keeps {widest} nodes that all meet hundreds of others; raise most (now {most}) to solve it at once")
            n_before = n
        ground, inner = ground.unionByName(todo_g), inner.unionByName(todo_l)
    level = materialize(_solved(ground, inner), "level")
    for star in reversed(stars):
        level = materialize(level.unionByName(_put_back(star, level)), "level")
    return level


def _eliminate(ground: DataFrame, links: DataFrame, meeting: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: the eliminated nodes as stars (grp, node, arms, wf, bf, s), and what is left of ground and links."""
    ends = links.groupBy("grp", "node").agg(F.count("*").alias("deg"))
    few = ground.select("grp", "node").join(ends.hint("merge"), ["grp", "node"], "left").filter(F.coalesce("deg", F.lit(0)) <= meeting).select("grp", "node", F.xxhash64("node").alias("h"))
    few = materialize(few, "level-few")
    rival = links.join(few.hint("merge"), ["grp", "node"]).join(few.select("grp", F.col("node").alias("other"), F.struct("h", F.col("node").alias("n")).alias("o")).hint("merge"), ["grp", "other"]).groupBy("grp", "node").agg(F.min("o").alias("o"))
    chosen = materialize(few.join(rival.hint("merge"), ["grp", "node"], "left").filter(F.col("o").isNull() | (F.struct("h", F.col("node").alias("n")) < F.col("o"))).select("grp", "node"), "level-chosen")
    picked = chosen.hint("merge")
    arms = links.join(picked, ["grp", "node"], "left_semi").groupBy("grp", "node").agg(F.collect_list(F.struct("other", "w")).alias("arms"))
    total = F.aggregate("arms", F.col("wf"), lambda acc, x: acc + x["w"])
    star = ground.join(picked, ["grp", "node"], "left_semi").join(arms.hint("merge"), ["grp", "node"], "left").withColumn("arms", F.coalesce("arms", F.array().cast("array<struct<other:bigint,w:double>>")))
    star = materialize(star.withColumn("s", total), "level-stars")
    spread = star.select("grp", "s", "wf", "bf", "arms", F.inline("arms"))
    share = F.col("w") / F.col("s")
    g = ground.join(picked, ["grp", "node"], "left_anti").unionByName(spread.select("grp", F.col("other").alias("node"), (share * F.col("wf")).alias("wf"), (share * F.col("bf")).alias("bf")))
    mesh = spread.select("grp", F.col("other").alias("node"), share.alias("share"), F.explode("arms").alias("arm")).select("grp", "node", F.col("arm.other").alias("other"), (F.col("share") * F.col("arm.w")).alias("w")).filter("node <> other")
    gone = chosen.withColumnRenamed("node", "other").hint("merge")
    kept = links.join(picked, ["grp", "node"], "left_anti").join(gone, ["grp", "other"], "left_anti").unionByName(mesh)
    left_g = materialize(g.groupBy("grp", "node").agg(F.sum("wf").alias("wf"), F.sum("bf").alias("bf")), "level-todo")
    left_l = materialize(kept.groupBy("grp", "node", "other").agg(F.sum("w").alias("w")), "level-todo")
    discard(few, chosen, ground, links)
    return star, left_g, left_l


def _solved(ground: DataFrame, links: DataFrame) -> DataFrame:
    """grp, node, elev_ft of groups small enough for one call each."""
    out = links.groupBy("grp", "node").agg(F.sum("w").alias("ws"), F.collect_list(F.struct("other", "w")).alias("arms"))
    rows = ground.join(out.hint("merge"), ["grp", "node"], "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        names = pdf.node.to_numpy()
        a = np.diag(pdf.wf.to_numpy() + pdf.ws.fillna(0.0).to_numpy())
        for k, arms in enumerate(pdf.arms):
            for x in arms if arms is not None else ():
                a[k, np.searchsorted(names, x["other"])] -= x["w"]
        return pd.DataFrame({"grp": pdf.grp.iloc[0], "node": names, "elev_ft": np.linalg.solve(a, pdf.bf.to_numpy())})

    return rows.groupBy("grp").applyInPandas(solve, "grp bigint, node bigint, elev_ft double")


def _put_back(star: DataFrame, level: DataFrame) -> DataFrame:
    """The eliminated nodes at the weighted mean of their arms' ends."""
    ends = star.select("grp", "node", F.inline("arms")).join(level.select("grp", F.col("node").alias("other"), "elev_ft").hint("merge"), ["grp", "other"])
    sums = ends.groupBy("grp", "node").agg(F.sum(F.col("w") * F.col("elev_ft")).alias("in"))
    return star.join(sums.hint("merge"), ["grp", "node"], "left").select("grp", "node", ((F.coalesce("in", F.lit(0.0)) + F.col("bf")) / F.col("s")).alias("elev_ft"))


def smooth_raster(raster: DataFrame, window: int = 5, sigma: float = 2.0, side: int = tiles.SIDE) -> DataFrame:
    """Cells (row, col, v) after a median over window x window cells and a Gaussian of ``sigma`` cells; see tiles.smooth().

    Cells meet in tiles once; after that only the tiles' borders are shuffled.
    """
    halo, compute = tiles.smooth(window, sigma)
    with tiles.bucketed(tiles.tiles(raster, side), int(raster.sparkSession.conf.get("spark.sql.shuffle.partitions"))) as table:
        done = materialize(tiles.stencil(table, halo, compute, side), "tiles-smoothed")
    return tiles.cells(done, side).filter("v is not null")
