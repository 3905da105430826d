"""Group profiles and other summaries of flagged edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.operators.components import connected_components

#: The tiers of an edge's infrastructure, sidewalks first.
def tier(facility: Column, sidewalk: Column, centerline: Column) -> Column:
    return (
        F.when(sidewalk, "sidewalk").when(facility.isin("BKF-NGW", "BKF-PBL", "BKF-OFFST"), "aaa").when(facility == "BKF-BBL", "bbl").when(facility == "BKF-BL", "bl")
        .when(facility.isin("BKF-CLMB", "BKF-SHW"), "shw").when(~centerline, "local").otherwise("major")
    )


def distinct_segments(edges: DataFrame, key: str = "edge_id") -> DataFrame:
    """The first edge, by id, of every unordered pair of ends."""
    rest = [c for c in edges.columns if c != key]
    first = edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min(F.struct(key, *rest)).alias("f"))
    return first.select("u", "v", "f.*")


def segment_groups(segs: DataFrame) -> DataFrame:
    """Flagged segments (edge_id, u, v, ...) with ``grp``, the smallest node they are connected to."""
    labels = connected_components(segs, "u", "v").select(F.col("node").alias("u"), F.col("component").alias("grp"))
    return segs.join(labels.hint("merge"), "u")


def mode_first(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Most frequent value that is not null; of equals, the first."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("f"))
    return n.groupBy(by).agg(F.max_by(value, F.struct("n", -F.col("f"))).alias(value))


def group_signals(grouped: DataFrame) -> DataFrame:
    """Per group: segments, bridges, tunnels, and the commonest layer of the rest; with ``rank``, its height if known."""
    layered = F.when(~F.col("is_bridge") & ~F.col("is_tunnel") & (F.col("layer") != 0), F.col("layer"))
    g = grouped.withColumn("_layer", layered)
    counts = g.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("is_bridge").alias("bridges"), F.count_if(F.col("is_tunnel") & ~F.col("is_bridge")).alias("tunnels"))
    out = counts.join(mode_first(g, "grp", "_layer", "edge_id").withColumnRenamed("_layer", "layer_mode"), "grp", "left")
    up, down, layer = F.col("bridges") > 0, F.col("tunnels") > 0, F.col("layer_mode")
    rank = F.when(up & ~down, F.greatest(F.lit(1), F.coalesce(layer, F.lit(1)))).when(down & ~up, F.least(F.lit(-1), F.coalesce(layer, F.lit(-1)))).otherwise(layer)
    return out.withColumn("rank", rank)


def segment_rank(bridge: Column, tunnel: Column, layer: Column) -> Column:
    """Height of a segment: its layer where that fits its structure, else 1 for bridges and -1 for tunnels; null if unknown."""
    return F.when(bridge, F.when(layer > 0, layer).otherwise(1)).when(tunnel, F.when(layer < 0, layer).otherwise(-1)).otherwise(F.when(layer != 0, layer))


def layer_distribution(segs: DataFrame) -> DataFrame:
    """Segments (is_bridge, is_tunnel, is_crossing, is_approach, layer) per kind and layer."""
    layered = F.coalesce(F.col("layer") != 0, F.lit(False))
    kind = F.when(F.col("is_bridge"), "bridge").when(F.col("is_tunnel"), "tunnel")
    plain = F.when(kind.isNotNull(), F.concat(kind, F.lit("-no-layer"))).when(F.col("is_crossing"), "untagged-crossing").when(F.col("is_approach"), "approach")
    label = F.when(layered, F.format_string("%s L=%+d", F.coalesce(kind, F.lit("plain-layered")), F.col("layer"))).otherwise(plain)
    return segs.groupBy(label.alias("label")).agg(F.count("*").alias("n")).filter("label is not null")


def group_ranks(grouped: DataFrame) -> DataFrame:
    """Per group: its segments' commonest rank (of equals, the first), and how many ranks they have."""
    ranked = grouped.withColumn("_rank", segment_rank(F.col("is_bridge"), F.col("is_tunnel"), F.col("layer")))
    sets = ranked.groupBy("grp").agg(F.count_distinct("_rank").alias("n_ranks"))
    return sets.join(mode_first(ranked, "grp", "_rank", "edge_id").withColumnRenamed("_rank", "rank"), "grp", "left")


def mix(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per ``by``: how often each value occurs, as ``value=count`` joined by bars, in the order of values; nulls as <none>."""
    n = rows.groupBy(by, F.coalesce(F.col(value).cast("string"), F.lit("<none>")).alias("v")).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("v", "n"))), lambda x: F.concat_ws("=", x["v"], x["n"].cast("string"))), "|").alias(value))


def group_places(grouped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per group: the mean of its segments' ends, and its extent in degrees."""
    ends = grouped.select("grp", F.explode(F.array("u", "v")).alias("node_id")).join(nodes.select("node_id", "lon", "lat"), "node_id")
    span = lambda c: F.max(c) - F.min(c)
    return ends.groupBy("grp").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), span("lon").alias("dlon"), span("lat").alias("dlat"))


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows per combination of values, nulls among them."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def unlisted(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not listed; each key once."""
    return rows.select(key).distinct().join(listed.select(key), key, "left_anti")


def size_histogram(grouped: DataFrame) -> DataFrame:
    """How many groups have each size."""
    return grouped.groupBy("grp").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def largest_groups(grouped: DataFrame, top: int = 15, names: int = 8) -> DataFrame:
    """The largest groups (of equals, the smallest id) with size, feet and their most frequent names."""
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("size"), F.round(F.sum("len_ft"), 3).alias("feet"), F.sum(F.col("is_bridge").cast("long")).alias("bridges")).orderBy(F.desc("size"), "grp").limit(top)
    n = grouped.join(sizes.select("grp"), "grp", "left_semi").filter("street is not null").groupBy("grp", "street").agg(F.count("*").alias("n"))
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "street"))).filter(F.col("r") <= names)
    words = ranked.groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "street"))), lambda x: x["street"]), "|").alias("names"))
    return sizes.join(words, "grp", "left")


def boundary_nodes(segs: DataFrame) -> DataFrame:
    """Nodes of flagged segments (u, v, flagged): boundary if an unflagged segment meets them."""
    ends = segs.select(F.col("u").alias("node"), "flagged").union(segs.select(F.col("v").alias("node"), "flagged"))
    return ends.groupBy("node").agg(F.bool_or("flagged").alias("inside"), F.bool_or(~F.col("flagged")).alias("boundary")).filter("inside").drop("inside")


def histogram(rows: DataFrame, value: str, tops: list[float]) -> DataFrame:
    """Rows per bin: the first bin whose top the value does not pass, or the overflow."""
    bins = F.lit(len(tops))
    for k in range(len(tops) - 1, -1, -1):
        bins = F.when(F.col(value) <= tops[k], k).otherwise(bins)
    return rows.filter(F.col(value).isNotNull()).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))


def stacks(rows: DataFrame, point: str, group: str, least: int = 3, top: int = 20) -> DataFrame:
    """Points where at least ``least`` distinct groups meet, most first."""
    n = rows.select(point, group).distinct().groupBy(point).agg(F.count("*").alias("n_groups"))
    return n.filter(F.col("n_groups") >= least).orderBy(F.desc("n_groups"), point).limit(top)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements by the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def manifest_diff(installed: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote files that are new or differ by hash."""
    return remote.join(installed, (remote["url"] == installed["url"]) & (remote["hash"] == installed["hash"]), "left_anti")


def visible(groups: DataFrame, checked: DataFrame) -> DataFrame:
    """Layers (layer, grp) that show: all their groups are checked; a group not listed counts as checked."""
    return groups.join(checked, "grp", "left").groupBy("layer").agg(F.bool_and(F.coalesce("checked", F.lit(True))).alias("visible"))


def changed(settings: DataFrame, defaults: DataFrame, key: str = "grp", value: str = "checked") -> DataFrame:
    """Settings that differ from their default, nulls compared as values."""
    d = defaults.select(key, F.col(value).alias("_default"))
    return settings.join(d, key).filter(~F.col(value).eqNullSafe(F.col("_default"))).drop("_default")


def first_by_place(rows: DataFrame, label: list[Column], order: str, digits: int = 5) -> DataFrame:
    """The first row of every label (lower-cased) at every place, to ``digits`` decimals."""
    keys = [F.lower(c) for c in label] + [F.round("lon", digits), F.round("lat", digits)]
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    rest = [c for c in rows.columns if c != order]
    return rows.groupBy(*named).agg(F.min(F.struct(order, *rest)).alias("f")).select("f.*")


def shared_geometries(rows: DataFrame, points: str = "points") -> DataFrame:
    """One row per line whatever its direction: the lesser of the two orders, and how many rows have it."""
    return rows.groupBy(F.least(points, F.reverse(points)).alias(points)).agg(F.count("*").alias("n"))


def overshoot(edges: DataFrame, reach: DataFrame, limit: float) -> DataFrame:
    """Of approach edges with one end in reach: how many, their feet, and the feet beyond the limit, by category."""
    a = reach.select(F.col("node_id").alias("src"), F.struct("dist", "category").alias("x"))
    b = reach.select(F.col("node_id").alias("dst"), F.struct("dist", "category").alias("y"))
    e = edges.join(a, "src", "left").join(b, "dst", "left").filter(F.col("x").isNull() != F.col("y").isNull())
    near = F.coalesce("x", "y")
    beyond = F.col("len_ft") - F.least(F.col("len_ft"), F.greatest(F.lit(limit) - near["dist"], F.lit(0.0)))
    return e.groupBy(near["category"].alias("category")).agg(F.count("*").alias("n"), F.sum("len_ft").alias("feet"), F.sum(beyond).alias("beyond_ft"))


def orderable(pairs: DataFrame) -> DataFrame:
    """Crossing pairs (ra, rb: ranks or null) counted by what is known: both, one or neither."""
    kind = F.when(F.col("ra").isNull() & F.col("rb").isNull(), "unknown").when(F.col("ra").isNotNull() & F.col("rb").isNotNull() & (F.col("ra") != F.col("rb")), "both").otherwise("one")
    return pairs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(kind != "unknown").alias("n_orderable"))
