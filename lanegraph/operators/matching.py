"""Attributes carried from one layer onto another by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegraph.functions import geo, tags
from lanegraph.operators import grid
from lanegraph.operators.components import main_component
from lanegraph.stage import materialize

#: Search radii in degrees.
STREET_DEG, FACILITY_DEG, CONTROL_DEG, CIRCLE_DEG, ADDRESS_DEG = 0.00015, 0.00012, 0.0002, 0.00018, 0.0012
SIDEWALK_DEG = 40 / 364000


def samples(edges: DataFrame, n: int, key: str = "edge_id", ends=("slon", "slat", "dlon", "dlat")) -> DataFrame:
    """n points evenly spaced inside each straight edge: key, sample, px, py."""
    x0, y0, x1, y1 = (F.col(c) for c in ends)
    t = F.col("sample") / (n + 1)
    rows = edges.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.select(key, "sample", (x0 + t * (x1 - x0)).alias("px"), (y0 + t * (y1 - y0)).alias("py"))


def majority(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The most frequent value that is neither null nor empty; of equals, the one seen first."""
    counted = rows.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(by, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(by).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value))


def street_attributes(edges: DataFrame, streets: DataFrame, attributes: list[str], key: str = "edge_id", street: str = "fac_id") -> DataFrame:
    """Each edge's majority, over four samples, of the nearest street's attributes."""
    near = grid.points_near_segments(samples(edges, 4, key), streets, STREET_DEG, cell=0.0003)
    hits = grid.nearest(near, [key, "sample"], [F.col("dist"), F.col(street)])
    out = edges.select(key)
    for a in attributes:
        out = out.join(majority(hits.select(key, "sample", a), key, a, "sample"), key, "left")
    return out


def all_facilities(streets: DataFrame, trails: DataFrame, regional: DataFrame, network: DataFrame) -> DataFrame:
    """Facilities of the four sources with their class; what has none is left out: source, fac_id, category, model and the geometry's columns.

    ``streets``: status, category, model; ``network``: category; every line of the trails and the
    regional trails is off-street.
    """
    off = F.lit("BKF-OFFST")
    kinds = {
        "streets": (streets, tags.facility_class(F.col("status"), F.col("category")), F.col("model") if "model" in streets.columns else F.lit(None)),
        "trails": (trails, off, F.lit(None)),
        "regional": (regional, off, F.lit(None)),
        "network": (network, tags.network_class(F.col("category")), F.lit(None)),
    }
    out = None
    for name, (rows, kind, model) in kinds.items():
        ends = [c for c in ("x0", "y0", "x1", "y1") if c in rows.columns]
        one = rows.select(F.lit(name).alias("source"), "fac_id", kind.alias("category"), model.cast("string").alias("model"), *ends).filter("category is not null")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def circle_points(tagged: DataFrame, layer: DataFrame, rings: DataFrame) -> DataFrame:
    """Points of traffic circles by tag, from the layer, and found as small rings: source, circle_id, lon, lat."""
    own = lambda rows, name, key: rows.select(F.lit(name).alias("source"), F.col(key).alias("circle_id"), "lon", "lat")
    return own(layer, "layer", "circle_id").unionByName(own(tagged, "tag", "node_id")).unionByName(own(rings, "ring", "component"))


def best_facility(edges: DataFrame, facilities: DataFrame, key: str = "edge_id", facility: str = "fac_id") -> DataFrame:
    """Each edge's best-ranked facility within reach of three samples; of equals, the first sample's, then the lowest id."""
    near = grid.points_near_segments(samples(edges, 3, key), facilities, FACILITY_DEG, cell=0.0003)
    ranked = near.withColumn("rank", tags.facility_rank(F.col("category"))).filter("rank is not null")
    best = grid.nearest(ranked.select(key, "rank", "sample", facility, "category"), [key], [F.col("rank"), F.col("sample"), F.col(facility)])
    return edges.select(key).join(best.select(key, "category", facility), key, "left")


def node_controls(nodes: DataFrame, signs: DataFrame) -> DataFrame:
    """Every node's flags of the controls within reach: signal, crosswalk, beacon, and stop facings as bits."""
    facing = F.create_map(*[F.lit(x) for pair in tags.FACING_BITS.items() for x in pair])[F.upper(F.trim("facing"))]
    near = grid.points_near_points(nodes.select("node_id", F.col("lon").alias("ax"), F.col("lat").alias("ay")), signs.select("kind", "facing", F.col("lon").alias("bx"), F.col("lat").alias("by")), CONTROL_DEG)
    flags = near.groupBy("node_id").agg(
        *[F.bool_or(F.col("kind") == k).alias(f"has_{k}") for k in ("signal", "crosswalk", "beacon")],
        F.bit_or(F.when(F.col("kind") == "stop", F.pow(F.lit(2), facing).cast("bigint"))).alias("stop_bits"),
    )
    none = {f"has_{k}": False for k in ("signal", "crosswalk", "beacon")} | {"stop_bits": 0}
    return nodes.select("node_id").join(flags, "node_id", "left").na.fill(none)


def circle_members(nodes: DataFrame, circles: DataFrame, key: str = "circle_id") -> DataFrame:
    """node_id and the last (largest key) circle that holds it."""
    near = grid.points_near_points(nodes.select("node_id", F.col("lon").alias("ax"), F.col("lat").alias("ay")), circles.select(key, F.col("lon").alias("bx"), F.col("lat").alias("by")), CIRCLE_DEG)
    return near.groupBy("node_id").agg(F.max(key).alias(key))


def collapse_circles(edges: DataFrame, nodes: DataFrame, circles: DataFrame, base: int, key: str = "circle_id") -> tuple[DataFrame, DataFrame]:
    """Edges between circle centres instead of their members, and the centres.

    Centres are the means of all nodes in reach of a circle; an edge inside one circle goes.
    """
    member = circle_members(nodes, circles, key).select("node_id", (F.lit(base) + F.col(key)).alias("synth"))
    near = grid.points_near_points(nodes.select("node_id", F.col("lon").alias("ax"), F.col("lat").alias("ay")), circles.select(key, F.col("lon").alias("bx"), F.col("lat").alias("by")), CIRCLE_DEG)
    centres = near.groupBy(key).agg(F.avg("ax").alias("lon"), F.avg("ay").alias("lat")).select((F.lit(base) + F.col(key)).alias("node_id"), "lon", "lat")
    a, b = member.withColumnsRenamed({"node_id": "a", "synth": "a2"}), member.withColumnsRenamed({"node_id": "b", "synth": "b2"})
    moved = edges.join(a, "a", "left").join(b, "b", "left").withColumn("a", F.coalesce("a2", "a")).withColumn("b", F.coalesce("b2", "b")).drop("a2", "b2")
    return moved.filter("a <> b"), centres


def sidewalk_offsets(sidewalks: DataFrame, roads: DataFrame, key: str = "edge_id", road: str = "road_id") -> DataFrame:
    """Bearing from the nearest road's centre line to each sidewalk's middle, one decimal; null without a road in reach."""
    mid = sidewalks.select(key, ((F.col("slon") + F.col("dlon")) / 2).alias("px"), ((F.col("slat") + F.col("dlat")) / 2).alias("py"))
    near = grid.nearest(grid.points_near_segments(mid, roads, SIDEWALK_DEG, cell=0.0003), [key], [F.col("dist"), F.col(road)])
    x, y = F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0")), F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0"))
    return sidewalks.select(key).join(near.select(key, road, F.round(geo.bearing(x, y, F.col("px"), F.col("py")), 1).alias("offset_bearing")), key, "left")


def crossing_lanes(sidewalks: DataFrame, roads: DataFrame, key: str = "edge_id") -> DataFrame:
    """Most lanes among the roads each sidewalk crosses; null if none."""
    a = sidewalks.select(key, F.col("slon").alias("ax0"), F.col("slat").alias("ay0"), F.col("dlon").alias("ax1"), F.col("dlat").alias("ay1"))
    b = roads.select("lanes", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    most = grid.segments_meeting(a, b, 0.001, ([key], ["lanes", "bx0", "by0", "bx1", "by1"]), strict=True).groupBy(key).agg(F.round(F.max("lanes"), 2).alias("crosswalk_lanes"))
    return sidewalks.select(key).join(most, key, "left")


def nearest_address(pois: DataFrame, addresses: DataFrame) -> DataFrame:
    """Each point of interest with the nearest address in its box, or none."""
    a = pois.select("poi_id", F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    b = addresses.select("addr_id", "label", F.col("lon").alias("bx"), F.col("lat").alias("by"))
    best = grid.nearest(grid.points_near_points(a, b, ADDRESS_DEG, box=True), ["poi_id"], [F.col("d2"), F.col("addr_id")])
    return pois.select("poi_id").join(best.select("poi_id", "addr_id", F.col("label").alias("address"), "d2"), "poi_id", "left")


def untagged_crossings(segs: DataFrame, size: float) -> DataFrame:
    """Pairs (i, j) of segments (seg_id, a, b, ax, ay, bx, by_, tagged) that meet without a shared node, not both tagged."""
    one = segs.select(F.col("seg_id").alias("i"), F.col("a").alias("ia"), F.col("b").alias("ib"), F.col("tagged").alias("it"), F.col("ax").alias("ax0"), F.col("ay").alias("ay0"), F.col("bx").alias("ax1"), F.col("by_").alias("ay1"))
    two = segs.select(F.col("seg_id").alias("j"), F.col("a").alias("ja"), F.col("b").alias("jb"), F.col("tagged").alias("jt"), F.col("ax").alias("bx0"), F.col("ay").alias("by0"), F.col("bx").alias("bx1"), F.col("by_").alias("by1"))
    apart = ~(F.col("ia").isin(F.col("ja"), F.col("jb")) | F.col("ib").isin(F.col("ja"), F.col("jb")))
    return grid.segments_meeting(one, two, size, (["i"], ["j"])).filter((F.col("i") < F.col("j")) & apart & ~(F.col("it") & F.col("jt"))).select("i", "j", "it", "jt")


def snap_to_edges(points: DataFrame, edges: DataFrame, radius_ft: float = 200.0, point: str = "point_id") -> DataFrame:
    """Each point's nearest edge that is no sidewalk within the radius: edge, t, feet away, feet along and left."""
    reach = radius_ft / geo.FT_PER_LON
    segs = edges.filter("not is_sidewalk").select("edge_id", "src", "dst", "len_ft", F.col("slon").alias("x0"), F.col("slat").alias("y0"), F.col("dlon").alias("x1"), F.col("dlat").alias("y1"))
    near = lambda p: grid.points_near_segments(p, segs, reach, cell=0.001, sx=geo.FT_PER_LON, sy=geo.FT_PER_LAT, limit=radius_ft)
    best = grid.nearest_of(points, near, point, "dist", ["edge_id"])
    return best.select(point, "edge_id", "src", "dst", "t", "dist", (F.col("t") * F.col("len_ft")).alias("from_ft"), ((1 - F.col("t")) * F.col("len_ft")).alias("to_ft"))


def snap_to_nodes(points: DataFrame, nodes: DataFrame, radius: float | None, point: str = "point_id") -> DataFrame:
    """Each point's nearest node within the radius in degrees, or at any distance where that is None."""
    if radius is None:
        return grid.nearest_anywhere(points, nodes, point, "node_id", tx="lon", ty="lat")
    a = points.select(point, F.col("px").alias("ax"), F.col("py").alias("ay"))
    b = nodes.select("node_id", F.col("lon").alias("bx"), F.col("lat").alias("by"))
    return grid.nearest_of(a, lambda p: grid.points_near_points(p, b, radius), point, "d2", ["node_id"]).select(point, "node_id", "d2")


def snap(points: DataFrame, edges: DataFrame, nodes: DataFrame, radius_ft: float = 200.0, node_radius: float | None = 0.0024, point: str = "point_id", main: DataFrame | None = None) -> DataFrame:
    """Edge projection where one is in reach, else the nearest node (at any distance if ``node_radius`` is None), else nothing.

    Only the main component counts: ``main`` (node), found here if it is not given.
    """
    main = materialize(main_component(edges), "main") if main is None else main
    edges = edges.join(main.withColumnRenamed("node", "src").hint("merge"), "src", "left_semi")
    nodes = nodes.join(main.withColumnRenamed("node", "node_id").hint("merge"), "node_id", "left_semi")
    e = snap_to_edges(points, edges, radius_ft, point).select(point, "edge_id", "t", "from_ft", "to_ft")
    n = snap_to_nodes(points, nodes, node_radius, point).select(point, "node_id")
    kind = F.when(F.col("edge_id").isNotNull(), "edge").when(F.col("node_id").isNotNull(), "node")
    return points.select(point).join(e.hint("merge"), point, "left").join(n.hint("merge"), point, "left").withColumn("kind", kind).withColumn("node_id", F.when(F.col("kind") == "node", F.col("node_id")))


def rack_tier(places: DataFrame, racks: DataFrame, green_ft: float = 300.0, yellow_ft: float = 1000.0) -> DataFrame:
    """green with a count, yellow with distance and direction, or red, for each place (place_id, ax, ay)."""
    lat, lon = yellow_ft / 364000, yellow_ft / 247000
    near = grid.points_near_points(places, racks.select("rack_id", F.col("lon").alias("bx"), F.col("lat").alias("by")), lon, box=True).filter(F.abs(F.col("ay") - F.col("by")) <= lat)
    d = near.withColumn("ft", geo.haversine_ft(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    per = d.groupBy("place_id").agg(F.count_if(F.col("ft") <= green_ft).alias("n"), F.min(F.struct("ft", "rack_id", "ax", "ay", "bx", "by")).alias("m"))
    tier = F.when(F.col("n") > 0, "green").when(F.col("m.ft") <= yellow_ft, "yellow").otherwise("red")
    yellow = F.col("tier") == "yellow"
    way: Column = geo.compass8(F.round(geo.bearing(F.col("m.ax"), F.col("m.ay"), F.col("m.bx"), F.col("m.by")), 6))
    out = places.select("place_id").join(per, "place_id", "left").withColumn("tier", F.coalesce(tier, F.lit("red")))
    return out.select("place_id", "tier", F.when(F.col("tier") == "green", F.col("n")).alias("n_racks"), F.when(yellow, F.round("m.ft").cast("bigint")).alias("distance_ft"), F.when(yellow, way).alias("direction"))


def flagged_segments(pairs: DataFrame) -> DataFrame:
    """The untagged members of crossing pairs."""
    return pairs.filter("not it").select(F.col("i").alias("seg_id")).union(pairs.filter("not jt").select(F.col("j").alias("seg_id"))).distinct()
