"""Edge costs, turn and crossing penalties, and shortest paths for many pairs at once.

The path state is the directed edge last taken, so penalties that depend on two edges are
exact. Transitions (edge, next edge, cost) are a table; a search step joins all pairs'
frontiers with it, keeps the least cost per (pair, edge), and drops what cannot beat the best
arrival by a great-circle bound. The number of steps is the number of edges on the longest
path kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.functions import geo
from lanegraph.operators import audit, overlay
from lanegraph.stage import discard, fresh_path, materialize, scoped

#: Slider settings of the presets, and the changes each twist makes.
PRESETS = {"athletic": {"s1": 0.2, "s2": 0.5, "s3": 0.2, "s4": 0.2, "s5": 0.2}, "comfort": {"s1": 0.7, "s2": 0.5, "s3": 0.7, "s4": 0.7, "s5": 0.7}}
TWISTS = {"quieter": {"s1": 0.3, "s3": 0.3, "s4": 0.3}, "direct": {"s1": -0.2, "s2": 0.5, "s3": -0.2, "s4": -0.2}, "flatter": {"s5": 0.5}}
#: Share of a slider in a facility's base and in its cost per lane.
FACILITY_BASE = {"BKF-NGW": 0.0, "BKF-PBL": 0.0, "BKF-OFFST": 0.0, "BKF-BBL": 1.0, "BKF-BL": 1.5, "BKF-CLMB": 2.5, "BKF-SHW": 2.5}
FACILITY_LANE = {"BKF-NGW": 0.0, "BKF-PBL": 0.0, "BKF-OFFST": 0.0, "BKF-BBL": 0.5, "BKF-BL": 1.0, "BKF-CLMB": 1.0, "BKF-SHW": 1.0}
LANES_FREE = 3.0
SIDEWALK, SHORT_SIDEWALK_FT = 3.0, 50.0
#: Crossing penalty by lanes, before the slider; more lanes cannot be crossed.
CROSSING = ((1, 0), (2, 400), (3, 800), (4, 1600), (5, 1600))
ACROSS_DEG = 60


def _clip(v: float | None) -> float:
    return max(0.0, min(1.0, 0.5 if v is None else v))


@dataclass(frozen=True)
class Weights:
    """Five sliders in [0, 1], and whether long sidewalks may be used."""

    s1: float = 0.5
    s2: float = 0.5
    s3: float = 0.5
    s4: float = 0.5
    s5: float = 0.5
    sidewalks: bool = False

    @classmethod
    def of(cls, sliders: dict[str, float], sidewalks: bool = False) -> Weights:
        return cls(*[_clip(sliders.get(k)) for k in ("s1", "s2", "s3", "s4", "s5")], sidewalks)

    def twisted(self, twist: str) -> Weights:
        own = {k: getattr(self, k) for k in ("s1", "s2", "s3", "s4", "s5")}
        return Weights.of({k: _clip(v + TWISTS[twist].get(k, 0.0)) for k, v in own.items()}, self.sidewalks)


def multiplier(w: Weights, facility: Column, sidewalk: Column, centerline: Column, lanes: Column, feet: Column) -> Column:
    """Cost of a foot; null where the edge may not be used."""
    extra = F.greatest(F.lit(0.0), lanes - LANES_FREE)
    own = F.when(sidewalk, F.when((feet <= SHORT_SIDEWALK_FT) | F.lit(w.sidewalks), F.lit(SIDEWALK)))
    for name, base in FACILITY_BASE.items():
        own = own.when(facility == name, F.lit(1.0 + base * w.s1) + F.lit(FACILITY_LANE[name] * w.s4) * extra)
    return own.when(~centerline, F.lit(1 + w.s1)).otherwise(F.lit(1.5 + 2.5 * w.s1) + F.lit(1.5 * w.s4) * extra)


def climb_cost(w: Weights, uphill_ft: Column, steep_ft2: Column) -> Column:
    return uphill_ft * (40 * w.s5) + steep_ft2 * (400 * w.s5)


def edge_costs(edges: DataFrame, w: Weights) -> DataFrame:
    """Adds ``cost``; uphill_ft and steep_ft2 count where the edges have them."""
    return edges.withColumn("cost", cost(w, edges))


def cost(w: Weights, edges: DataFrame) -> Column:
    """The cost of edge_costs()."""
    c = F.col("len_ft") * multiplier(w, F.col("facility"), F.col("is_sidewalk"), F.col("has_centerline"), F.col("lanes"), F.col("len_ft"))
    if "uphill_ft" in edges.columns:
        c = c + climb_cost(w, F.col("uphill_ft"), F.col("steep_ft2"))
    return c


def by_tier(edges: DataFrame) -> DataFrame:
    """Edges, feet and cost of each infrastructure tier."""
    t = audit.tier(F.col("facility"), F.col("is_sidewalk"), F.col("has_centerline"))
    return edges.groupBy(t.alias("tier")).agg(F.count("*").alias("n_edges"), F.sum("len_ft").alias("feet"), F.sum("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("n_blocked"))


def turned(before: Column, after: Column, circle: Column) -> Column:
    """Whether a turn counts."""
    return ~F.coalesce((F.abs(geo.turn_delta(before, after)) <= geo.TURN_DEG) | circle, F.lit(False))


def turn_penalty(w: Weights, before: Column, after: Column, circle: Column) -> Column:
    return F.when(turned(before, after, circle), F.lit(500 * w.s2)).otherwise(F.lit(0.0))


def crossing_penalty(w: Weights, lanes: Column) -> Column:
    """By lanes of the street crossed; null beyond the last anchor."""
    out = F.when(lanes <= CROSSING[0][0], F.lit(0.0))
    for (l0, p0), (l1, p1) in zip(CROSSING, CROSSING[1:], strict=False):
        out = out.when(lanes <= l1, (p0 + (lanes - l0) / (l1 - l0) * (p1 - p0)) * (2 * w.s3))
    return out


def transitions(edges: DataFrame, nodes: DataFrame, w: Weights) -> DataFrame:
    """(prev_edge, next_edge, cost of the next edge with turn and crossing penalties); blocked ones are left out.

    ``edges``: edge_id, src, dst, b0, b1, cost, lanes, has_centerline, is_sidewalk,
    crosswalk_lanes; ``nodes``: node_id, has_signal, has_crosswalk, has_beacon, is_circle,
    stop_bits (bits 4 to 11). The street crossed is the widest that leaves the node across
    both edges; it counts where it has a centre line and more lanes than they, and unless a
    control or two facing stops hold it.
    """
    return priced(crossed(edges, nodes), w)


def priced(crossings: DataFrame, w: Weights) -> DataFrame:
    """transitions() from crossed()."""
    penalty = lambda lanes: F.when(F.col(lanes).isNull(), F.lit(0.0)).otherwise(crossing_penalty(w, F.col(lanes)))
    total = F.col("cost") + F.when(F.col("turned"), F.lit(500 * w.s2)).otherwise(F.lit(0.0)) + penalty("cross_lanes") + penalty("walk_lanes")
    return crossings.select("prev_edge", "next_edge", total.alias("cost")).filter("cost is not null")


def crossed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What transitions() are priced by, whatever the weights: prev_edge, next_edge, the next one's ``cost`` (of any type), turned, cross_lanes and walk_lanes (null where nothing is to be paid)."""
    p = edges.select(F.col("edge_id").alias("prev_edge"), F.col("src").alias("p_src"), F.col("dst").alias("at"), F.col("b1").alias("p_b1"), F.col("lanes").alias("p_lanes"), F.col("is_sidewalk").alias("p_walk"))
    n = edges.filter("cost is not null").select(F.col("edge_id").alias("next_edge"), F.col("src").alias("at"), F.col("b0").alias("n_b0"), F.col("lanes").alias("n_lanes"), F.col("is_sidewalk").alias("n_walk"), "crosswalk_lanes", "cost")
    x = edges.select(F.col("edge_id").alias("x_edge"), F.col("src").alias("at"), F.col("dst").alias("x_dst"), F.col("b0").alias("x_b0"), F.col("lanes").alias("x_lanes"), F.col("has_centerline").alias("x_line"))
    pairs = p.join(n, "at")
    across = (F.col("x_edge") != F.col("next_edge")) & (F.col("x_dst") != F.col("p_src")) & (geo.axis_angle(F.col("x_b0"), F.col("n_b0")) >= ACROSS_DEG) & (geo.axis_angle(F.col("x_b0"), F.col("p_b1")) >= ACROSS_DEG)
    widest = pairs.join(x, "at").filter(across & (F.col("x_lanes") > 0)).groupBy("prev_edge", "next_edge").agg(F.max(F.struct("x_lanes", -F.col("x_edge"), "x_line", "x_b0")).alias("x"))
    at = nodes.select(F.col("node_id").alias("at"), (F.col("has_signal") | F.col("has_crosswalk") | F.col("has_beacon")).alias("held"), "is_circle", "stop_bits")
    both = pairs.join(at, "at").join(widest, ["prev_edge", "next_edge"], "left")
    stopped = lambda b: geo.stop_faces(F.col("stop_bits"), b) & geo.stop_faces(F.col("stop_bits"), b + 180)
    free = (
        (F.col("p_walk") & F.col("n_walk")) | F.col("held") | F.col("x").isNull() | ~F.col("x.x_line")
        | (F.col("x.x_lanes") <= F.greatest("p_lanes", "n_lanes")) | stopped(F.col("x.x_b0"))
    )
    cross = F.when(~F.coalesce(free, F.lit(True)), F.col("x.x_lanes"))
    walk = F.col("crosswalk_lanes")
    unpaid = walk.isNull() | (walk <= 0) | F.col("held") | stopped(F.pmod(F.col("n_b0") + 90, F.lit(360.0)))
    crosswalk = F.when(~F.coalesce(unpaid, F.lit(False)), walk)
    return both.select("prev_edge", "next_edge", "cost", turned(F.col("p_b1"), F.col("n_b0"), F.col("is_circle")).alias("turned"), cross.alias("cross_lanes"), crosswalk.alias("walk_lanes"))


def shortest_paths(edges: DataFrame, steps: DataFrame, pairs: DataFrame, by: str = "edge", cells: overlay.Overlay | None = None, spelled: bool = True) -> DataFrame:
    """Cheapest path of every pair (pair_id, start, goal: nodes): cost, feet, path (edge ids).

    Pairs without a path, or from a node to itself, have no row. With an overlay of the edges
    (overlay.build) pairs may lie any way apart; without one, see search() for the rest. Not
    ``spelled``, rows have the path's n_edges instead of it.
    """
    return _found(edges, steps, *node_ends(edges, pairs), by, cells, spelled)


def _found(edges: DataFrame, steps: DataFrame, entries: DataFrame, exits: DataFrame, by: str, cells: overlay.Overlay | None, spelled: bool) -> DataFrame:
    if cells:
        return (overlay.search if spelled else overlay.totals)(cells, edges, entries, exits)
    found = search(edges, steps, entries, exits, by)
    return found if spelled else found.withColumn("n_edges", F.size("path")).drop("path")


def node_ends(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and exits (see search()) of pairs of nodes."""
    place = edges.groupBy(F.col("dst").alias("node_id")).agg(F.min(F.struct(F.col("dlon").alias("lon"), F.col("dlat").alias("lat"))).alias("p"))
    asked = pairs.filter("start <> goal")
    exits = asked.select("pair_id", F.col("goal").alias("node_id"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("feet")).join(place, "node_id").select("pair_id", "node_id", "cost", "feet", "p.lon", "p.lat")
    out = edges.filter("cost is not null").select("edge_id", F.col("src").alias("start"), "cost")
    entries = asked.join(out, "start").select("pair_id", "edge_id", F.col("cost").alias("g"), F.lit(0.0).alias("feet"), F.array("edge_id").alias("path"))
    return entries, exits


def paths_between(edges: DataFrame, steps: DataFrame, projections: DataFrame, pairs: DataFrame, by: str = "edge", cells: overlay.Overlay | None = None, spelled: bool = True) -> DataFrame:
    """Cheapest path of every pair (pair_id, start, goal: points on edges) by their projections (see with_reverse).

    Cost and feet hold the parts of the first and last edge; ``path`` the whole edges between,
    none where both points are next to one node. Points on one edge are joined by way of its ends.
    Not ``spelled``, rows have n_edges, how many these are.
    """
    ways = {starting: mid_edge_ends(projections, edges, starting) for starting in (True, False)}
    entries = pairs.join(ways[True].withColumnRenamed("point_id", "start"), "start").select("pair_id", F.col("way").alias("edge_id"), F.col("cost").alias("g"), "feet", F.array().cast("array<bigint>").alias("path"))
    own = edges.select("edge_id", "slon", "slat", "dlon", "dlat")
    share = F.col("from_ft") / (F.col("from_ft") + F.col("to_ft"))
    place = projections.join(own, "edge_id").select(F.col("point_id").alias("goal"), (F.col("slon") + share * (F.col("dlon") - F.col("slon"))).alias("lon"), (F.col("slat") + share * (F.col("dlat") - F.col("slat"))).alias("lat"))
    exits = pairs.join(ways[False].withColumnRenamed("point_id", "goal"), "goal").join(place, "goal").select("pair_id", "node_id", "cost", "feet", "lon", "lat")
    return _found(edges, steps, entries, exits, by, cells, spelled)


@scoped("search")
def search(edges: DataFrame, steps: DataFrame, entries: DataFrame, exits: DataFrame, by: str = "edge") -> DataFrame:
    """Cheapest way from any entry to any exit of every pair: cost, feet, path (edge ids).

    ``entries``: pair_id, edge_id (the edge taken so far, whole or in part), g, feet (of a part),
    path; ``exits``: pair_id, node_id, cost, feet, lon, lat (of the goal); ``edges``: edge_id,
    dst, cost, len_ft, dlon, dlat; ``steps``: transitions(). With ``by="edge"`` the state is the
    edge last taken, so costs are exact; with ``by="node"`` every node keeps one way to it, the
    cheapest found, as the single interactive search does, and penalties behind it follow from that.
    """
    if by not in ("edge", "node"):
        raise ValueError(by)
    key = "edge_id" if by == "edge" else "dst"
    goals = exits.groupBy("pair_id").agg(F.first("lon").alias("glon"), F.first("lat").alias("glat"))
    table = materialize(steps.join(edges.select(F.col("edge_id").alias("next_edge"), "dst", "dlon", "dlat"), "next_edge").withColumnRenamed("cost", "step"), "steps")
    rest = ["g", "edge_id", "dst", "dlon", "dlat", "glon", "glat", "feet", "path"]

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("pair_id", F.col(key).alias("_key")).agg(F.min(F.struct(*rest)).alias("m")).select("pair_id", "_key", "m.*")

    # Every round writes the states it improved to a folder of its own below one path; together they are all that is known.
    base, spark = fresh_path(edges.sparkSession, "search"), edges.sparkSession
    first = least(entries.join(edges.select("edge_id", "dst", "dlon", "dlat"), "edge_id").join(goals, "pair_id").select("pair_id", *rest))
    asked = materialize(exits.select("pair_id", F.col("node_id").alias("dst"), F.col("cost").alias("out_cost"), F.col("feet").alias("out_ft")), "search-exits")
    first.write.parquet(f"{base}/0")
    reader, turn = spark.read.schema(first.schema), 0
    while True:
        front, known = reader.parquet(f"{base}/{turn}"), reader.option("recursiveFileLookup", "true").parquet(base)
        if front.isEmpty():
            break
        bound = known.select("pair_id", "dst", "g").join(asked, ["pair_id", "dst"]).groupBy("pair_id").agg(F.min(F.col("g") + F.col("out_cost")).alias("bound"))
        ahead = geo.haversine_ft(F.col("dlon"), F.col("dlat"), F.col("glon"), F.col("glat"))
        live = front.join(bound, "pair_id", "left").filter(F.col("bound").isNull() | (F.col("g") + ahead < F.col("bound")))
        moved = live.select("pair_id", "g", F.col("edge_id").alias("prev_edge"), "glon", "glat", "feet", "path").join(table, "prev_edge").select(
            "pair_id", (F.col("g") + F.col("step")).alias("g"), F.col("next_edge").alias("edge_id"), "dst", "dlon", "dlat", "glon", "glat", "feet", F.concat("path", F.array("next_edge")).alias("path")
        )
        best = known.groupBy("pair_id", "_key").agg(F.min("g").alias("old"))
        least(moved).join(best, ["pair_id", "_key"], "left").filter("old is null or g < old").drop("old").write.parquet(f"{base}/{turn + 1}")
        turn += 1
    ends = known.join(asked, ["pair_id", "dst"]).select("pair_id", F.struct((F.col("g") + F.col("out_cost")).alias("g"), "path", (F.col("feet") + F.col("out_ft")).alias("feet")).alias("m"))
    found = materialize(ends.groupBy("pair_id").agg(F.min("m").alias("m")).select("pair_id", F.col("m.g").alias("cost"), "m.path", F.col("m.feet").alias("part_ft")), "search-found")
    discard(table, asked)
    between = found.select("pair_id", F.explode("path").alias("edge_id")).join(edges.select("edge_id", "len_ft"), "edge_id").groupBy("pair_id").agg(F.sum("len_ft").alias("whole_ft"))
    return found.join(between, "pair_id", "left").select("pair_id", "cost", "path", (F.col("part_ft") + F.coalesce("whole_ft", F.lit(0.0))).alias("feet"))


def distinct_alternates(primary: DataFrame, alternates: DataFrame, most: float = 0.8) -> DataFrame:
    """Alternates (pair_id, twist, geoms) unlike the primary (pair_id, geoms) and one another.

    Those that share more than ``most`` with the primary go; the rest are taken from the least
    like it on, each if it is unlike those taken; of three, ``flatter`` goes. At most three
    rows per pair, so the choice is unrolled.
    """
    a = alternates.join(primary.select("pair_id", F.col("geoms").alias("own")), "pair_id").withColumn("like", audit.overlap(F.col("geoms"), F.col("own"))).filter(F.col("like") <= most)
    ranked = a.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("like", "twist", "geoms"))).alias("a"))
    return _unlike(ranked, lambda k, x: audit.overlap(k["geoms"], x["geoms"]), most)


def distinct_by_counts(counts: DataFrame, twists: list[str], most: float = 0.8) -> DataFrame:
    """distinct_alternates() from what paths have in common (see overlay.shared()): run 0 is the primary, run k the k-th of ``twists``."""
    runs = range(len(twists) + 1)
    both = lambda r, s: F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << r | 1 << s)) == (1 << r | 1 << s), F.col("n")).otherwise(0))
    by_run = counts.groupBy(F.col("base").alias("pair_id")).agg(F.array(*[F.array(*[both(r, s) for s in runs]) for r in runs]).alias("both"))
    size = lambda r: F.col("both")[r][r]
    like = lambda r, s: F.col("both")[r][s] / F.least(size(r), size(s))
    alike = F.transform(F.sequence(F.lit(1), F.lit(len(twists))), lambda k: F.struct(F.when((size(F.lit(0)) > 0) & (size(k) > 0), like(F.lit(0), k)).alias("like"), F.array(*map(F.lit, twists))[k - 1].alias("twist"), k.alias("run")))
    ranked = by_run.select("pair_id", "both", F.sort_array(F.filter(alike, lambda x: x["like"] <= most)).alias("a"))
    return _unlike(ranked, lambda k, x: like(k["run"], x["run"]), most)


def _unlike(ranked: DataFrame, like: Callable[[Column, Column], Column], most: float) -> DataFrame:
    """pair_id, twist, like of those of ``a`` (in order) that are unlike those taken before."""

    def unlike(kept, x):
        return F.forall(kept, lambda k: like(k, x) <= most)

    kept = F.aggregate("a", F.slice("a", 1, 0), lambda k, x: F.when(unlike(k, x), F.concat(k, F.array(x))).otherwise(k))
    out = ranked.withColumn("k", kept).withColumn("k", F.when(F.size("k") >= 3, F.filter("k", lambda x: x["twist"] != "flatter")).otherwise(F.col("k")))
    return out.select("pair_id", F.inline("k")).select("pair_id", "twist", F.round("like", 6).alias("like"))


def travel_minutes(paths: DataFrame, mph: float = 10.0) -> DataFrame:
    """Minutes of each path from its edges in order: path_id, pos, len_ft, is_sidewalk, rise_ft, b1, and the node
    after the edge: has_signal, stop_bits, last. At least one minute."""
    inner = ~F.col("last")
    seconds = F.when(F.col("is_sidewalk"), F.col("len_ft") / 5280 / 5 * 3600).otherwise(F.col("len_ft") / 5280 / max(mph, 0.1) * 3600)
    s = paths.groupBy("path_id").agg(
        F.sum(seconds).alias("ride"), F.round(F.sum(F.greatest("rise_ft", F.lit(0.0)))).alias("up"), F.round(F.sum(F.greatest(-F.col("rise_ft"), F.lit(0.0)))).alias("down"),
        F.sum(F.when(inner & F.col("has_signal"), 10).otherwise(0)).alias("signals"), F.sum(F.when(inner & geo.stop_faces(F.col("stop_bits"), F.col("b1")), 2).otherwise(0)).alias("stops"),
    )
    total = F.col("ride") + 2 * F.col("up") - 0.5 * F.col("down") + F.col("signals") + F.col("stops")
    return s.select("path_id", F.round(total, 3).alias("seconds"), F.greatest(F.lit(1), F.round(total / 60)).cast("bigint").alias("minutes"))


def slope_layer(edges: DataFrame) -> DataFrame:
    """One row per street, its forward edge if there is one: signed slope in percent and its class."""
    w = Window.partitionBy("seg_id").orderBy("is_reverse", "edge_id")
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("seg_id", "edge_id", F.when(F.col("len_ft") > 0, F.round((F.col("to_elev") - F.col("from_elev")) / F.col("len_ft") * 100, 2)).otherwise(F.lit(0.0)).alias("slope_pct"), "is_sidewalk")


def with_reverse(projections: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``back_id``, the edge between the same nodes on the same street the other way, if there is one."""
    own = edges.select("edge_id", "seg_id", "src", "dst")
    back = edges.select(F.col("seg_id"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("edge_id").alias("back_id"))
    return projections.join(own, "edge_id").join(back, ["seg_id", "src", "dst"], "left")


def mid_edge_ends(projections: DataFrame, edges: DataFrame, starting: bool) -> DataFrame:
    """Ways into (or, not starting, out of) the graph from points on edges: point_id, node_id, cost, feet.

    ``projections``: point_id, edge_id, back_id, src, dst, from_ft, to_ft. A start runs to the
    edge's end, or back to its beginning where the street has the other direction; a goal is
    reached from the beginning, or from the end. Parts of no length and blocked edges give none.
    """
    rate = edges.select("edge_id", (F.col("cost") / F.col("len_ft")).alias("rate")).filter("rate is not null")
    ahead = (F.col("dst"), F.col("to_ft")) if starting else (F.col("src"), F.col("from_ft"))
    behind = (F.col("src"), F.col("from_ft")) if starting else (F.col("dst"), F.col("to_ft"))
    way = lambda edge, end: F.struct(edge.alias("way"), end[0].alias("node_id"), end[1].alias("feet"))
    both = projections.select("point_id", F.inline(F.array(way(F.col("edge_id"), ahead), way(F.col("back_id"), behind))))
    open_ = both.filter("way is not null and feet > 0").join(rate, F.col("way") == F.col("edge_id"))
    return open_.groupBy("point_id", "node_id").agg(F.min(F.struct((F.col("feet") * F.col("rate")).alias("cost"), "feet", "way")).alias("m")).select("point_id", "node_id", "m.cost", "m.feet", "m.way")


def directed(streets: DataFrame) -> DataFrame:
    """Both directions of every street, or one of a one-way street: edge_id, is_reverse, src, dst, b0, b1 and the street's columns.

    ``streets``: seg_id, a, b, alon, alat, blon, blat, one_way (1 along the street, -1 against
    it, 0 both ways). The way back has the street's bearings mirrored: it begins where the
    street ends, turned about.
    """
    b = F.round(geo.bearing(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat")), 1)
    back = F.round(F.pmod(b + 180, F.lit(360.0)), 1)
    end = lambda name, node, lon, lat: [F.col(node).alias(name), F.col(lon).alias(f"{name[0]}lon"), F.col(lat).alias(f"{name[0]}lat")]
    there = F.struct(F.lit(False).alias("is_reverse"), *end("src", "a", "alon", "alat"), *end("dst", "b", "blon", "blat"), b.alias("b0"), b.alias("b1"))
    again = F.struct(F.lit(True).alias("is_reverse"), *end("src", "b", "blon", "blat"), *end("dst", "a", "alon", "alat"), back.alias("b0"), back.alias("b1"))
    ways = F.array_compact(F.array(F.when(F.col("one_way") >= 0, there), F.when(F.col("one_way") <= 0, again)))
    rest = [c for c in streets.columns if c not in ("a", "b", "alon", "alat", "blon", "blat", "one_way")]
    rows = streets.select(*rest, F.inline(ways))
    return rows.select((2 * F.col("seg_id") + F.col("is_reverse").cast("int")).alias("edge_id"), "*")
