"""Further plans: features from tags, clipping, ends inside edges, audits of approaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.functions import geo, tags
from lanegraph.operators import audit, matching, ordered, routing
from lanegraph.plans.fixtures import ctes, relation
from lanegraph.plans.graphs import _REACH, LIMIT, _edges, _reach
from lanegraph.plans.routes import _SERIES, _series
from lanegraph.plans.spatial import _SIDES, AREA
from lanegraph.plans.travel import COMFORT, _COST
from lanegraph.sources import layers, manifest


def tagged_features(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses and named points of interest among tagged elements."""
    p = relation(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "way").otherwise("node").alias("kind"), F.struct((F.col("p_partkey") % 7).cast("double").alias("lon"), F.lit(1.0).alias("lat")).alias("own"),
        F.when(F.col("p_partkey") % 6 != 0, F.struct(F.lit(9.0).alias("lon"), F.lit(2.0).alias("lat"))).alias("middle"),
        F.create_map(
            F.lit("name"), F.col("p_name"), F.lit("shop"), F.when(F.col("p_partkey") % 4 == 0, "books").when(F.col("p_partkey") % 4 == 1, "no"), F.lit("amenity"), F.when(F.col("p_partkey") % 5 == 0, "cafe"),
            F.lit("addr:housenumber"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))), F.lit("addr:street"), F.when(F.col("p_partkey") % 7 != 0, "Oak St "),
        ).alias("tags"),
    )
    at = tags.center(F.col("kind"), F.col("own"), F.col("middle"))
    out = p.select("id", tags.address_label(F.col("tags")).alias("address"), tags.poi_category(F.col("tags")).alias("category"), at["lon"].alias("lon"), layers.page_size((F.col("id") % 3000).cast("int")).alias("page"))
    return out.filter("address is not null or category is not null")


TAGGED_FEATURES = """
WITH p AS (SELECT p_partkey id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 7 <> 0 THEN p_size || ' Oak St' END address,
  CASE WHEN p_partkey % 5 = 0 THEN 'amenity=cafe' WHEN p_partkey % 4 = 0 THEN 'shop=books' END category,
  CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 7 AS DOUBLE) WHEN p_partkey % 6 <> 0 THEN 9e0 END lon, CAST(least(p_partkey % 3000, 2000) AS INT) page FROM part)
SELECT * FROM p WHERE address IS NOT NULL OR category IS NOT NULL"""


def clipped_streets(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of streets inside an area."""
    rings = F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ring]) for ring in AREA])
    parts = geo.inside_parts(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat"), rings)
    rows = relation(spark, folder, "seg").select("seg_id", F.inline(parts))
    return rows.select("seg_id", F.round("t0", 4).alias("t0"), F.round("t1", 4).alias("t1"))


CLIPPED_STREETS = ctes("seg") + f""",
g AS (SELECT x0::DOUBLE x0, y0::DOUBLE y0, x1::DOUBLE x1, y1::DOUBLE y1 FROM ({_SIDES})),
d AS (SELECT seg_id, ((x0-alon)*(y1-y0)-(y0-alat)*(x1-x0))/den t, ((x0-alon)*(blat-alat)-(y0-alat)*(blon-alon))/den u FROM (SELECT *, (blon-alon)*(y1-y0)-(blat-alat)*(x1-x0) den FROM seg, g) WHERE den <> 0),
c AS (SELECT seg_id, t FROM d WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1 UNION ALL SELECT seg_id, 0e0 FROM seg UNION ALL SELECT seg_id, 1e0 FROM seg),
s AS (SELECT seg_id, t t0, lead(t) OVER (PARTITION BY seg_id ORDER BY t) t1 FROM c),
m AS (SELECT s.seg_id, t0, t1, alon+(t0+t1)/2*(blon-alon) px, alat+(t0+t1)/2*(blat-alat) py FROM s JOIN seg USING (seg_id) WHERE t1 > t0),
i AS (SELECT seg_id, t0, t1 FROM m, g GROUP BY ALL HAVING count(CASE WHEN (y0 > py) <> (y1 > py) AND px < x0 + (py-y0)*(x1-x0)/(y1-y0) THEN 1 END) % 2 = 1)
SELECT seg_id, round(t0, 4) t0, round(t1, 4) t1 FROM i"""


def clipped_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of whole routes inside an area with a hole."""
    rings = F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ring]) for ring in AREA])
    lines = relation(spark, folder, "route_points").groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))
    parts = geo.clip_lines(lines, rings, "route_id")
    ends = {"x0": F.get("points", F.lit(0))["lon"], "y0": F.get("points", F.lit(0))["lat"], "x1": F.element_at("points", -1)["lon"], "y1": F.element_at("points", -1)["lat"]}
    return parts.select("route_id", F.col("part").cast("bigint").alias("part"), F.size("points").alias("n_points"), *[F.round(c, 6).alias(n) for n, c in ends.items()])


CLIPPED_ROUTES = ctes("route_points") + f""",
g AS (SELECT x0::DOUBLE x0, y0::DOUBLE y0, x1::DOUBLE x1, y1::DOUBLE y1 FROM ({_SIDES})),
le AS (SELECT route_id, row_number() OVER w leg, lon alon, lat alat, lead(lon) OVER w blon, lead(lat) OVER w blat FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq) QUALIFY blon IS NOT NULL),
d AS (SELECT route_id, leg, ((x0-alon)*(y1-y0)-(y0-alat)*(x1-x0))/den t, ((x0-alon)*(blat-alat)-(y0-alat)*(blon-alon))/den u FROM (SELECT *, (blon-alon)*(y1-y0)-(blat-alat)*(x1-x0) den FROM le, g) WHERE den <> 0),
c AS (SELECT route_id, leg, t FROM d WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1 UNION ALL SELECT route_id, leg, 0e0 FROM le UNION ALL SELECT route_id, leg, 1e0 FROM le),
s AS (SELECT route_id, leg, t t0, lead(t) OVER (PARTITION BY route_id, leg ORDER BY t) t1 FROM c),
m AS (SELECT s.*, alon, alat, blon, blat, alon+(t0+t1)/2*(blon-alon) px, alat+(t0+t1)/2*(blat-alat) py FROM s JOIN le USING (route_id, leg) WHERE t1 > t0),
i AS (SELECT route_id, leg, t0, t1, alon, alat, blon, blat FROM m, g GROUP BY ALL HAVING count(CASE WHEN (m.py < g.y0) <> (m.py < g.y1) AND px < x0 + (py-y0)*(x1-x0)/(y1-y0) THEN 1 END) % 2 = 1),
n AS (SELECT *, CASE WHEN (lag(leg) OVER w = leg AND lag(t1) OVER w = t0) OR (lag(leg) OVER w = leg-1 AND lag(t1) OVER w = 1 AND t0 = 0) THEN 0 ELSE 1 END fresh FROM i WINDOW w AS (PARTITION BY route_id ORDER BY leg, t0)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY route_id ORDER BY leg, t0 ROWS UNBOUNDED PRECEDING) - 1 part FROM n)
SELECT route_id, CAST(part AS BIGINT) part, CAST(count(*) + 1 AS INT) n_points, round(arg_min(alon + t0*(blon-alon), (leg, t0)), 6) x0, round(arg_min(alat + t0*(blat-alat), (leg, t0)), 6) y0,
  round(arg_max(alon + t1*(blon-alon), (leg, t0)), 6) x1, round(arg_max(alat + t1*(blat-alat), (leg, t0)), 6) y1 FROM r GROUP BY route_id, part"""


def _projections(spark: SparkSession, folder: str) -> DataFrame:
    d = relation(spark, folder, "dir")
    p = d.select(F.col("edge_id").alias("point_id"), "edge_id", (F.col("len_ft") * (F.col("edge_id") % 11) / 10).alias("from_ft"), (F.col("len_ft") * (10 - F.col("edge_id") % 11) / 10).alias("to_ft"))
    return routing.with_reverse(p, relation(spark, folder, "dir"))


def route_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Ways into and out of the graph from points inside edges."""
    p, e = _projections(spark, folder), routing.edge_costs(relation(spark, folder, "dir"), COMFORT)
    both = [routing.mid_edge_ends(p, e, s).withColumn("kind", F.lit(k)) for s, k in ((True, "start"), (False, "goal"))]
    return both[0].unionByName(both[1]).select("point_id", "kind", "node_id", F.round("cost", 2).alias("cost"), F.round("feet", 2).alias("feet"))


ROUTE_ENDS = ctes("dir") + f""",
e AS (SELECT *, {_COST} cost FROM dir),
p AS (SELECT a.edge_id point_id, a.src, a.dst, a.cost/a.len_ft ra, b.cost/b.len_ft rb, b.edge_id back, a.len_ft*(a.edge_id % 11)/10 f, a.len_ft*(10 - a.edge_id % 11)/10 t
  FROM e a LEFT JOIN e b ON b.seg_id = a.seg_id AND b.src = a.dst AND b.dst = a.src),
u AS (SELECT point_id, 'start' kind, dst node_id, t*ra cost, t feet FROM p UNION ALL SELECT point_id, 'start', src, f*rb, f FROM p UNION ALL
  SELECT point_id, 'goal', src, f*ra, f FROM p UNION ALL SELECT point_id, 'goal', dst, t*rb, t FROM p)
SELECT point_id, kind, node_id, round(cost, 2) cost, round(feet, 2) feet FROM u WHERE feet > 0 AND cost IS NOT NULL"""


def flat_ended_profiles(spark: SparkSession, folder: str) -> DataFrame:
    s = _series(spark, folder)
    ends = s.select("route_id").distinct().select("route_id", (F.col("route_id") % 3 * 50.0).alias("prefix_ft"), (F.col("route_id") % 2 * 25.0).alias("suffix_ft"))
    return ordered.with_flat_ends(s, ends).select("route_id", "seq", F.round("along", 3).alias("along"), "elev_ft")


FLAT_ENDED_PROFILES = _SERIES + """,
m AS (SELECT route_id, seq, along + (route_id % 3)*50 along, elev_ft, row_number() OVER (PARTITION BY route_id ORDER BY seq) a, row_number() OVER (PARTITION BY route_id ORDER BY seq DESC) z FROM sr)
SELECT route_id, seq, round(along, 3) along, elev_ft FROM m UNION ALL SELECT route_id, seq-1, 0e0, elev_ft FROM m WHERE a = 1 AND route_id % 3 > 0
UNION ALL SELECT route_id, seq+1, round(along+25, 3), elev_ft FROM m WHERE z = 1 AND route_id % 2 > 0"""


def approach_overshoot(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder)
    return audit.overshoot(e.filter("source is null").select("edge_id", "src", "dst", "len_ft"), _reach(e), LIMIT).select("category", "n", F.round("feet", 2).alias("feet"), F.round("beyond_ft", 2).alias("beyond_ft"))


APPROACH_OVERSHOOT = _REACH + """
SELECT coalesce(x.cat, y.cat) category, count(*) n, round(sum(l), 2) feet, round(sum(l - least(l, greatest(700 - coalesce(x.d, y.d), 0))), 2) beyond_ft
FROM ed LEFT JOIN rc x ON x.node = src LEFT JOIN rc y ON y.node = dst WHERE source IS NULL AND (x.node IS NULL) <> (y.node IS NULL) GROUP BY 1"""


def crossing_order(spark: SparkSession, folder: str) -> DataFrame:
    pairs = matching.untagged_crossings(relation(spark, folder, "diagonals"), 1000.0)
    rank = lambda c: F.when(F.col(c) % 5 < 3, F.col(c) % 3)
    return audit.orderable(pairs.select(rank("i").alias("ra"), rank("j").alias("rb")))


CROSSING_ORDER = ctes("diagonals") + """,
x AS (SELECT p.seg_id i, q.seg_id j FROM diagonals p JOIN diagonals q ON p.seg_id < q.seg_id AND p.a NOT IN (q.a, q.b) AND p.b NOT IN (q.a, q.b) AND NOT (p.tagged AND q.tagged) AND abs(p.ax-q.ax) < 4000 AND abs(p.ay-q.ay) < 4000
  AND sign((p.bx-p.ax)*(q.ay-p.ay)-(p.by_-p.ay)*(q.ax-p.ax)) * sign((p.bx-p.ax)*(q.by_-p.ay)-(p.by_-p.ay)*(q.bx-p.ax)) <= 0
  AND sign((q.bx-q.ax)*(p.ay-q.ay)-(q.by_-q.ay)*(p.ax-q.ax)) * sign((q.bx-q.ax)*(p.by_-q.ay)-(q.by_-q.ay)*(p.bx-q.ax)) <= 0),
r AS (SELECT CASE WHEN i % 5 < 3 THEN i % 3 END ra, CASE WHEN j % 5 < 3 THEN j % 3 END rb FROM x),
k AS (SELECT CASE WHEN ra IS NULL AND rb IS NULL THEN 'unknown' WHEN ra <> rb THEN 'both' ELSE 'one' END kind FROM r)
SELECT kind, count(*) n, count(CASE WHEN kind <> 'unknown' THEN 1 END) n_orderable FROM k GROUP BY kind"""


def bundle_hash(spark: SparkSession, folder: str) -> DataFrame:
    """One hash of all documents, as files named by their ids."""
    d = relation(spark, folder, "documents")
    return manifest.folder_hash(d.select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))


BUNDLE_HASH = """
WITH p AS (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 3) part, sha256(string_agg(doc_id || chr(0) || sha256(coalesce(text, '')), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) h FROM documents GROUP BY 1)
SELECT substr(sha256(string_agg(part || chr(0) || h, chr(10) ORDER BY part)), 1, 16) hash FROM p"""

PLANS = {
    "tagged_features": (tagged_features, TAGGED_FEATURES), "clipped_streets": (clipped_streets, CLIPPED_STREETS), "clipped_routes": (clipped_routes, CLIPPED_ROUTES), "route_ends": (route_ends, ROUTE_ENDS), "flat_ended_profiles": (flat_ended_profiles, FLAT_ENDED_PROFILES),
    "approach_overshoot": (approach_overshoot, APPROACH_OVERSHOOT), "crossing_order": (crossing_order, CROSSING_ORDER), "bundle_hash": (bundle_hash, BUNDLE_HASH),
}
