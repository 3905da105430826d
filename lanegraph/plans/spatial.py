"""Plans of the spatial joins; their SQL is brute force over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.functions import geo
from lanegraph.operators import matching
from lanegraph.plans.fixtures import ctes, relation

#: SQL of the clamped place t and distance of a point (px, py) to a segment, axes scaled.
_T = "CASE WHEN {sq} > 0 THEN least(greatest(({qx}*{bx} + {qy}*{by})/({sq}), 0e0), 1e0) ELSE 0e0 END"


def _projected(source: str, sx: str = "1e0", sy: str = "1e0") -> str:
    bx, by, qx, qy = f"((x1-x0)*{sx})", f"((y1-y0)*{sy})", f"((px-x0)*{sx})", f"((py-y0)*{sy})"
    t = _T.format(sq=f"{bx}*{bx}+{by}*{by}", qx=qx, qy=qy, bx=bx, by=by)
    return f"(SELECT *, sqrt(pow({qx}-t*{bx},2)+pow({qy}-t*{by},2)) dist FROM (SELECT *, {t} t FROM {source}))"


def street_join(spark: SparkSession, folder: str) -> DataFrame:
    edges = relation(spark, folder, "dir").filter("not is_reverse and not is_sidewalk")
    return matching.street_attributes(edges, relation(spark, folder, "facilities"), ["width", "arterial"])


STREET_JOIN = ctes("dir", "facilities") + f""",
e AS (SELECT * FROM dir WHERE NOT is_reverse AND NOT is_sidewalk),
p AS (SELECT edge_id, k, slon + k*(dlon-slon)/5 px, slat + k*(dlat-slat)/5 py FROM e, (SELECT unnest([1,2,3,4]) k)),
h AS (SELECT edge_id, k, width, arterial, row_number() OVER (PARTITION BY edge_id, k ORDER BY dist, fac_id) r
  FROM {_projected("(SELECT * FROM p, facilities WHERE abs(px-(x0+x1)/2) < 0.003 AND abs(py-(y0+y1)/2) < 0.003)")} WHERE dist <= 0.00015),
v AS (SELECT edge_id, 'w' a, CAST(width AS DOUBLE) v, count(*) n, min(k) f FROM h WHERE r = 1 GROUP BY 1, 2, 3
  UNION ALL SELECT edge_id, 'a', arterial, count(*), min(k) FROM h WHERE r = 1 GROUP BY 1, 2, 3),
b AS (SELECT edge_id, a, v FROM (SELECT *, row_number() OVER (PARTITION BY edge_id, a ORDER BY n DESC, f) r FROM v) WHERE r = 1)
SELECT e.edge_id, w.v width, CAST(x.v AS INT) arterial FROM e LEFT JOIN b w ON w.edge_id = e.edge_id AND w.a = 'w' LEFT JOIN b x ON x.edge_id = e.edge_id AND x.a = 'a'"""


def facility_join(spark: SparkSession, folder: str) -> DataFrame:
    edges = relation(spark, folder, "dir").filter("not is_reverse and not is_sidewalk")
    return matching.best_facility(edges, relation(spark, folder, "facilities"))


FACILITY_JOIN = ctes("dir", "facilities") + f""",
e AS (SELECT * FROM dir WHERE NOT is_reverse AND NOT is_sidewalk),
p AS (SELECT edge_id, k, slon + k*(dlon-slon)/4 px, slat + k*(dlat-slat)/4 py FROM e, (SELECT unnest([1,2,3]) k)),
h AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY CASE category WHEN 'BKF-BBL' THEN 1 WHEN 'BKF-BL' THEN 2 WHEN 'BKF-SHW' THEN 3 ELSE 0 END, k, fac_id) r
  FROM {_projected("(SELECT * FROM p, facilities WHERE abs(px-(x0+x1)/2) < 0.003 AND abs(py-(y0+y1)/2) < 0.003)")} WHERE dist <= 0.00012)
SELECT e.edge_id, category, fac_id FROM e LEFT JOIN h ON h.edge_id = e.edge_id AND r = 1"""


def control_snap(spark: SparkSession, folder: str) -> DataFrame:
    return matching.node_controls(relation(spark, folder, "nodes").select("node_id", "lon", "lat"), relation(spark, folder, "signs"))


CONTROL_SNAP = ctes("nodes", "signs") + """,
h AS (SELECT n.node_id, s.kind, CASE upper(trim(facing)) WHEN 'N' THEN 1 WHEN 'NE' THEN 2 WHEN 'E' THEN 4 WHEN 'SE' THEN 8 WHEN 'S' THEN 16 WHEN 'SW' THEN 32 WHEN 'W' THEN 64 WHEN 'NW' THEN 128 END bit
  FROM nodes n JOIN signs s ON (n.lon-s.lon)*(n.lon-s.lon) + (n.lat-s.lat)*(n.lat-s.lat) <= 0.0002e0*0.0002e0),
g AS (SELECT node_id, bool_or(kind='signal') a, bool_or(kind='crosswalk') b, bool_or(kind='beacon') c, bit_or(CASE WHEN kind='stop' THEN bit END) d FROM h GROUP BY node_id)
SELECT n.node_id, coalesce(a, false) has_signal, coalesce(b, false) has_crosswalk, coalesce(c, false) has_beacon, CAST(coalesce(d, 0) AS BIGINT) stop_bits FROM nodes n LEFT JOIN g USING (node_id)"""


def _circles(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "signs").filter("sign_id % 5 = 0").select(F.col("sign_id").alias("circle_id"), "lon", "lat")


def circle_collapse(spark: SparkSession, folder: str) -> DataFrame:
    nodes = relation(spark, folder, "nodes").select("node_id", "lon", "lat")
    edges, _ = matching.collapse_circles(relation(spark, folder, "seg").select("seg_id", "a", "b"), nodes, _circles(spark, folder), 1_000_000)
    return edges.select("seg_id", "a", "b")


CIRCLE_COLLAPSE = ctes("seg", "signs") + """,
m AS (SELECT node_id, 1000000 + max(sign_id) s FROM nodes n JOIN (SELECT * FROM signs WHERE sign_id % 5 = 0) c
  ON (n.lon-c.lon)*(n.lon-c.lon) + (n.lat-c.lat)*(n.lat-c.lat) <= 0.00018e0*0.00018e0 GROUP BY node_id)
SELECT * FROM (SELECT seg_id, coalesce(x.s, a) a, coalesce(y.s, b) b FROM seg LEFT JOIN m x ON x.node_id = a LEFT JOIN m y ON y.node_id = b) WHERE a <> b"""


def circle_centres(spark: SparkSession, folder: str) -> DataFrame:
    nodes = relation(spark, folder, "nodes").select("node_id", "lon", "lat")
    _, centres = matching.collapse_circles(relation(spark, folder, "seg").select("seg_id", "a", "b"), nodes, _circles(spark, folder), 1_000_000)
    return centres.select("node_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


CIRCLE_CENTRES = ctes("seg", "signs") + """
SELECT 1000000 + sign_id node_id, round(avg(n.lon), 6) lon, round(avg(n.lat), 6) lat FROM nodes n JOIN (SELECT * FROM signs WHERE sign_id % 5 = 0) c
  ON (n.lon-c.lon)*(n.lon-c.lon) + (n.lat-c.lat)*(n.lat-c.lat) <= 0.00018e0*0.00018e0 GROUP BY sign_id"""


def _walks(spark: SparkSession, folder: str) -> DataFrame:
    shift = lambda c: (F.col(c) + (F.col("seg_id") % 7) * 2e-5 - 6e-5).alias(c)
    return relation(spark, folder, "dir").filter("not is_reverse and seg_id % 4 = 0").select("edge_id", shift("slon"), "slat", "dlon", shift("dlat"))


def _roads(spark: SparkSession, folder: str) -> DataFrame:
    d = relation(spark, folder, "dir").filter("not is_reverse and seg_id % 4 <> 0")
    return d.select(F.col("edge_id").alias("road_id"), "lanes", F.col("slon").alias("x0"), F.col("slat").alias("y0"), F.col("dlon").alias("x1"), F.col("dlat").alias("y1"))


_WALKS = """,
k AS (SELECT edge_id, slon + (seg_id % 7)*2e-5 - 6e-5 slon, slat, dlon, dlat + (seg_id % 7)*2e-5 - 6e-5 dlat FROM dir WHERE NOT is_reverse AND seg_id % 4 = 0),
r AS (SELECT edge_id road_id, lanes, slon x0, slat y0, dlon x1, dlat y1 FROM dir WHERE NOT is_reverse AND seg_id % 4 <> 0)"""


def sidewalk_crossings(spark: SparkSession, folder: str) -> DataFrame:
    return matching.crossing_lanes(_walks(spark, folder), _roads(spark, folder))


SIDEWALK_CROSSINGS = ctes("dir") + _WALKS + """,
x AS (SELECT edge_id, max(lanes) l FROM k JOIN r ON
  sign((dlon-slon)*(y0-slat)-(dlat-slat)*(x0-slon)) * sign((dlon-slon)*(y1-slat)-(dlat-slat)*(x1-slon)) < 0
  AND sign((x1-x0)*(slat-y0)-(y1-y0)*(slon-x0)) * sign((x1-x0)*(dlat-y0)-(y1-y0)*(dlon-x0)) < 0 GROUP BY edge_id)
SELECT k.edge_id, round(l, 2) crosswalk_lanes FROM k LEFT JOIN x USING (edge_id)"""


def sidewalk_sides(spark: SparkSession, folder: str) -> DataFrame:
    found = matching.sidewalk_offsets(_walks(spark, folder), _roads(spark, folder))
    return found.select("edge_id", "road_id", F.round("offset_bearing").alias("offset_bearing"))


SIDEWALK_SIDES = ctes("dir") + _WALKS + f""",
m AS (SELECT edge_id, (slon+dlon)/2 px, (slat+dlat)/2 py FROM k),
h AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY dist, road_id) n FROM {_projected("(SELECT * FROM m, r WHERE abs(px-(x0+x1)/2) < 0.003 AND abs(py-(y0+y1)/2) < 0.003)")} WHERE dist <= 40/364000),
g AS (SELECT edge_id, road_id, x0+t*(x1-x0) qx, y0+t*(y1-y0) qy, px, py FROM h WHERE n = 1),
w AS (SELECT edge_id, road_id, degrees(atan2(sin(radians(px)-radians(qx))*cos(radians(py)), cos(radians(qy))*sin(radians(py))-sin(radians(qy))*cos(radians(py))*cos(radians(px)-radians(qx))))+360 d FROM g)
SELECT k.edge_id, road_id, round(round(d - 360*floor(d/360), 1)) offset_bearing FROM k LEFT JOIN w USING (edge_id)"""


def poi_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return matching.nearest_address(relation(spark, folder, "pois"), relation(spark, folder, "addresses")).select("poi_id", "addr_id", "address")


POI_ADDRESSES = ctes("pois", "addresses") + """,
h AS (SELECT poi_id, addr_id, label, row_number() OVER (PARTITION BY poi_id ORDER BY (p.lon-a.lon)*(p.lon-a.lon)+(p.lat-a.lat)*(p.lat-a.lat), addr_id) r
  FROM pois p JOIN addresses a ON abs(p.lon-a.lon) <= 0.0012 AND abs(p.lat-a.lat) <= 0.0012)
SELECT p.poi_id, addr_id, label address FROM pois p LEFT JOIN h ON h.poi_id = p.poi_id AND r = 1"""


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return relation(spark, folder, "pois").select(F.col("poi_id").alias("point_id"), F.col("lon").alias("px"), F.col("lat").alias("py"))


def edge_snap(spark: SparkSession, folder: str) -> DataFrame:
    s = matching.snap(_points(spark, folder), relation(spark, folder, "dir"), relation(spark, folder, "nodes"), node_radius=0.002)
    return s.select("point_id", "kind", "edge_id", F.round("t", 4).alias("t"), F.round("from_ft", 2).alias("from_ft"), F.round("to_ft", 2).alias("to_ft"), "node_id")


EDGE_SNAP = ctes("dir", "pois") + f""",
q AS (SELECT poi_id point_id, lon px, lat py FROM pois),
s AS (SELECT edge_id, len_ft, slon x0, slat y0, dlon x1, dlat y1 FROM dir WHERE NOT is_sidewalk),
h AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, edge_id) r FROM {_projected("(SELECT * FROM q, s WHERE abs(px-(x0+x1)/2) < 0.003 AND abs(py-(y0+y1)/2) < 0.003)", "245000e0", "364000e0")} WHERE dist <= 200),
n AS (SELECT point_id, node_id, row_number() OVER (PARTITION BY point_id ORDER BY (px-lon)*(px-lon)+(py-lat)*(py-lat), node_id) r
  FROM q JOIN nodes ON (px-lon)*(px-lon)+(py-lat)*(py-lat) <= 0.002e0*0.002e0)
SELECT q.point_id, CASE WHEN edge_id IS NOT NULL THEN 'edge' WHEN node_id IS NOT NULL THEN 'node' END kind, edge_id, round(t, 4) t, round(t*len_ft, 2) from_ft, round((1-t)*len_ft, 2) to_ft,
  CASE WHEN edge_id IS NULL THEN node_id END node_id
FROM q LEFT JOIN h ON h.point_id = q.point_id AND h.r = 1 LEFT JOIN n ON n.point_id = q.point_id AND n.r = 1"""


def racks(spark: SparkSession, folder: str) -> DataFrame:
    places = relation(spark, folder, "pois").select(F.col("poi_id").alias("place_id"), F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    return matching.rack_tier(places, relation(spark, folder, "signs").select(F.col("sign_id").alias("rack_id"), "lon", "lat"))


RACKS = ctes("pois", "signs") + """,
d AS (SELECT poi_id, sign_id, p.lon ax, p.lat ay, s.lon bx, s.lat by_, 2*6371000e0*asin(sqrt(pow(sin((radians(s.lat)-radians(p.lat))/2),2)+cos(radians(p.lat))*cos(radians(s.lat))*pow(sin((radians(s.lon)-radians(p.lon))/2),2)))*3.28084e0 ft
  FROM pois p JOIN signs s ON abs(p.lon-s.lon) <= 1000/247000e0 AND abs(p.lat-s.lat) <= 1000/364000e0),
m AS (SELECT *, count(CASE WHEN ft <= 300 THEN 1 END) OVER (PARTITION BY poi_id) n, row_number() OVER (PARTITION BY poi_id ORDER BY ft, sign_id) r FROM d),
z AS (SELECT *, round(degrees(atan2(sin(radians(bx)-radians(ax))*cos(radians(by_)), cos(radians(ay))*sin(radians(by_))-sin(radians(ay))*cos(radians(by_))*cos(radians(bx)-radians(ax)))), 6) + 360 b FROM m WHERE r = 1)
SELECT p.poi_id place_id, CASE WHEN n > 0 THEN 'green' WHEN ft <= 1000 THEN 'yellow' ELSE 'red' END tier, CASE WHEN n > 0 THEN n END n_racks,
  CASE WHEN n = 0 AND ft <= 1000 THEN CAST(round(ft) AS BIGINT) END distance_ft,
  CASE WHEN n = 0 AND ft <= 1000 THEN (['north','northeast','east','southeast','south','southwest','west','northwest'])[1 + CAST(floor((b+22.5)/45) AS INT) % 8] END direction
FROM pois p LEFT JOIN z USING (poi_id)"""


def crossings(spark: SparkSession, folder: str) -> DataFrame:
    return matching.untagged_crossings(relation(spark, folder, "diagonals"), 1000.0)


_MEET = """sign((p.bx-p.ax)*(q.ay-p.ay)-(p.by_-p.ay)*(q.ax-p.ax)) * sign((p.bx-p.ax)*(q.by_-p.ay)-(p.by_-p.ay)*(q.bx-p.ax)) <= 0
  AND sign((q.bx-q.ax)*(p.ay-q.ay)-(q.by_-q.ay)*(p.ax-q.ax)) * sign((q.bx-q.ax)*(p.by_-q.ay)-(q.by_-q.ay)*(p.bx-q.ax)) <= 0"""
CROSSINGS = ctes("diagonals") + f"""
SELECT p.seg_id i, q.seg_id j, p.tagged it, q.tagged jt FROM diagonals p JOIN diagonals q ON p.seg_id < q.seg_id
  AND p.a NOT IN (q.a, q.b) AND p.b NOT IN (q.a, q.b) AND NOT (p.tagged AND q.tagged) AND abs(p.ax-q.ax) < 4000 AND abs(p.ay-q.ay) < 4000 AND {_MEET}"""


def crossing_flags(spark: SparkSession, folder: str) -> DataFrame:
    return matching.flagged_segments(crossings(spark, folder))


CROSSING_FLAGS = ctes("diagonals") + f""",
x AS (SELECT p.seg_id i, q.seg_id j, p.tagged it, q.tagged jt FROM diagonals p JOIN diagonals q ON p.seg_id < q.seg_id
  AND p.a NOT IN (q.a, q.b) AND p.b NOT IN (q.a, q.b) AND NOT (p.tagged AND q.tagged) AND abs(p.ax-q.ax) < 4000 AND abs(p.ay-q.ay) < 4000 AND {_MEET})
SELECT i seg_id FROM x WHERE NOT it UNION SELECT j FROM x WHERE NOT jt"""

#: A polygon with a hole for the containment plan.
AREA = [[(-122.441, 47.5), (-122.41, 47.499), (-122.405, 47.52), (-122.42, 47.54), (-122.443, 47.53)], [(-122.43, 47.51), (-122.42, 47.51), (-122.425, 47.52)]]


def inside_area(spark: SparkSession, folder: str) -> DataFrame:
    rings = F.array(*[F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ring]) for ring in AREA])
    return relation(spark, folder, "nodes").select("node_id", geo.in_rings(F.col("lon"), F.col("lat"), rings).alias("inside"))


_SIDES = " UNION ALL ".join(f"SELECT {x0} x0, {y0} y0, {x1} x1, {y1} y1" for ring in AREA for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True))
INSIDE_AREA = ctes("nodes") + f""",
s AS (SELECT x0::DOUBLE x0, y0::DOUBLE y0, x1::DOUBLE x1, y1::DOUBLE y1 FROM ({_SIDES}))
SELECT node_id, count(CASE WHEN (y0 > lat) <> (y1 > lat) AND lon < x0 + (lat-y0)*(x1-x0)/(y1-y0) THEN 1 END) % 2 = 1 inside FROM nodes, s GROUP BY node_id"""

PLANS = {
    "street_join": (street_join, STREET_JOIN),
    "facility_join": (facility_join, FACILITY_JOIN),
    "control_snap": (control_snap, CONTROL_SNAP),
    "circle_collapse": (circle_collapse, CIRCLE_COLLAPSE),
    "circle_centres": (circle_centres, CIRCLE_CENTRES),
    "sidewalk_crossings": (sidewalk_crossings, SIDEWALK_CROSSINGS),
    "sidewalk_sides": (sidewalk_sides, SIDEWALK_SIDES),
    "poi_addresses": (poi_addresses, POI_ADDRESSES),
    "edge_snap": (edge_snap, EDGE_SNAP),
    "racks": (racks, RACKS),
    "crossings": (crossings, CROSSINGS),
    "crossing_flags": (crossing_flags, CROSSING_FLAGS),
    "inside_area": (inside_area, INSIDE_AREA),
}
