"""Plans over routes: the rows of the lattice as polylines, their edges as paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.functions import geo
from lanegraph.operators import ordered
from lanegraph.plans.fixtures import ctes, relation


def _series(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.running_distance(relation(spark, folder, "route_points"))


_SERIES = ctes("route_points") + """,
st AS (SELECT *, coalesce(sqrt(pow((lon - lag(lon) OVER w)*245000e0, 2) + pow((lat - lag(lat) OVER w)*364000e0, 2)), 0) step FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
sr AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) along FROM st)"""


def route_grades(spark: SparkSession, folder: str) -> DataFrame:
    g = ordered.grades(_series(spark, folder))
    return g.select("route_id", "seq", F.round("along", 3).alias("along"), "rise", F.round("grade", 6).alias("grade"))


ROUTE_GRADES = _SERIES + """
SELECT route_id, seq, round(along, 3) along, lead(elev_ft) OVER w - elev_ft rise,
  round(CASE WHEN lead(along) OVER w > along THEN (lead(elev_ft) OVER w - elev_ft) / (lead(along) OVER w - along) END, 6) grade
FROM sr WINDOW w AS (PARTITION BY route_id ORDER BY seq)"""


def route_climb(spark: SparkSession, folder: str) -> DataFrame:
    c = ordered.climb_stats(_series(spark, folder), 900.0)
    return c.withColumn("steepest", F.round("steepest", 6))


ROUTE_CLIMB = _SERIES + """,
x AS (SELECT a.route_id, a.seq, a.along, a.elev_ft, a.elev_ft - p.elev_ft rise,
  (SELECT min(b.seq) FROM sr b WHERE b.route_id = a.route_id AND b.seq < a.seq AND (a.along - b.along <= 900 OR b.seq = p.seq)) j
  FROM sr a LEFT JOIN (SELECT route_id, seq, lead(seq) OVER (PARTITION BY route_id ORDER BY seq) nxt, elev_ft FROM sr) p ON p.route_id = a.route_id AND p.nxt = a.seq),
y AS (SELECT x.*, x.along - b.along dx, x.elev_ft - b.elev_ft dh FROM x LEFT JOIN sr b ON b.route_id = x.route_id AND b.seq = x.j)
SELECT route_id, CAST(round(sum(greatest(rise, 0))) AS BIGINT) up_ft, CAST(round(sum(greatest(-rise, 0))) AS BIGINT) down_ft,
  CAST(round(min(elev_ft)) AS BIGINT) min_ft, CAST(round(max(elev_ft)) AS BIGINT) max_ft, round(coalesce(max(CASE WHEN dx >= 450 AND dh > 0 THEN dh/dx END), 0), 6) steepest
FROM y GROUP BY route_id"""


def route_positions(spark: SparkSession, folder: str) -> DataFrame:
    s = _series(spark, folder)
    targets = s.select("route_id").distinct().select("route_id", F.explode(F.array(*[F.lit(float(x)) for x in (-50, 0, 777, 4321, 99999)])).alias("target"))
    at = ordered.at_distance(s, targets).select("route_id", "target", F.round("elev_ft", 4).alias("elev_ft"), F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))
    return at.join(ordered.slope_at(s, targets, 500.0).select("route_id", "target", F.round("slope", 6).alias("slope")), ["route_id", "target"])


ROUTE_POSITIONS = _SERIES + """,
t AS (SELECT route_id, CAST(v AS DOUBLE) target, total, greatest(0, v - 250) lo, least(total, v + 250) hi FROM (SELECT route_id, max(along) total FROM sr GROUP BY 1), (SELECT unnest([-50e0, 0e0, 777e0, 4321e0, 99999e0]) v)),
lg AS (SELECT route_id, seq, along d0, lead(along) OVER w d1, elev_ft e0, lead(elev_ft) OVER w e1, lon x0, lead(lon) OVER w x1, lat y0, lead(lat) OVER w y1 FROM sr WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
q AS (SELECT route_id, target, 'm' k, least(greatest(target, 0), total) d FROM t UNION ALL SELECT route_id, target, 'a', least(greatest(lo, 0), total) FROM t UNION ALL SELECT route_id, target, 'b', least(greatest(hi, 0), total) FROM t),
r AS (SELECT q.*, e0 + (d-d0)/(d1-d0)*(e1-e0) e, x0 + (d-d0)/(d1-d0)*(x1-x0) x, y0 + (d-d0)/(d1-d0)*(y1-y0) y, row_number() OVER (PARTITION BY q.route_id, target, k ORDER BY seq DESC) n
  FROM q JOIN lg ON lg.route_id = q.route_id AND d0 <= d AND d1 IS NOT NULL)
SELECT t.route_id, t.target, round(m.e, 4) elev_ft, round(m.x, 7) lon, round(m.y, 7) lat, round(CASE WHEN hi > lo THEN (b.e - a.e)/(hi-lo) ELSE 0 END, 6) slope
FROM t JOIN r m ON m.route_id = t.route_id AND m.target = t.target AND m.k = 'm' AND m.n = 1 JOIN r a ON a.route_id = t.route_id AND a.target = t.target AND a.k = 'a' AND a.n = 1
  JOIN r b ON b.route_id = t.route_id AND b.target = t.target AND b.k = 'b' AND b.n = 1"""


def _snapped(spark: SparkSession, folder: str) -> DataFrame:
    s = _series(spark, folder)
    points = relation(spark, folder, "signs").select(F.col("sign_id").alias("point_id"), F.col("lon").alias("px"), F.col("lat").alias("py"), F.floor((F.col("sign_id") * 7) / 40).alias("route_id"))
    return ordered.distance_of(s, points)


def route_signs(spark: SparkSession, folder: str) -> DataFrame:
    return _snapped(spark, folder).select("point_id", "route_id", F.round("off_ft", 3).alias("off_ft"), F.round("at_ft", 3).alias("at_ft"))


_SNAPPED = _SERIES + """,
lg AS (SELECT route_id, seq, lag(lon) OVER w x0, lag(lat) OVER w y0, lon x1, lat y1, lag(along) OVER w d0, along d1 FROM sr WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
sg AS (SELECT s_suppkey sign_id, n.lon + cast((s_suppkey*37) % 400 - 200 as double)/1e6 px, n.lat + cast((s_suppkey*53) % 400 - 200 as double)/1e6 py, CAST(floor(s_suppkey*7/40) AS BIGINT) route_id
  FROM supplier JOIN nodes n ON n.node_id = s_suppkey*7),
u AS (SELECT sign_id, sg.route_id, seq, d0, d1, (x1-x0)*245000e0 bx, (y1-y0)*364000e0 by_, (px-x0)*245000e0 qx, (py-y0)*364000e0 qy FROM sg JOIN lg USING (route_id) WHERE x0 IS NOT NULL),
v AS (SELECT *, least(greatest((qx*bx+qy*by_)/(bx*bx+by_*by_), 0), 1) t FROM u),
z AS (SELECT *, sqrt(pow(qx-t*bx,2)+pow(qy-t*by_,2)) off, d0+(d1-d0)*t at_ft FROM v),
sn AS (SELECT sign_id point_id, route_id, off off_ft, at_ft FROM (SELECT *, row_number() OVER (PARTITION BY sign_id, route_id ORDER BY off, seq) n FROM z) WHERE n = 1)"""
ROUTE_SIGNS = _SNAPPED + " SELECT point_id, route_id, round(off_ft, 3) off_ft, round(at_ft, 3) at_ft FROM sn WHERE off_ft <= 50"


def route_coverage(spark: SparkSession, folder: str) -> DataFrame:
    c = ordered.sign_coverage(_series(spark, folder), _snapped(spark, folder), 700.0)
    return c.select("route_id", "n_signs", F.round("uncovered", 6).alias("uncovered"), F.round("multiplier", 6).alias("multiplier"))


ROUTE_COVERAGE = _SNAPPED + """,
tt AS (SELECT route_id, max(along) total FROM sr GROUP BY 1),
iv AS (SELECT route_id, greatest(0, at_ft-700) lo, least(total, at_ft+700) hi FROM sn JOIN tt USING (route_id) WHERE off_ft <= 50),
nw AS (SELECT route_id, greatest(hi - greatest(lo, coalesce(max(hi) OVER (PARTITION BY route_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)), 0) f FROM iv),
cv AS (SELECT route_id, count(*) n, sum(f) c FROM nw GROUP BY 1),
o AS (SELECT tt.route_id, coalesce(n, 0) n_signs, CASE WHEN total < 1 THEN 0 ELSE greatest(0, least(1, 1 - coalesce(c, 0)/total)) END u FROM tt LEFT JOIN cv USING (route_id))
SELECT route_id, CAST(n_signs AS BIGINT) n_signs, round(u, 6) uncovered, round(u*0.5e0, 6) multiplier FROM o"""


def split_streets(spark: SparkSession, folder: str) -> DataFrame:
    ways = relation(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("n")))), lambda x: x["n"]).alias("nodes"))
    parts = ordered.split_ways(ways).withColumnRenamed("nodes", "path")
    return parts.select("way_id", "part", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("nodes"), F.array_join(F.transform(ordered.without_repeats(F.transform("path", lambda x: F.floor(x / 100))), lambda x: x.cast("string")), ",").alias("cells"))


SPLIT_STREETS = """
WITH p AS (SELECT l_orderkey way_id, l_partkey node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 pos, count(*) OVER (PARTITION BY l_orderkey) n FROM lineitem),
o AS (SELECT node, sum(1 + (pos = 0 OR pos = n-1)::INT) times FROM p GROUP BY node),
c AS (SELECT p.*, pos > 0 AND (times >= 2 OR pos = n-1) cut FROM p JOIN o USING (node)),
k AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) part FROM c),
a AS (SELECT way_id, part, pos, node FROM k UNION ALL SELECT way_id, part + 1, pos, node FROM k WHERE cut AND pos < n-1),
b AS (SELECT *, floor(node/100) cell, lag(floor(node/100)) OVER (PARTITION BY way_id, part ORDER BY pos) prev FROM a)
SELECT way_id, CAST(part AS BIGINT) part, string_agg(node::VARCHAR, ',' ORDER BY pos) nodes, string_agg(CASE WHEN prev IS DISTINCT FROM cell THEN CAST(cell AS BIGINT)::VARCHAR END, ',' ORDER BY pos) cells
FROM b GROUP BY way_id, part HAVING count(*) > 1"""


def dense_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.dense_ids(relation(spark, folder, "islands").select(F.col("a").alias("node_id")).union(relation(spark, folder, "islands").select("b")), "node_id")


DENSE_NUMBERS = ctes("islands") + " SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 dense_id FROM (SELECT a node_id FROM islands UNION SELECT b FROM islands)"


def _path(spark: SparkSession, folder: str) -> DataFrame:
    d = relation(spark, folder, "dir").filter("not is_reverse and dst = src + 1")
    bearing = F.round(geo.bearing(F.col("slon"), F.col("slat"), F.col("dlon"), F.col("dlat")), 1)
    return d.select(
        F.floor(F.col("src") / 40).alias("route_id"), (F.col("src") % 40).alias("pos"), F.col("street").alias("name"), (F.col("len_ft") / 4).alias("len_ft"), bearing.alias("b0"), F.pmod(bearing + (F.col("src") % 5) * 25, F.lit(360.0)).alias("b1"),
        "model", "is_oneway", "is_sidewalk", F.when(F.col("is_sidewalk"), F.pmod(bearing + 90 + (F.col("src") % 3) * 180, F.lit(360.0))).alias("sidewalk_bearing"), (F.col("src") % 19 == 0).alias("circle"),
    )


_PATH = ctes("dir") + """,
bb AS (SELECT *, degrees(atan2(sin(radians(dlon)-radians(slon))*cos(radians(dlat)), cos(radians(slat))*sin(radians(dlat))-sin(radians(slat))*cos(radians(dlat))*cos(radians(dlon)-radians(slon)))) + 360 d FROM dir WHERE NOT is_reverse AND dst = src + 1),
bc AS (SELECT *, round(d - 360*floor(d/360), 1) brg FROM bb),
pt AS (SELECT CAST(floor(src/40) AS BIGINT) route_id, src % 40 pos, street AS name, len_ft/4 len_ft, brg b0, brg + (src % 5)*25 - 360*floor((brg + (src % 5)*25)/360) b1, model, is_oneway, is_sidewalk,
  CASE WHEN is_sidewalk THEN brg + 90 + (src % 3)*180 - 360*floor((brg + 90 + (src % 3)*180)/360) END swb, src % 19 = 0 circle FROM bc)"""


def directions(spark: SparkSession, folder: str) -> DataFrame:
    s = ordered.steps(_path(spark, folder))
    return s.select("route_id", "step", "instruction", "name", F.round("feet", 3).alias("feet"), F.array_join("notes", "; ").alias("notes"))


def _abbreviated(x: str) -> str:
    for full, short in (("Northeast", "NE"), ("North", "N"), ("Boulevard", "Blvd"), ("Avenue", "Ave"), ("Street", "St"), ("Lane", "Ln")):
        x = f"regexp_replace({x}, '\\b{full}\\b', '{short}', 'gi')"
    return x


_STREET = _abbreviated("nm")
DIRECTIONS = _PATH + f""",
g AS (SELECT *, name IS NULL gap, sum(CASE WHEN name IS NOT NULL OR NOT coalesce(lag_gap, false) THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY pos ROWS UNBOUNDED PRECEDING) run
  FROM (SELECT *, lag(name IS NULL) OVER (PARTITION BY route_id ORDER BY pos) lag_gap FROM pt)),
h AS (SELECT *, sum(len_ft) OVER (PARTITION BY route_id, run) rl, last_value(name IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) bf,
  first_value(name IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) af FROM g),
i AS (SELECT *, CASE WHEN gap AND rl <= 100 AND regexp_replace(lower(bf), ' bike lane$', '') = regexp_replace(lower(af), ' bike lane$', '') THEN bf ELSE name END nm FROM h),
j AS (SELECT *, regexp_replace(lower(coalesce(nm, '')), ' bike lane$', '') base FROM i),
k AS (SELECT *, lag(b1) OVER w bef, sum(CASE WHEN lagb IS DISTINCT FROM base OR lagb IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY pos ROWS UNBOUNDED PRECEDING) isl
  FROM (SELECT *, lag(base) OVER w lagb FROM j WINDOW w AS (PARTITION BY route_id ORDER BY pos)) WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
sd AS (SELECT *, swb - b0 + 360 - 360*floor((swb - b0 + 360)/360) rel FROM k),
se AS (SELECT *, CASE WHEN rel IS NULL OR rel < 5 OR rel > 355 OR (rel > 175 AND rel < 185) THEN NULL WHEN rel < 180 THEN 'right' ELSE 'left' END side FROM sd),
r AS (SELECT route_id, isl, min(pos) at_, arg_min(nm, pos) nm0, first(nm ORDER BY pos) nm, first(b0 ORDER BY pos) b0, first(bef ORDER BY pos) bef, first(circle ORDER BY pos) circle, sum(len_ft) feet,
  bool_or(coalesce(model = 'BKF-ONEWAY', false)) lane, bool_and(is_oneway) one, bool_or(is_sidewalk) anys, bool_and(is_sidewalk) alls, (array_agg(side ORDER BY pos) FILTER (side IS NOT NULL))[1] side FROM se GROUP BY route_id, isl),
v AS (SELECT *, {_STREET} st, b0 - bef + 540 - 360*floor((b0 - bef + 540)/360) - 180 dl FROM r),
w AS (SELECT *, CASE WHEN bef IS NULL THEN 'Head ' || (['north','northeast','east','southeast','south','southwest','west','northwest'])[1 + CAST(floor(b0/45+0.5) AS INT) % 8]
    WHEN abs(dl) <= 30 THEN 'Continue' WHEN circle THEN (CASE WHEN abs(dl) >= 110 THEN 'Make a ' ELSE 'Turn ' END) || (CASE WHEN dl < 0 THEN 'left' ELSE 'right' END) || ' at the traffic circle'
    ELSE (CASE WHEN abs(dl) >= 110 THEN 'Sharp ' WHEN abs(dl) >= 60 THEN 'Turn ' ELSE 'Slight ' END) || (CASE WHEN dl < 0 THEN 'left' ELSE 'right' END) END verb,
  CASE WHEN alls THEN 'the ' || coalesce(side || ' ', '') || 'sidewalk' || coalesce(' of ' || st, '') ELSE st END onto FROM v),
x AS (SELECT *, verb || coalesce((CASE WHEN bef IS NULL THEN ' on ' ELSE ' onto ' END) || onto, '') words FROM w),
y AS (SELECT *, sum(CASE WHEN bef IS NOT NULL AND nm IS NULL AND words = 'Continue' THEN 0 ELSE 1 END) OVER (PARTITION BY route_id ORDER BY at_ ROWS UNBOUNDED PRECEDING) step FROM x)
SELECT route_id, CAST(step AS BIGINT) step, first(words ORDER BY at_) instruction, first(coalesce(st, '') ORDER BY at_) AS name, round(sum(feet), 3) feet,
  concat_ws('; ', CASE WHEN first(lane AND NOT one ORDER BY at_) THEN 'One-way bike lane may or may not be in direction of travel' END, CASE WHEN first(anys AND NOT alls ORDER BY at_) THEN 'Includes a short sidewalk segment' END,
   CASE WHEN NOT first(lane AND NOT one ORDER BY at_) AND bool_or(lane AND NOT one) THEN 'One-way bike lane may or may not be in direction of travel' END,
   CASE WHEN NOT first(anys AND NOT alls ORDER BY at_) AND bool_or(anys AND NOT alls) THEN 'Includes a short sidewalk segment' END) notes
FROM y GROUP BY route_id, step"""


def longest_stretch(spark: SparkSession, folder: str) -> DataFrame:
    p = _path(spark, folder).withColumn("off", F.col("model").isNull())
    return ordered.longest_run(p, "off", "route_id", "pos", "len_ft").withColumn("feet", F.round("feet", 3))


LONGEST_STRETCH = _PATH + """,
a AS (SELECT route_id, pos, len_ft, model IS NULL off, lag(model IS NULL) OVER (PARTITION BY route_id ORDER BY pos) prv FROM pt),
b AS (SELECT *, sum((off AND NOT coalesce(prv, false))::INT) OVER (PARTITION BY route_id ORDER BY pos ROWS UNBOUNDED PRECEDING) run FROM a),
c AS (SELECT route_id, run, min(pos) from_pos, max(pos) to_pos, sum(len_ft) feet FROM b WHERE off GROUP BY route_id, run)
SELECT route_id, from_pos, to_pos, round(feet, 3) feet FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY feet DESC, run) n FROM c) WHERE n = 1"""

PLANS = {
    "route_grades": (route_grades, ROUTE_GRADES), "route_climb": (route_climb, ROUTE_CLIMB), "route_positions": (route_positions, ROUTE_POSITIONS),
    "route_signs": (route_signs, ROUTE_SIGNS), "route_coverage": (route_coverage, ROUTE_COVERAGE), "split_streets": (split_streets, SPLIT_STREETS),
    "dense_numbers": (dense_numbers, DENSE_NUMBERS), "directions": (directions, DIRECTIONS), "longest_stretch": (longest_stretch, LONGEST_STRETCH),
}
