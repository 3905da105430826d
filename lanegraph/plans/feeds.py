"""Plans of paged layers, map layers, ways with gaps, and nearest places at any distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.functions import geo, style
from lanegraph.operators import matching, ordered
from lanegraph.plans.fixtures import ctes, relation
from lanegraph.sources import manifest, paged, places, versions
from lanegraph.stage import fresh_path


def paged_signs(spark: SparkSession, folder: str) -> DataFrame:
    """Street signs saved as a service's pages and read by the page source, with a filter that goes to the reader."""
    path = fresh_path(spark, "pages")
    s = relation(spark, folder, "signs")
    tags = F.create_map(F.lit("sign_id"), F.col("sign_id").cast("string"), F.lit("kind_of"), "kind", F.lit("facing"), "facing")
    paged.save_pages(s.select("sign_id", tags.alias("properties"), F.lit("Point").alias("kind"), F.array("lon", "lat").alias("coordinates")), path, "sign_id", 20)
    rows = paged.read_pages(spark, path, ["sign_id", "kind_of", "facing"]).filter("kind_of in ('stop', 'signal') and facing <> '?'")
    at = F.from_json("coordinates", "array<double>")
    return rows.select(F.col("sign_id").cast("bigint").alias("sign_id"), "kind_of", "facing", F.round(F.get(at, 0), 6).alias("lon"), F.round(F.get(at, 1), 6).alias("lat"))


PAGED_SIGNS = ctes("signs") + " SELECT sign_id, kind kind_of, facing, round(lon, 6) lon, round(lat, 6) lat FROM signs WHERE kind IN ('stop', 'signal') AND facing <> '?'"


def map_layers(spark: SparkSession, folder: str) -> DataFrame:
    """The layers every feature is drawn in, by the style's filters, and the width of its line."""
    w = relation(spark, folder, "ways")
    some = lambda m, **values: F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (int(k[1:]), v)]), (F.col("way_id") % m).cast("int"))
    text = {
        "CURRENT_STATUS": F.col("status"), "CATEGORY": F.col("category"), "bike_network_category": F.col("network"), "OPENTOPUBLIC": some(4, k0="YES", k1="YES", k2="NO"), "LIFECYCLESTATUSTXT": some(3, k0="A", k1="A"),
        "CURRENTSTATUS": some(5, k0="CLOSED", k1="OPEN"), "OPERATIONALSTATUS": some(7, k0="Open Regular Hours", k1="Closed"),
    }
    number = {"index": F.when(F.col("way_id") % 6 != 5, F.col("way_id") % 3), "elev_ft": F.col("way_id") % 40 * 12.5}
    made = style.Style({n: (c, style.TEXT) for n, c in text.items()} | {n: (c.cast("double"), style.NUMBER) for n, c in number.items()}, (F.col("way_id") % 9 + 9).cast("double"))
    widths = [F.round(made.column(e), 6).alias(f"{n}_width") for n, e in style.WIDTHS.items()]
    return w.select("way_id", F.array_join(style.layers_of(made), ",").alias("layers"), made.column(style.ELEVATION_LABEL).alias("label"), *widths)


_FACILITIES = ",\n".join(
    f"CASE WHEN {state} AND category IN ({', '.join(repr(c) for c in some)}) THEN 'bike-facilities-{prefix}{name}' END"
    for name, some in (("aaa", ["BKF-NGW", "BKF-PBL", "BKF-OFFST"]), ("bbl", ["BKF-BBL"]), ("bl", ["BKF-BL"]), ("narrow", ["BKF-CLMB", "BKF-SHW"]))
    for prefix, state in (("", "status IN ('INSVC', 'PLNRECON')"), ("construction-", "status = 'UNDERCONS'"))
)
_PLANNED = "coalesce(network IN ('Proposed Bike+ - Arterial', 'Proposed Bike+ - Upgrade, Arterial', 'Proposed Bike+ - Non-Arterial', 'Proposed Multi-Use Trail', 'Non-Bike+ Planned'), false)"
MAP_LAYERS = ctes("ways") + f""",
f AS (SELECT *, CASE WHEN way_id % 6 <> 5 THEN way_id % 3 END i, way_id % 40 * 12.5e0 e, CAST(way_id % 9 + 9 AS DOUBLE) z FROM ways)
SELECT way_id, array_to_string(list_filter([CASE WHEN i = 0 THEN 'contours-thin' END, CASE WHEN i = 1 THEN 'contours-index' END, CASE WHEN i = 1 THEN 'contours-labels' END,
  CASE WHEN {_PLANNED} THEN 'bike-plus-planned' END, CASE WHEN NOT {_PLANNED} THEN 'bike-plus-existing' END, {_FACILITIES}, CASE WHEN status IN ('INSVC', 'PLNRECON') THEN 'bike-racks' END,
  CASE WHEN way_id % 4 < 2 AND way_id % 3 < 2 AND way_id % 5 <> 0 THEN 'parks-restrooms' END, CASE WHEN way_id % 7 = 0 THEN 'community-centers' END], lambda x: x IS NOT NULL), ',') layers,
  CASE WHEN e = floor(e) THEN CAST(CAST(e AS BIGINT) AS VARCHAR) ELSE CAST(e AS VARCHAR) END || ' ft' AS label,
  round(CASE WHEN z <= 10 THEN 1.5 WHEN z <= 14 THEN 1.5 + (z-10)/4*2.0 ELSE 3.5 END::DOUBLE, 6) green_width, round(CASE WHEN z <= 10 THEN 0.8 WHEN z <= 14 THEN 0.8 + (z-10)/4*1.0 ELSE 1.8 END::DOUBLE, 6) orange_width,
  round(CASE WHEN z <= 11 THEN 0.6 WHEN z <= 14 THEN 0.6 + (z-11)/3*0.5 WHEN z <= 16 THEN 1.1 + (z-14)/2*0.4 ELSE 1.5 END::DOUBLE, 6) index_width FROM f"""

#: Corners of the area that parts must have their middle in.
_SQUARE = ((0.0, 0.0), (900.0, 0.0), (900.0, 900.0), (0.0, 900.0))


def known_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Ways cut at shared nodes where one node in twenty has no coordinates, by the middle of each part."""
    ways = relation(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("n")))), lambda x: x["n"]).alias("nodes"))
    nodes = relation(spark, folder, "part").filter("p_partkey % 20 <> 7").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 37 % 1000).cast("double").alias("lon"), (F.col("p_partkey") * 53 % 1000).cast("double").alias("lat"))
    ring = F.array(F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in _SQUARE]))
    parts = ordered.split_known_ways(ways, nodes, geo.in_rings(F.col("lon") + 0.5, F.col("lat") + 0.5, ring))
    return parts.select("way_id", "part", F.array_join(F.transform("points", lambda p: p["node"].cast("string")), ",").alias("nodes"), F.aggregate("points", F.lit(0.0), lambda a, p: a + p["lon"] + p["lat"]).alias("total"))


KNOWN_PARTS = """
WITH p AS (SELECT l_orderkey way_id, l_partkey node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 pos, count(*) OVER (PARTITION BY l_orderkey) n FROM lineitem),
o AS (SELECT node, sum(1 + (pos = 0 OR pos = n-1)::INT) times FROM p GROUP BY node),
g AS (SELECT way_id, min(pos) gap FROM p WHERE node % 20 = 7 OR node NOT IN (SELECT p_partkey FROM part) GROUP BY way_id),
c AS (SELECT p.*, pos > 0 AND (times >= 2 OR pos = n-1) cut FROM p JOIN o USING (node)),
k AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) part FROM c),
a AS (SELECT way_id, part, pos, node FROM k UNION ALL SELECT way_id, part + 1, pos, node FROM k WHERE cut AND pos < n-1),
b AS (SELECT a.way_id, part, list(node ORDER BY pos) ns FROM a LEFT JOIN g USING (way_id) GROUP BY a.way_id, part HAVING count(*) > 1 AND (min(gap) IS NULL OR max(pos) < min(gap))),
m AS (SELECT *, ns[1 + CAST(floor(len(ns)/2) AS INT)] mid FROM b)
SELECT way_id, CAST(part AS BIGINT) part, array_to_string(ns, ',') nodes, CAST(list_sum(list_transform(ns, lambda x: x*37 % 1000 + x*53 % 1000)) AS DOUBLE) total FROM m WHERE mid*37 % 1000 < 900 AND mid*53 % 1000 < 900"""


def _far_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points of interest, a few of them degrees away from the map."""
    far = F.when(F.col("poi_id") % 97 == 0, F.col("poi_id") % 5 - 2.0).otherwise(0.0)
    return relation(spark, folder, "pois").select(F.col("poi_id").alias("point_id"), (F.col("lon") + far).alias("px"), (F.col("lat") - far).alias("py"))


def nearest_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest node of every point, however far."""
    found = matching.snap_to_nodes(_far_points(spark, folder), relation(spark, folder, "nodes"), None)
    return found.select("point_id", "node_id", F.round("d2", 9).alias("d2"))


_FAR = "fp AS (SELECT poi_id point_id, lon + CASE WHEN poi_id % 97 = 0 THEN poi_id % 5 - 2e0 ELSE 0 END px, lat - CASE WHEN poi_id % 97 = 0 THEN poi_id % 5 - 2e0 ELSE 0 END py FROM pois)"
NEAREST_NODES = ctes("nodes", "pois") + f""",
{_FAR},
d AS (SELECT point_id, node_id, (px-lon)*(px-lon) + (py-lat)*(py-lat) d2 FROM fp, nodes)
SELECT point_id, arg_min(node_id, (d2, node_id)) node_id, round(min(d2), 9) d2 FROM d GROUP BY point_id"""


def island_snap(spark: SparkSession, folder: str) -> DataFrame:
    """Points snapped to the main component of a broken-up map: its edges within reach, else its nearest node however far."""
    e = relation(spark, folder, "islands").select(
        F.col("seg_id").alias("edge_id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(False).alias("is_sidewalk"), F.col("alon").alias("slon"), F.col("alat").alias("slat"), F.col("blon").alias("dlon"), F.col("blat").alias("dlat"), F.lit(300.0).alias("len_ft")
    )
    s = matching.snap(_far_points(spark, folder), e, relation(spark, folder, "nodes"), node_radius=None)
    return s.select("point_id", "kind", "edge_id", "node_id", F.round("from_ft", 2).alias("from_ft"))


ISLAND_SNAP = ctes("islands", "nodes", "pois") + f""",
{_FAR},
wy AS MATERIALIZED (SELECT a x, b y FROM islands UNION ALL SELECT b, a FROM islands),
lb(node, c) USING KEY (node) AS (SELECT DISTINCT x, x FROM wy UNION (SELECT w.y, min(l.c) FROM lb l JOIN wy w ON w.x = l.node JOIN recurring.lb o ON o.node = w.y GROUP BY w.y HAVING min(l.c) < min(o.c))),
mc AS (SELECT c FROM lb GROUP BY c ORDER BY count(*) DESC, c LIMIT 1),
mn AS (SELECT node FROM lb WHERE c = (SELECT c FROM mc)),
sg AS (SELECT seg_id edge_id, alon x0, alat y0, blon x1, blat y1 FROM islands WHERE a IN (SELECT node FROM mn)),
pj AS (SELECT point_id, edge_id, greatest(0, least(1, ((px-x0)*245000e0*(x1-x0)*245000e0 + (py-y0)*364000e0*(y1-y0)*364000e0) / (pow((x1-x0)*245000e0, 2) + pow((y1-y0)*364000e0, 2)))) t, px, py, x0, y0, x1, y1
  FROM fp, sg WHERE abs(px-(x0+x1)/2) < 0.003 AND abs(py-(y0+y1)/2) < 0.003),
pd AS (SELECT *, sqrt(pow((px-x0-t*(x1-x0))*245000e0, 2) + pow((py-y0-t*(y1-y0))*364000e0, 2)) dist FROM pj),
hh AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, edge_id) r FROM pd WHERE dist <= 200),
nn AS (SELECT point_id, arg_min(node_id, ((px-lon)*(px-lon) + (py-lat)*(py-lat), node_id)) node_id FROM fp, nodes WHERE node_id IN (SELECT node FROM mn) GROUP BY point_id)
SELECT fp.point_id, CASE WHEN edge_id IS NOT NULL THEN 'edge' ELSE 'node' END kind, edge_id, CASE WHEN edge_id IS NULL THEN node_id END node_id, round(t*300, 2) from_ft
FROM fp LEFT JOIN hh ON hh.point_id = fp.point_id AND r = 1 LEFT JOIN nn ON nn.point_id = fp.point_id"""

BOX = (-122.43, 47.502, -122.411, 47.517)


def box_places(spark: SparkSession, folder: str) -> DataFrame:
    """Points of interest of a box, read from a table in the order of a space-filling curve."""
    path = fresh_path(spark, "places")
    places.write_places(relation(spark, folder, "pois"), path)
    return places.read_box(spark, path, BOX).select("poi_id", "name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


BOX_PLACES = ctes("pois") + f" SELECT poi_id, name, round(lon, 6) lon, round(lat, 6) lat FROM pois WHERE lon BETWEEN {BOX[0]}::DOUBLE AND {BOX[2]}::DOUBLE AND lat BETWEEN {BOX[1]}::DOUBLE AND {BOX[3]}::DOUBLE"



def rewritten_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes rewritten in place from their own table, beside a reader that stays with the version before."""
    path = fresh_path(spark, "nodes")
    first = versions.publish(relation(spark, folder, "nodes").select("node_id", "elev_ft"), path)
    before = versions.read(spark, path)
    raised = F.when(F.col("node_id") % 3 == 0, F.col("elev_ft") + 5).otherwise(F.col("elev_ft"))
    versions.publish(versions.read(spark, path).withColumn("elev_ft", raised), path, expected=first)
    return versions.read(spark, path).join(before.withColumnRenamed("elev_ft", "was_ft"), "node_id")


REWRITTEN_NODES = ctes("nodes") + " SELECT node_id, CASE WHEN node_id % 3 = 0 THEN elev_ft + 5 ELSE elev_ft END elev_ft, elev_ft was_ft FROM nodes"


def manifest_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of a manifest of one file per document: files, bytes, and that zipping helps in all."""
    d = relation(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("text").cast("binary").alias("content"))
    m = d.select("url", F.octet_length("content").cast("long").alias("size"), manifest.zipped_size("content").alias("zipped"), manifest.short_hash(F.col("content")).alias("hash"))
    return manifest.totals(m).select("n_files", "size", (F.col("fetched") < F.col("size")).alias("shrinks"))


MANIFEST_TOTALS = "SELECT count(*) n_files, CAST(sum(octet_length(encode(text))) AS BIGINT) size, true shrinks FROM documents"


def sliced_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Every route from the middle of its fourth leg on, and back from there."""
    lines = relation(spark, folder, "route_points").groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points")).filter(F.size("points") > 4)
    a, b = F.get("points", F.lit(3)), F.get("points", F.lit(4))
    place = F.struct(*[((a[c] + b[c]) / 2).alias(c) for c in ("lon", "lat")])
    rows = lines.select("route_id", F.explode(F.array(*[F.struct(F.lit(ahead).alias("ahead"), geo.slice_to_end(F.col("points"), place, F.lit(4), ahead).alias("p")) for ahead in (True, False)])).alias("s"))
    end = F.element_at("s.p", -1)
    return rows.select("route_id", F.col("s.ahead").alias("ahead"), F.size("s.p").alias("n_points"), F.round(F.get("s.p", F.lit(0))["lon"], 7).alias("lon"), F.round(end["lon"], 6).alias("end_lon"), F.round(end["lat"], 6).alias("end_lat"))


SLICED_ENDS = ctes("route_points") + """,
pt AS (SELECT route_id, list(lon ORDER BY seq) x, list(lat ORDER BY seq) y FROM route_points GROUP BY route_id HAVING count(*) > 4)
SELECT route_id, ahead, CAST(CASE WHEN ahead THEN len(x) - 3 ELSE 5 END AS INT) n_points, round((x[4]+x[5])/2, 7) lon, round(CASE WHEN ahead THEN x[len(x)] ELSE x[1] END, 6) end_lon, round(CASE WHEN ahead THEN y[len(x)] ELSE y[1] END, 6) end_lat
FROM pt, (VALUES (true), (false)) w(ahead)"""

PLANS = {
    "rewritten_nodes": (rewritten_nodes, REWRITTEN_NODES), "manifest_totals": (manifest_totals, MANIFEST_TOTALS), "sliced_ends": (sliced_ends, SLICED_ENDS),
    "box_places": (box_places, BOX_PLACES),
    "paged_signs": (paged_signs, PAGED_SIGNS), "map_layers": (map_layers, MAP_LAYERS), "known_parts": (known_parts, KNOWN_PARTS), "nearest_nodes": (nearest_nodes, NEAREST_NODES), "island_snap": (island_snap, ISLAND_SNAP),
}
