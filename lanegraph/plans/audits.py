"""Plans of audits, unions of sources, and what the build writes and reads again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.functions import geo
from lanegraph.operators import audit, elevation, matching, ordered, propagation
from lanegraph.plans.fixtures import ctes, relation
from lanegraph.plans.graphs import _GROUPS, _grouped
from lanegraph.plans.routes import _PATH, _STREET, _path
from lanegraph.sources import graph, layers, manifest
from lanegraph.stage import fresh_path


def layer_distribution(spark: SparkSession, folder: str) -> DataFrame:
    s = relation(spark, folder, "sega").withColumns({"is_crossing": F.col("seg_id") % 6 == 0, "is_approach": F.col("seg_id") % 7 == 0})
    return audit.layer_distribution(s)


LAYER_DISTRIBUTION = ctes("sega") + """,
l AS (SELECT CASE WHEN coalesce(layer, 0) = 0 THEN CASE WHEN is_bridge THEN 'bridge-no-layer' WHEN is_tunnel THEN 'tunnel-no-layer' WHEN seg_id % 6 = 0 THEN 'untagged-crossing' WHEN seg_id % 7 = 0 THEN 'approach' END
  ELSE CASE WHEN is_bridge THEN 'bridge' WHEN is_tunnel THEN 'tunnel' ELSE 'plain-layered' END || ' L=' || CASE WHEN layer > 0 THEN '+' ELSE '' END || layer END label FROM sega)
SELECT label, count(*) n FROM l WHERE label IS NOT NULL GROUP BY label"""


def group_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return audit.group_ranks(_grouped(spark, folder)).select("grp", "rank", "n_ranks")


GROUP_RANKS = _GROUPS + """,
k AS (SELECT grp, edge_id, CASE WHEN is_bridge THEN CASE WHEN layer > 0 THEN layer ELSE 1 END WHEN is_tunnel THEN CASE WHEN layer < 0 THEN layer ELSE -1 END WHEN layer <> 0 THEN layer END r FROM gs),
m AS (SELECT grp, r, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, min(edge_id)) i FROM k WHERE r IS NOT NULL GROUP BY grp, r)
SELECT k.grp, any_value(m.r) rank, count(DISTINCT k.r) n_ranks FROM k LEFT JOIN m ON m.grp = k.grp AND i = 1 GROUP BY k.grp"""


def group_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """What every group is made of and where it lies."""
    g = _grouped(spark, folder).withColumn("kind", F.when(F.col("is_bridge"), "bridge").when(F.col("is_tunnel"), "tunnel").otherwise("other"))
    out = audit.group_places(g, relation(spark, folder, "nodes")).join(audit.mix(g, "grp", "kind"), "grp").join(audit.mix(g, "grp", "layer"), "grp").join(audit.mix(g, "grp", "street"), "grp")
    return out.select("grp", *[F.round(c, 5).alias(c) for c in ("lon", "lat", "dlon", "dlat")], "kind", "layer", "street")


_MIX = "(SELECT grp, string_agg(v || '=' || n, '|' ORDER BY v) m FROM (SELECT grp, coalesce(CAST({c} AS VARCHAR), '<none>') v, count(*) n FROM gk GROUP BY 1, 2) GROUP BY grp)"
GROUP_PROFILES = _GROUPS + f""",
gk AS (SELECT *, CASE WHEN is_bridge THEN 'bridge' WHEN is_tunnel THEN 'tunnel' ELSE 'other' END kind FROM gs),
e AS (SELECT grp, u node_id FROM gs UNION ALL SELECT grp, v FROM gs),
p AS (SELECT grp, round(avg(lon), 5) lon, round(avg(lat), 5) lat, round(max(lon) - min(lon), 5) dlon, round(max(lat) - min(lat), 5) dlat FROM e JOIN nodes USING (node_id) GROUP BY grp)
SELECT p.*, a.m kind, b.m layer, c.m street FROM p JOIN {_MIX.format(c="kind")} a USING (grp) JOIN {_MIX.format(c="layer")} b USING (grp) JOIN {_MIX.format(c="street")} c USING (grp)"""


def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return audit.counts(relation(spark, folder, "ways"), "category", "status")


CATEGORY_COUNTS = ctes("ways") + " SELECT category, status, count(*) n FROM ways GROUP BY ALL"


def clean_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of streets that no flagged group touches."""
    s, g = relation(spark, folder, "seg"), _grouped(spark, folder)
    every = s.select(F.col("a").alias("node")).union(s.select("b"))
    return audit.unlisted(every, g.select(F.explode(F.array("u", "v")).alias("node")), "node")


CLEAN_NODES = _GROUPS + " SELECT a node FROM (SELECT a FROM seg UNION SELECT b FROM seg) EXCEPT (SELECT u FROM gs UNION SELECT v FROM gs)"


def facility_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Facilities of four sources by class."""
    w = relation(spark, folder, "ways").withColumn("fac_id", F.col("way_id"))
    model = F.when(F.col("way_id") % 6 == 0, "BKF-ONEWAY")
    parts = [w.filter(F.col("way_id") % 4 == k) for k in range(4)]
    found = matching.all_facilities(parts[0].select("fac_id", "status", "category", model.alias("model")), parts[1].select("fac_id"), parts[2].select("fac_id"), parts[3].select("fac_id", F.col("network").alias("category")))
    return found.select("source", "fac_id", "category", "model")


FACILITY_SOURCES = ctes("ways") + """,
f AS (SELECT CASE way_id % 4 WHEN 0 THEN 'streets' WHEN 1 THEN 'trails' WHEN 2 THEN 'regional' ELSE 'network' END source, way_id fac_id,
  CASE way_id % 4 WHEN 0 THEN CASE WHEN status IN ('INSVC', 'PLNRECON') AND category <> 'BKF-XYZ' THEN category END WHEN 3 THEN CASE network WHEN 'Existing Bike+ - Non-Arterial' THEN 'BKF-NGW' WHEN 'Existing Bike+ - Arterial' THEN 'BKF-PBL' WHEN 'Existing Multi-Use Trail' THEN 'BKF-OFFST' END ELSE 'BKF-OFFST' END category,
  CASE WHEN way_id % 12 = 0 THEN 'BKF-ONEWAY' END model FROM ways)
SELECT * FROM f WHERE category IS NOT NULL"""


def circle_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Traffic circles by tag, from the layer and by shape."""
    n = relation(spark, folder, "nodes")
    s = relation(spark, folder, "signs").filter("sign_id % 5 = 0").select(F.col("sign_id").alias("circle_id"), "lon", "lat")
    seg = relation(spark, folder, "seg").filter("(seg_id % 2 = 0 and (a % 40) % 3 = 0 and floor(a/40) % 3 < 2) or (seg_id % 2 = 1 and floor(a/40) % 3 = 0 and (a % 40) % 3 < 2)")
    short = seg.select("a", "b", (geo.planar_ft(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat")) / 10).alias("len_ft"))
    from lanegraph.operators.components import connected_components

    found = propagation.rings(short, connected_components(short, "a", "b"), n, lambda *p: geo.planar_ft(*p) / 10)
    return audit.counts(matching.circle_points(n.filter("is_circle"), s, found), "source")


CIRCLE_SOURCES = ctes("signs") + """,
s AS (SELECT count(*) n FROM signs WHERE sign_id % 5 = 0), t AS (SELECT count(*) n FROM nodes WHERE is_circle),
sg AS (SELECT 2*u.node_id + d.dir seg_id, u.node_id a, v.node_id b, sqrt(pow((v.lon-u.lon)*245000e0,2)+pow((v.lat-u.lat)*364000e0,2))/10 l FROM nodes u CROSS JOIN (SELECT 0 dir UNION ALL SELECT 1) d
  JOIN nodes v ON v.node_id = u.node_id + CASE WHEN d.dir=0 THEN 1 ELSE 40 END WHERE (d.dir=1 OR u.node_id % 40 < 39) AND (2*u.node_id + d.dir)*31 % 17 <> 0),
sh AS (SELECT * FROM sg WHERE (seg_id % 2 = 0 AND (a % 40) % 3 = 0 AND floor(a/40) % 3 < 2) OR (seg_id % 2 = 1 AND floor(a/40) % 3 = 0 AND (a % 40) % 3 < 2)),
e AS (SELECT a, b FROM sh UNION ALL SELECT b, a FROM sh),
r AS (SELECT DISTINCT a node, a seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) component FROM r GROUP BY node),
dg AS (SELECT x node, count(*) g, sum(l) l FROM (SELECT a x, l FROM sh UNION ALL SELECT b, l FROM sh) GROUP BY x),
k AS (SELECT component FROM c JOIN dg USING (node) GROUP BY component HAVING count(*) BETWEEN 3 AND 6 AND min(g) = 2 AND max(g) = 2 AND sum(l)/2 <= 200),
p AS (SELECT component, lon, lat FROM c JOIN k USING (component) JOIN nodes ON node_id = node),
w AS (SELECT x.component FROM p x JOIN p y USING (component) GROUP BY 1 HAVING max(sqrt(pow((y.lon-x.lon)*245000e0,2)+pow((y.lat-x.lat)*364000e0,2))/10) <= 60)
SELECT * FROM (SELECT 'layer' source, n FROM s UNION ALL SELECT 'tag', n FROM t UNION ALL SELECT 'ring', count(*) FROM w) WHERE n > 0"""


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.arrivals(_path(spark, folder))


ARRIVALS = _PATH + f""",
l AS (SELECT route_id, max(pos) + 1 step, arg_max(coalesce(name, ''), pos) nm FROM pt GROUP BY route_id)
SELECT route_id, step, 'Arrive at destination' instruction, {_STREET} AS name, 0e0 feet FROM l"""


def straight_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Climb of every edge as a straight slope between its ends."""
    n = relation(spark, folder, "nodes")
    d = relation(spark, folder, "dir").join(n.select(F.col("node_id").alias("src"), F.col("elev_ft").alias("e0")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("elev_ft").alias("e1")), "dst")
    feet = geo.rounded(F.col("len_ft"), 1)
    up, grade, steep = elevation.even_metrics(F.col("e1") - F.col("e0"), feet)
    return d.select("edge_id", up.alias("uphill_ft"), geo.rounded(grade, 3).alias("max_uphill"), geo.rounded(steep, 1).alias("steep_ft2"))


STRAIGHT_PROFILES = ctes("dir") + """,
p AS (SELECT edge_id, n1.elev_ft - n0.elev_ft r, round(len_ft, 1) f FROM dir JOIN nodes n0 ON n0.node_id = src JOIN nodes n1 ON n1.node_id = dst)
SELECT edge_id, CASE WHEN f > 0 AND r > 0 THEN round(r, 2) ELSE 0 END uphill_ft, CASE WHEN f > 0 AND r > 0 THEN round(round(r/f, 4), 3) ELSE 0 END max_uphill,
  CASE WHEN f > 0 AND r > 0 THEN round(round(f*pow(greatest(r/f - 0.02e0, 0), 2), 2), 1) ELSE 0 END steep_ft2 FROM p"""


def street_layer(spark: SparkSession, folder: str) -> DataFrame:
    """Streets as a line-delimited layer, cached, with two-part lines taken apart; pages of points beside it."""
    path = fresh_path(spark, "street-layer")
    s = relation(spark, folder, "seg")
    point = lambda x, y: F.array(F.col(x), F.col(y))
    rows = s.select(F.create_map(F.lit("id"), F.col("seg_id").cast("string")).alias("properties"), F.lit("LineString").alias("kind"), F.array(point("alon", "alat"), point("blon", "blat")).alias("coordinates"))
    one = layers.cached_features(spark, f"{path}/lines", lambda: rows)
    again = layers.cached_features(spark, f"{path}/lines", lambda: 1 / 0)
    many = again.filter("properties['id'] % 2 = 0").withColumn("coordinates", F.concat(F.lit("["), "coordinates", F.lit(","), "coordinates", F.lit("]"))).withColumn("kind", F.lit("MultiLineString"))
    parts = layers.line_parts(one.unionByName(many))
    n = parts.groupBy(F.col("properties")["id"].cast("long").alias("seg_id")).agg(F.count("*").alias("n_parts"), F.round(F.min(F.get("points", 0)["lon"]), 6).alias("lon"), F.round(F.max(F.get("points", 1)["lat"]), 6).alias("lat"))
    pages = [f"{path}/page-{k}" for k in range(2)]
    for k, page in enumerate(pages):
        layers.write_features(s.filter(F.col("seg_id") % 2 == k).select(F.create_map(F.lit("id"), F.col("seg_id").cast("string")).alias("properties"), F.lit("Point").alias("kind"), point("alon", "alat").alias("coordinates")), page)
    paged = layers.read_pages(spark, pages).select(F.col("properties")["id"].cast("long").alias("seg_id"))
    return n.join(paged, "seg_id")


STREET_LAYER = ctes("seg") + " SELECT seg_id, CAST(CASE WHEN seg_id % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) n_parts, round(alon, 6) lon, round(blat, 6) lat FROM seg"


def graph_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The graph numbered, written and read back: every edge with its ends' places."""
    path = fresh_path(spark, "graph")
    d = relation(spark, folder, "dir")
    nodes, edges = graph.numbered(relation(spark, folder, "nodes"), d.select("edge_id", "src", "dst", F.col("seg_id").alias("geom"), "len_ft"))
    lines = relation(spark, folder, "seg").select(F.col("seg_id").alias("geom"), F.array(F.struct(F.col("alon").alias("lon"), F.col("alat").alias("lat")), F.struct(F.col("blon").alias("lon"), F.col("blat").alias("lat"))).alias("points"))
    graph.write_graph(nodes, edges, lines, path)
    nodes, edges, lines = graph.read_graph(spark, path)
    a, b = nodes.select(F.col("node").alias("from"), F.col("lon").alias("slon")), nodes.select(F.col("node").alias("to"), F.col("lat").alias("dlat"))
    out = edges.join(a, "from").join(b, "to").join(lines, "geom")
    return out.select("edge_id", "from", "to", F.round("slon", 6).alias("slon"), F.round("dlat", 6).alias("dlat"), F.size("points").alias("n_points"))


GRAPH_ROUND_TRIP = ctes("dir") + """,
k AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 i FROM (SELECT src node_id FROM dir UNION SELECT dst FROM dir))
SELECT edge_id, a.i AS "from", b.i AS "to", round(slon, 6) slon, round(dlat, 6) dlat, 2 n_points FROM dir JOIN k a ON a.node_id = src JOIN k b ON b.node_id = dst"""


def changed_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers whose setting differs from the default, nulls compared as values."""
    s = relation(spark, folder, "supplier").select(F.col("s_suppkey").alias("grp"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 2 == 0).alias("checked"))
    defaults = relation(spark, folder, "supplier").select(F.col("s_suppkey").alias("grp"), F.when(F.col("s_suppkey") % 5 != 0, F.lit(True)).alias("checked"))
    return audit.changed(s, defaults)


CHANGED_SETTINGS = """
WITH s AS (SELECT s_suppkey grp, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 2 = 0 END checked, CASE WHEN s_suppkey % 5 <> 0 THEN true END d FROM supplier) SELECT grp, checked FROM s WHERE checked IS DISTINCT FROM d"""


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """The dataset's own files: size, zipped size, hash; tests hold them against Python's."""
    return manifest.files(spark, f"{folder}/*.parquet")


PLANS = {
    "layer_distribution": (layer_distribution, LAYER_DISTRIBUTION), "group_ranks": (group_ranks, GROUP_RANKS), "group_profiles": (group_profiles, GROUP_PROFILES), "category_counts": (category_counts, CATEGORY_COUNTS),
    "clean_nodes": (clean_nodes, CLEAN_NODES), "facility_sources": (facility_sources, FACILITY_SOURCES), "circle_sources": (circle_sources, CIRCLE_SOURCES), "arrivals": (arrivals, ARRIVALS),
    "straight_profiles": (straight_profiles, STRAIGHT_PROFILES), "street_layer": (street_layer, STREET_LAYER), "graph_round_trip": (graph_round_trip, GRAPH_ROUND_TRIP), "changed_settings": (changed_settings, CHANGED_SETTINGS),
    "folder_files": (folder_files, None),
}
