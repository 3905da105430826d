"""Plans over the graph as a whole: components, spread, audits, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.functions import geo, tags
from lanegraph.operators import audit, propagation
from lanegraph.operators.components import connected_components
from lanegraph.plans.fixtures import ctes, relation


def components(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every node, and whether it is the main one (largest, then smallest id)."""
    c = connected_components(relation(spark, folder, "islands"), "a", "b")
    main = c.groupBy("component").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", -F.col("component"))).alias("m")).select((-F.col("m.col2")).alias("main"))
    return c.join(F.broadcast(main), c["component"] == main["main"], "left").select("node", "component", F.col("main").isNotNull().alias("main"))


_COMPONENTS = ctes("islands") + """,
e AS (SELECT a, b FROM islands UNION ALL SELECT b, a FROM islands),
r AS (SELECT DISTINCT a node, a seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen WHERE e.b < r.node OR r.seen <> e.b),
c AS (SELECT node, min(seen) component FROM r GROUP BY node)"""
COMPONENTS = _COMPONENTS + """,
m AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
SELECT node, c.component, m.component IS NOT NULL main FROM c LEFT JOIN m ON m.component = c.component"""


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    d = relation(spark, folder, "dir")
    own = [F.col(n) for n in ("is_bridge", "is_tunnel", "layer", "is_embankment", "is_cutting", "is_covered", "is_indoor")]
    return d.withColumn("source", tags.source_category(*own)).withColumn("len_ft", F.round("len_ft", 1))


LIMIT = 700.0


def _reach(edges: DataFrame) -> DataFrame:
    tagged = edges.filter("source is not null")
    seeds = tagged.select(F.col("src").alias("node_id"), F.col("source").alias("category")).union(tagged.select("dst", "source"))
    return propagation.spread(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("len_ft").alias("len")), seeds, LIMIT)


def reach(spark: SparkSession, folder: str) -> DataFrame:
    """Distance and kind of the nearest structure within the limit."""
    return _reach(_edges(spark, folder)).select("node_id", F.round("dist", 3).alias("dist"), "category")


_REACH = ctes("dir") + """,
ed AS (SELECT *, round(len_ft, 1) l, CASE WHEN is_bridge THEN 'bridge' WHEN is_tunnel THEN 'tunnel' WHEN layer <> 0 THEN 'layered' WHEN is_embankment THEN 'embankment'
  WHEN is_cutting THEN 'cutting' WHEN is_covered THEN 'covered' WHEN is_indoor THEN 'indoor' END source FROM dir),
ad AS (SELECT src u, dst v, l FROM ed UNION SELECT dst, src, l FROM ed),
sd AS (SELECT DISTINCT n node, source cat FROM (SELECT src n, source FROM ed UNION ALL SELECT dst, source FROM ed) WHERE source IS NOT NULL),
bf AS (SELECT node, 0e0 d, cat FROM sd UNION SELECT ad.v, bf.d + ad.l, cat FROM bf JOIN ad ON ad.u = bf.node WHERE bf.d + ad.l <= 700),
pr AS (SELECT node, d, cat, CASE cat WHEN 'bridge' THEN 0 WHEN 'tunnel' THEN 1 WHEN 'layered' THEN 2 WHEN 'embankment' THEN 3 WHEN 'cutting' THEN 4 WHEN 'covered' THEN 5 ELSE 6 END p FROM bf),
rc AS (SELECT node, d, p, cat FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, p) r FROM pr) WHERE r = 1)"""
REACH = _REACH + " SELECT node node_id, round(d, 3) dist, cat category FROM rc"


def approach_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder)
    return propagation.approaches(e.select("edge_id", "src", "dst", "source"), _reach(e), LIMIT).withColumn("cut_ft", F.round("cut_ft", 3))


APPROACH_EDGES = _REACH + """
SELECT edge_id, CASE WHEN x.node IS NOT NULL AND y.node IS NOT NULL THEN 'full' ELSE 'partial' END kind,
  CASE WHEN y.node IS NULL THEN x.cat WHEN x.node IS NULL THEN y.cat WHEN x.d < y.d OR (x.d = y.d AND x.p <= y.p) THEN x.cat ELSE y.cat END category,
  CASE WHEN y.node IS NULL THEN src WHEN x.node IS NULL THEN dst END AS "close", CASE WHEN y.node IS NULL THEN dst WHEN x.node IS NULL THEN src END far,
  CASE WHEN y.node IS NULL THEN round(700 - x.d, 3) WHEN x.node IS NULL THEN round(700 - y.d, 3) END cut_ft
FROM ed LEFT JOIN rc x ON x.node = src LEFT JOIN rc y ON y.node = dst WHERE source IS NULL AND (x.node IS NOT NULL OR y.node IS NOT NULL)"""


def isoline_splits(spark: SparkSession, folder: str) -> DataFrame:
    segs = relation(spark, folder, "sega").select("seg_id", "a", "b", "len_ft")
    partial = segs.filter("seg_id % 3 = 0").select("seg_id", F.when(F.col("seg_id") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("close"), F.when(F.col("seg_id") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("far"), ((F.col("seg_id") % 40) * 10.25).alias("cut_ft"))
    partial = partial.join(segs.select("seg_id", "len_ft"), "seg_id").withColumn("cut_ft", F.least("cut_ft", F.col("len_ft") - 0.5)).drop("len_ft")
    return propagation.split_at_isoline(segs, partial).withColumn("len_ft", F.round("len_ft", 3))


ISOLINE_SPLITS = ctes("sega") + """,
c AS (SELECT seg_id, a, b, len_ft, seg_id % 2 = 0 fwd, CASE WHEN seg_id % 3 = 0 THEN least((seg_id % 40)*10.25e0, len_ft - 0.5e0) END cut FROM sega)
SELECT seg_id, 0 piece, a, b, round(len_ft, 3) len_ft, CASE WHEN cut IS NULL OR cut < 1 THEN false ELSE true END approach FROM c WHERE cut IS NULL OR cut < 1 OR len_ft - cut < 1
UNION ALL SELECT seg_id, 0, a, 1000000000000000 + seg_id, round(CASE WHEN fwd THEN cut ELSE len_ft - cut END, 3), fwd FROM c WHERE cut >= 1 AND len_ft - cut >= 1
UNION ALL SELECT seg_id, 1, 1000000000000000 + seg_id, b, round(CASE WHEN fwd THEN len_ft - cut ELSE cut END, 3), NOT fwd FROM c WHERE cut >= 1 AND len_ft - cut >= 1"""


def small_rings(spark: SparkSession, folder: str) -> DataFrame:
    """Every third square of the lattice, standing alone and scaled to a traffic circle's size."""
    col, row = F.col("a") % 40, F.floor(F.col("a") / 40)
    square = ((F.col("seg_id") % 2 == 0) & (col % 3 == 0) & (row % 3 < 2)) | ((F.col("seg_id") % 2 == 1) & (row % 3 == 0) & (col % 3 < 2))
    s = relation(spark, folder, "seg").filter(square).select("a", "b", (geo.planar_ft(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat")) / 10).alias("len_ft"))
    tenth = lambda a, b, c, d: geo.planar_ft(a, b, c, d) / 10
    found = propagation.rings(s, connected_components(s, "a", "b"), relation(spark, folder, "nodes"), tenth)
    return found.select("component", "n", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


SMALL_RINGS = ctes("seg") + """,
s AS (SELECT a, b, sqrt(pow((blon-alon)*245000e0,2)+pow((blat-alat)*364000e0,2))/10 l FROM seg
  WHERE (seg_id % 2 = 0 AND (a % 40) % 3 = 0 AND floor(a/40) % 3 < 2) OR (seg_id % 2 = 1 AND floor(a/40) % 3 = 0 AND (a % 40) % 3 < 2)),
e AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s),
r AS (SELECT DISTINCT a node, a seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) component FROM r GROUP BY node),
dg AS (SELECT x node, count(*) g, sum(l) l FROM (SELECT a x, l FROM s UNION ALL SELECT b, l FROM s) GROUP BY x),
k AS (SELECT component FROM c JOIN dg USING (node) GROUP BY component HAVING count(*) BETWEEN 3 AND 6 AND min(g) = 2 AND max(g) = 2 AND sum(l)/2 <= 200),
p AS (SELECT component, lon, lat FROM c JOIN k USING (component) JOIN nodes ON node_id = node),
w AS (SELECT x.component FROM p x JOIN p y USING (component) GROUP BY 1 HAVING max(sqrt(pow((y.lon-x.lon)*245000e0,2)+pow((y.lat-x.lat)*364000e0,2))/10) <= 60)
SELECT component, count(*) n, round(avg(lon), 8) lon, round(avg(lat), 8) lat FROM p JOIN w USING (component) GROUP BY component"""


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    d = relation(spark, folder, "dir").withColumn("flagged", F.col("is_bridge") | F.col("is_tunnel") | (F.coalesce(F.col("layer") != 0, F.lit(False))) | (F.col("seg_id") % 4 == 0))
    return audit.distinct_segments(d.select("edge_id", "src", "dst", "seg_id", "is_bridge", "is_tunnel", "layer", "street", "len_ft", "flagged"))


_GROUPS = ctes("dir") + """,
fs AS (SELECT * FROM (SELECT edge_id, least(src, dst) u, greatest(src, dst) v, is_bridge, is_tunnel, layer, street, len_ft, is_bridge OR is_tunnel OR coalesce(layer <> 0, false) OR seg_id % 4 = 0 flagged,
  row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY edge_id) n FROM dir) WHERE n = 1),
ge AS (SELECT u a, v b FROM fs WHERE flagged UNION ALL SELECT v, u FROM fs WHERE flagged),
gr AS (SELECT DISTINCT a node, a seen FROM ge UNION SELECT gr.node, ge.b FROM gr JOIN ge ON ge.a = gr.seen),
gl AS (SELECT node, min(seen) grp FROM gr GROUP BY node),
gs AS (SELECT fs.*, grp FROM fs JOIN gl ON node = u WHERE flagged)"""


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    return audit.segment_groups(_flagged(spark, folder).filter("flagged"))


def group_signals(spark: SparkSession, folder: str) -> DataFrame:
    return audit.group_signals(_grouped(spark, folder))


GROUP_SIGNALS = _GROUPS + """,
ly AS (SELECT grp, layer, count(*) n, min(edge_id) f FROM gs WHERE NOT is_bridge AND NOT is_tunnel AND layer <> 0 GROUP BY grp, layer),
lm AS (SELECT grp, layer FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) r FROM ly) WHERE r = 1),
a AS (SELECT grp, count(*) n, count(CASE WHEN is_bridge THEN 1 END) bridges, count(CASE WHEN is_tunnel AND NOT is_bridge THEN 1 END) tunnels FROM gs GROUP BY grp)
SELECT a.grp, n, bridges, tunnels, layer layer_mode, CASE WHEN bridges > 0 AND tunnels = 0 THEN greatest(1, coalesce(layer, 1)) WHEN tunnels > 0 AND bridges = 0 THEN least(-1, coalesce(layer, -1)) ELSE layer END AS rank
FROM a LEFT JOIN lm ON lm.grp = a.grp"""


def group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return audit.size_histogram(_grouped(spark, folder))


GROUP_SIZES = _GROUPS + " SELECT size, count(*) n_groups FROM (SELECT grp, count(*) size FROM gs GROUP BY grp) GROUP BY size"


def largest_groups(spark: SparkSession, folder: str) -> DataFrame:
    return audit.largest_groups(_grouped(spark, folder))


LARGEST_GROUPS = _GROUPS + """,
t AS (SELECT grp, count(*) size, round(sum(len_ft), 3) feet, CAST(sum(is_bridge::INT) AS BIGINT) bridges FROM gs GROUP BY grp ORDER BY size DESC, grp LIMIT 15),
n AS (SELECT grp, street, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, street) r FROM gs WHERE street IS NOT NULL GROUP BY grp, street)
SELECT t.*, names FROM t LEFT JOIN (SELECT grp, string_agg(street, '|' ORDER BY r) names FROM n WHERE r <= 8 GROUP BY grp) USING (grp)"""


def boundaries(spark: SparkSession, folder: str) -> DataFrame:
    return audit.boundary_nodes(_flagged(spark, folder))


BOUNDARIES = _GROUPS + " SELECT node, bool_or(NOT flagged) boundary FROM (SELECT u node, flagged FROM fs UNION ALL SELECT v, flagged FROM fs) GROUP BY node HAVING bool_or(flagged)"


def length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return audit.histogram(relation(spark, folder, "sega"), "len_ft", [200.0, 250.0, 300.0, 360.0])


LENGTH_HISTOGRAM = ctes("sega") + " SELECT CASE WHEN len_ft <= 200 THEN 0 WHEN len_ft <= 250 THEN 1 WHEN len_ft <= 300 THEN 2 WHEN len_ft <= 360 THEN 3 ELSE 4 END bin, count(*) n FROM sega GROUP BY 1"


def group_stacks(spark: SparkSession, folder: str) -> DataFrame:
    rows = relation(spark, folder, "lineitem").select(F.col("l_partkey").alias("point"), (F.col("l_suppkey") % 7).alias("grp"))
    return audit.stacks(rows, "point", "grp")


GROUP_STACKS = "SELECT l_partkey point, count(DISTINCT l_suppkey % 7) n_groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 7) >= 3 ORDER BY 2 DESC, 1 LIMIT 20"


def route_overlap(spark: SparkSession, folder: str) -> DataFrame:
    sets = relation(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 9).alias("s"))
    a = sets.select(F.col("l_orderkey").alias("a"), F.col("s").alias("x"))
    b = sets.select((F.col("l_orderkey") - 1).alias("a"), F.col("s").alias("y"))
    return a.join(b, "a").select("a", F.round(audit.overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


ROUTE_OVERLAP = """
WITH s AS (SELECT l_orderkey k, list_distinct(array_agg(l_partkey % 9)) s FROM lineitem GROUP BY 1)
SELECT x.k a, round(len(list_intersect(x.s, y.s)) / least(len(x.s), len(y.s)), 6) overlap FROM s x JOIN s y ON y.k = x.k + 1"""


def _manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    d = relation(spark, folder, "documents").filter(F.col("doc_id") % 10 != version)
    edited = F.when(F.col("doc_id") % 7 == version, F.lit(f"v{version}")).otherwise(F.lit(""))
    return d.select(F.concat(F.lit("/data/"), F.col("doc_id").cast("string")).alias("url"), F.substring(F.sha2(F.concat("text", edited), 256), 1, 16).alias("hash"), F.octet_length("text").cast("long").alias("size"))


def sync_plan(spark: SparkSession, folder: str) -> DataFrame:
    return audit.manifest_diff(_manifest(spark, folder, 0), _manifest(spark, folder, 1)).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.min("url").alias("first_url"), F.max("hash").alias("last_hash"))


def _files(version: int) -> str:
    return f"SELECT '/data/' || doc_id url, substr(sha256(text || CASE WHEN doc_id % 7 = {version} THEN 'v{version}' ELSE '' END), 1, 16) hash, octet_length(encode(text)) size FROM documents WHERE doc_id % 10 <> {version}"


SYNC_PLAN = f"WITH o AS ({_files(0)}), n AS ({_files(1)}) SELECT count(*) n_files, CAST(sum(size) AS BIGINT) n_bytes, min(url) first_url, max(hash) last_hash FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.url = n.url AND o.hash = n.hash)"


def layer_visibility(spark: SparkSession, folder: str) -> DataFrame:
    n = relation(spark, folder, "nation")
    layers = n.select(F.col("n_nationkey").alias("layer"), F.explode(F.array(F.col("n_regionkey"), F.col("n_nationkey") % 3 + 10)).alias("grp"))
    checked = relation(spark, folder, "region").select(F.col("r_regionkey").alias("grp"), (F.col("r_regionkey") % 2 == 0).alias("checked"))
    return audit.visible(layers, checked)


LAYER_VISIBILITY = "SELECT n_nationkey layer, n_regionkey % 2 = 0 visible FROM nation"


def deduplicated_addresses(spark: SparkSession, folder: str) -> DataFrame:
    rows = relation(spark, folder, "addresses").select(F.col("addr_id").alias("ord"), F.when(F.col("addr_id") % 4 == 0, F.upper("label")).otherwise(F.col("label")).alias("label"), F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"))
    both = rows.union(rows.withColumn("ord", F.col("ord") + 1_000_000).withColumn("label", F.lower("label")))
    return audit.first_by_place(both, [F.col("label")], "ord").select("ord", "label")


DEDUPLICATED_ADDRESSES = ctes("addresses") + """,
r AS (SELECT addr_id ord, CASE WHEN addr_id % 4 = 0 THEN upper(label) ELSE label END label, round(lon, 3) lon, round(lat, 3) lat FROM addresses),
b AS (SELECT * FROM r UNION ALL SELECT ord + 1000000, lower(label), lon, lat FROM r)
SELECT ord, label FROM (SELECT *, row_number() OVER (PARTITION BY lower(label), round(lon, 5), round(lat, 5) ORDER BY ord) n FROM b) WHERE n = 1"""


def geometry_sharing(spark: SparkSession, folder: str) -> DataFrame:
    d = relation(spark, folder, "dir").select(F.array(F.struct(F.col("slon").alias("lon"), F.col("slat").alias("lat")), F.struct(F.col("dlon").alias("lon"), F.col("dlat").alias("lat"))).alias("points"))
    s = audit.shared_geometries(d)
    return s.select(F.round(F.get("points", 0)["lon"], 6).alias("lon"), F.round(F.get("points", 0)["lat"], 6).alias("lat"), F.round(F.get("points", 1)["lon"], 6).alias("lon2"), "n")


GEOMETRY_SHARING = ctes("dir") + """,
g AS (SELECT CASE WHEN slon < dlon OR (slon = dlon AND slat <= dlat) THEN [slon, slat, dlon] ELSE [dlon, dlat, slon] END p, seg_id FROM dir)
SELECT round(p[1], 6) lon, round(p[2], 6) lat, round(p[3], 6) lon2, count(*) n FROM g GROUP BY p, seg_id"""

PLANS = {
    "components": (components, COMPONENTS), "reach": (reach, REACH), "approach_edges": (approach_edges, APPROACH_EDGES), "isoline_splits": (isoline_splits, ISOLINE_SPLITS),
    "small_rings": (small_rings, SMALL_RINGS), "group_signals": (group_signals, GROUP_SIGNALS), "group_sizes": (group_sizes, GROUP_SIZES), "largest_groups": (largest_groups, LARGEST_GROUPS),
    "boundaries": (boundaries, BOUNDARIES), "length_histogram": (length_histogram, LENGTH_HISTOGRAM), "group_stacks": (group_stacks, GROUP_STACKS), "route_overlap": (route_overlap, ROUTE_OVERLAP),
    "sync_plan": (sync_plan, SYNC_PLAN), "layer_visibility": (layer_visibility, LAYER_VISIBILITY), "deduplicated_addresses": (deduplicated_addresses, DEDUPLICATED_ADDRESSES), "geometry_sharing": (geometry_sharing, GEOMETRY_SHARING),
}
