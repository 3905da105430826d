"""Plans of the scalar functions: geometry, tags, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.functions import geo, tags, text
from lanegraph.plans.fixtures import ctes, relation


def geodesy(spark: SparkSession, folder: str) -> DataFrame:
    """Distances and bearings of every segment."""
    p = (F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat"))
    b = geo.bearing(*p)
    return relation(spark, folder, "seg").select(
        "seg_id",
        F.round(geo.haversine_ft(*p), 3).alias("metric_ft"),
        F.round(geo.haversine_ft_profile(*p), 3).alias("profile_ft"),
        F.round(geo.planar_ft(*p), 3).alias("planar_ft"),
        F.round(b, 4).alias("bearing"),
        geo.heading_name(F.round(b, 4)).alias("heading"),
        geo.compass8(F.round(b, 4)).alias("sector"),
    )


GEODESY = ctes("seg") + """,
s AS (SELECT *, radians(blat)-radians(alat) dy, radians(blon)-radians(alon) dx FROM seg),
h AS (SELECT *, 2*asin(sqrt(pow(sin(dy/2),2)+cos(radians(alat))*cos(radians(blat))*pow(sin(dx/2),2))) arc,
  degrees(atan2(sin(dx)*cos(radians(blat)), cos(radians(alat))*sin(radians(blat))-sin(radians(alat))*cos(radians(blat))*cos(dx)))+360 b0 FROM s),
g AS (SELECT *, round(b0 - 360*floor(b0/360), 4) brg FROM h)
SELECT seg_id, round(6371000e0*arc*3.28084e0, 3) metric_ft, round(20902231e0*arc, 3) profile_ft,
  round(sqrt(pow((blon-alon)*245000e0,2)+pow((blat-alat)*364000e0,2)), 3) planar_ft, brg bearing,
  (['north','northeast','east','southeast','south','southwest','west','northwest'])[1 + CAST(floor(brg/45+0.5) AS INT) % 8] heading,
  (['north','northeast','east','southeast','south','southwest','west','northwest'])[1 + CAST(floor((brg+22.5)/45) AS INT) % 8] sector
FROM g"""


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns between pairs of bearings; sides and stop facings."""
    o = relation(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 37) % 360).cast("double").alias("a"), ((F.col("o_orderkey") * 91) % 360).cast("double").alias("b"), ((F.col("o_orderkey") % 4096) * 16).alias("flags")
    )
    a, b = F.col("a"), F.col("b")
    return o.select(
        "id",
        geo.turn_delta(a, b).alias("delta"),
        geo.axis_angle(a, b).alias("axis"),
        geo.classify_turn(a, b, F.col("id") % 5 == 0).alias("turn"),
        geo.sidewalk_side(a, b).alias("side"),
        geo.stop_faces(F.col("flags"), a).alias("stops"),
    )


TURNS = """
WITH o AS (SELECT o_orderkey id, ((o_orderkey*37) % 360)::DOUBLE a, ((o_orderkey*91) % 360)::DOUBLE b, (o_orderkey % 4096)*16 flags FROM orders),
d AS (SELECT *, fmod(b-a+540, 360)-180 delta, fmod(b-a+360, 360) rel FROM o)
SELECT id, delta, CASE WHEN abs(delta) > 90 THEN 180-abs(delta) ELSE abs(delta) END axis,
  CASE WHEN abs(delta) <= 30 THEN 'Continue'
    WHEN id % 5 = 0 THEN (CASE WHEN abs(delta) >= 110 THEN 'Make a ' ELSE 'Turn ' END) || (CASE WHEN delta < 0 THEN 'left' ELSE 'right' END) || ' at the traffic circle'
    ELSE (CASE WHEN abs(delta) >= 110 THEN 'Sharp ' WHEN abs(delta) >= 60 THEN 'Turn ' ELSE 'Slight ' END) || (CASE WHEN delta < 0 THEN 'left' ELSE 'right' END) END turn,
  CASE WHEN rel < 5 OR rel > 355 OR (rel > 175 AND rel < 185) THEN NULL WHEN rel < 180 THEN 'right' ELSE 'left' END side,
  (flags >> (4 + CAST(floor(a/45+0.5) AS BIGINT) % 8)) & 1 = 1 stops
FROM d"""


def _tag_map() -> F.Column:
    names = ("highway", "bicycle", "access", "footway", "junction")
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])


def way_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Access and attribute rules over tag maps."""
    w = relation(spark, folder, "ways").withColumn("tags", _tag_map())
    t = F.col("tags")
    return w.select(
        "way_id",
        tags.is_never(t).alias("never"),
        tags.is_routable(t).alias("routable"),
        tags.is_sidewalk(t).alias("sidewalk"),
        tags.is_circle(t).alias("circle"),
        tags.direction(F.col("oneway"), F.col("street_oneway")).alias("direction"),
        tags.is_set(F.col("bridge")).alias("is_bridge"),
        tags.whole_number(F.col("layer")).alias("layer"),
        tags.lanes_of_width(F.col("width")).alias("width_lanes"),
        tags.lanes(F.col("width"), F.col("arterial")).alias("lanes"),
        tags.facility_class(F.col("status"), F.col("category")).alias("facility"),
        tags.network_class(F.col("network")).alias("network_facility"),
        tags.facility_layer(F.col("status"), F.col("category")).alias("layer_name"),
        tags.is_proposed(F.col("network")).alias("proposed"),
    )


WAY_TAGS = ctes("ways") + """
SELECT way_id, coalesce(highway IN ('motorway','construction'), false) AS never,
  CASE WHEN highway IS NULL OR highway IN ('motorway','construction') OR bicycle IS NOT DISTINCT FROM 'no' THEN false
    WHEN access IN ('no','private') AND (bicycle IS NULL OR bicycle NOT IN ('yes','designated','permissive')) THEN false
    WHEN highway IN ('residential','tertiary','primary','cycleway') THEN true
    WHEN highway = 'footway' AND footway IN ('sidewalk','crossing') THEN true
    WHEN highway IN ('path','footway','track','pedestrian','service') THEN coalesce(bicycle IN ('yes','designated'), false) ELSE false END routable,
  coalesce(highway = 'footway' AND footway IN ('sidewalk','crossing'), false) sidewalk,
  coalesce(highway = 'mini_roundabout', false) OR junction IS NOT NULL circle,
  CASE WHEN oneway IN ('-1','reverse') THEN 'reverse' WHEN oneway IN ('yes','1') THEN 'forward' WHEN oneway = 'no' THEN 'bidir'
    WHEN street_oneway = 'Y' THEN 'forward' ELSE 'bidir' END direction,
  coalesce(lower(trim(bridge)) NOT IN ('','no'), false) is_bridge, try_cast(trim(layer) AS INT) layer,
  CASE WHEN try_cast(width AS DOUBLE) > 0 THEN greatest(1e0, (try_cast(width AS DOUBLE)-7.5)/10) END width_lanes,
  coalesce(CASE WHEN try_cast(width AS DOUBLE) > 0 THEN greatest(1e0, (try_cast(width AS DOUBLE)-7.5)/10) END,
    CASE try_cast(arterial AS INT) WHEN 1 THEN 4e0 WHEN 2 THEN 3e0 WHEN 3 THEN 2.5e0 WHEN 9 THEN 3e0 ELSE 2e0 END) lanes,
  CASE WHEN status <> 'UNDERCONS' AND category <> 'BKF-XYZ' THEN category END facility,
  CASE network WHEN 'Existing Bike+ - Arterial' THEN 'BKF-PBL' WHEN 'Existing Bike+ - Non-Arterial' THEN 'BKF-NGW' WHEN 'Existing Multi-Use Trail' THEN 'BKF-OFFST' END network_facility,
  (CASE WHEN status = 'UNDERCONS' THEN 'construction-' ELSE '' END) ||
    CASE WHEN category IN ('BKF-NGW','BKF-PBL','BKF-OFFST') THEN 'aaa' WHEN category = 'BKF-BBL' THEN 'bbl' WHEN category = 'BKF-BL' THEN 'bl' WHEN category IN ('BKF-CLMB','BKF-SHW') THEN 'narrow' END layer_name,
  coalesce(network = 'Proposed Multi-Use Trail', false) proposed
FROM ways"""


def edge_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Edge flags, categories and correction targets."""
    d = relation(spark, folder, "dir")
    names = ("has_centerline", "is_oneway", "is_bridge", "is_tunnel", "is_covered", "is_indoor", "is_embankment", "is_cutting", "is_sidewalk")
    f = d.withColumn("flags", tags.pack_flags({n: F.col(n) for n in names}))
    own = [F.col(n) for n in ("is_bridge", "is_tunnel", "layer", "is_embankment", "is_cutting", "is_covered", "is_indoor")]
    return f.select(
        "edge_id",
        "flags",
        tags.source_category(*own).alias("source"),
        tags.source_priority(tags.source_category(*own)).alias("priority"),
        tags.has_level(F.col("is_bridge"), F.col("is_tunnel"), F.col("is_covered"), F.col("is_indoor"), F.col("layer")).alias("tagged"),
        tags.needs_correction(F.col("flags"), F.col("layer")).alias("target"),
        tags.edge_category(F.col("flags"), F.col("layer")).alias("category"),
    )


EDGE_FLAGS = ctes("dir") + """,
f AS (SELECT *, has_centerline::INT + 2*is_oneway::INT + 4*is_bridge::INT + 8*is_tunnel::INT + 16*is_covered::INT + 32*is_indoor::INT
  + 256*is_embankment::INT + 512*is_cutting::INT + 1024*is_sidewalk::INT flags,
  CASE WHEN is_bridge THEN 'bridge' WHEN is_tunnel THEN 'tunnel' WHEN layer <> 0 THEN 'layered' WHEN is_embankment THEN 'embankment'
    WHEN is_cutting THEN 'cutting' WHEN is_covered THEN 'covered' WHEN is_indoor THEN 'indoor' END source FROM dir)
SELECT edge_id, flags, source, CASE source WHEN 'bridge' THEN 0 WHEN 'tunnel' THEN 1 WHEN 'layered' THEN 2 WHEN 'embankment' THEN 3 WHEN 'cutting' THEN 4 WHEN 'covered' THEN 5 WHEN 'indoor' THEN 6 END priority,
  is_bridge OR is_tunnel OR is_covered OR is_indoor OR layer IS NOT NULL tagged,
  is_bridge OR is_tunnel OR (coalesce(layer <> 0, false) AND NOT is_embankment AND NOT is_cutting) target,
  CASE WHEN is_bridge THEN 'bridge' WHEN is_tunnel THEN 'tunnel' WHEN layer <> 0 THEN 'layered(' || (CASE WHEN layer > 0 THEN '+' ELSE '' END) || layer || ')' ELSE 'other' END category
FROM f"""


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Names, addresses, numbers and codes as people read them."""
    o = relation(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 10).alias("v"))
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("id") % len(xs) + 1).cast("int"))
    name = F.concat(pick("Northeast 65th ", "north ", "Westlake ", "East ", ""), pick("Street", "Avenue", "Boulevard", "Streetside", "Way", "Lane", "road"), pick("", " Southwest", " bike lane", " North"))
    x = o.withColumn("name", name).withColumn("phone", pick("206-555-1234", "5551234", "(425) 555 9999", "911", "")).withColumn("raw", pick('a <b> & "c"', "  ", "plain", " x&y "))
    x = x.withColumn("cat", pick("amenity=bike_parking", "shop=book_store", "none")).withColumn("url", pick("/data/a.json", "/b.geojson", "/tiles.pmtiles", "/x.bin")).withColumn("code", pick("BKF-BL", "ZZ", ""))
    return x.select(
        "id",
        text.normalize_address(F.col("name")).alias("address"),
        text.abbreviate_label(F.col("name")).alias("label"),
        text.base_name(F.col("name")).alias("base"),
        text.title_case(F.col("name")).alias("title"),
        text.format_distance(F.floor(F.col("v")) + 3).alias("distance"),
        text.format_phone(F.col("phone")).alias("phone"),
        text.escape_html(F.col("raw")).alias("html"),
        text.category_words(F.col("cat")).alias("category"),
        text.content_type(F.col("url")).alias("mime"),
        text.decode({"BKF-BL": "Bike lane", "BKF-PBL": "Protected bike lane"}, F.col("code")).alias("decoded"),
        text.place_label(F.col("id") / -1000, F.col("id") / 2000).alias("place"),
        text.format_bytes(F.col("id") * F.col("id") * 37).alias("bytes"),
        F.date_format(text.version_time(pick("20260525-155452", "bad", "20250101-000000")), "yyyy-MM-dd").alias("day"),
        F.round(tags.by_zoom((F.col("id") % 20).cast("double"), [(10, 1.5), (14, 3.5)]), 6).alias("width"),
        tags.slope_class((F.col("id") % 57 - 28).cast("double")).alias("slope"),
    )


_DIRS = "Northwest|Northeast|Southwest|Southeast|North|South|East|West"


def _nested(expr: str, pairs, pattern: str, options: str) -> str:
    for full, short in pairs:
        expr = f"regexp_replace({expr}, '{pattern.format(full)}', '{short}', '{options}')"
    return expr


LABELS = """
WITH o AS (SELECT o_orderkey id, o_totalprice/10 v FROM orders),
x AS (SELECT *, (['Northeast 65th ','north ','Westlake ','East ',''])[1+id%5] || (['Street','Avenue','Boulevard','Streetside','Way','Lane','road'])[1+id%7] || (['',' Southwest',' bike lane',' North'])[1+id%4] AS name,
  (['206-555-1234','5551234','(425) 555 9999','911',''])[1+id%5] phone, (['a <b> & "c"','  ','plain',' x&y '])[1+id%4] raw,
  (['amenity=bike_parking','shop=book_store','none'])[1+id%3] cat, (['/data/a.json','/b.geojson','/tiles.pmtiles','/x.bin'])[1+id%4] url, (['BKF-BL','ZZ',''])[1+id%3] code,
  (['20260525-155452','bad','20250101-000000'])[1+id%3] ver, id*id*37 nb, (id % 20)::DOUBLE z, abs(id % 57 - 28) sl FROM o),
l1 AS (SELECT *, """ + _nested("name", text.DIRECTIONS, "^{} ", "") .replace("', 'NW', '')", "', 'NW ', '')").replace("', 'NE', '')", "', 'NE ', '')").replace("', 'SW', '')", "', 'SW ', '')").replace("', 'SE', '')", "', 'SE ', '')").replace("', 'N', '')", "', 'N ', '')").replace("', 'S', '')", "', 'S ', '')").replace("', 'E', '')", "', 'E ', '')").replace("', 'W', '')", "', 'W ', '')") + """ lead FROM x),
l2 AS (SELECT *, """ + _nested("lead", [(f, f" {s}\\1") for f, s in text.STREET_WORDS], " {}(( (" + _DIRS + "))?)$", "") + """ mid FROM l1)
SELECT id, """ + _nested("name", text.DIRECTIONS + text.STREET_WORDS, r"\b{}\b", "gi") + """ address,
  """ + _nested("mid", [(f, f" {s}") for f, s in text.DIRECTIONS], " {}$", "") + """ label,
  trim(regexp_replace(lower(trim(name)), ' (protected bike lane|bike lane|bike path|cycle track|cycletrack|cycleway)$', '')) base,
  array_to_string(list_transform(string_split(lower(name), ' '), lambda w: CASE WHEN w IN ('n','s','e','w','nw','ne','sw','se') THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ') title,
  CASE WHEN floor(v)+3 < 528 THEN CAST(floor((floor(v)+3)/10+0.5)*10 AS BIGINT) || ' ft' ELSE printf('%.2f mi', floor((floor(v)+3)*100/5280+0.5)/100) END distance,
  CASE phone WHEN '206-555-1234' THEN '(206) 555-1234' WHEN '5551234' THEN '(206) 555-1234' WHEN '(425) 555 9999' THEN '(425) 555-9999' WHEN '' THEN NULL ELSE phone END phone,
  CASE id % 4 WHEN 0 THEN 'a &lt;b&gt; &amp; &quot;c&quot;' WHEN 2 THEN 'plain' WHEN 3 THEN 'x&amp;y' END html,
  replace(CASE WHEN strpos(cat, '=') > 0 THEN split_part(cat, '=', 2) ELSE cat END, '_', ' ') category,
  CASE WHEN ends_with(url, 'json') THEN 'application/json' ELSE 'application/octet-stream' END mime,
  CASE code WHEN 'BKF-BL' THEN 'Bike lane' WHEN '' THEN NULL ELSE code END decoded,
  printf('%.5f, %.5f', id/2000, id/-1000) place,
  CASE WHEN nb < 1024 THEN nb || ' B' WHEN nb < 1048576 THEN printf('%.0f KB', round(nb/1024)) ELSE printf('%.1f MB', round(nb/1048576, 1)) END bytes,
  CASE WHEN ver <> 'bad' THEN ver[1:4] || '-' || ver[5:6] || '-' || ver[7:8] END AS day,
  round(CASE WHEN z <= 10 THEN 1.5e0 WHEN z <= 14 THEN 1.5e0 + (z-10)*2/4 ELSE 3.5e0 END, 6) width,
  CASE WHEN sl < 1 THEN 0 WHEN sl < 3 THEN 1 WHEN sl < 6 THEN 2 WHEN sl < 10 THEN 3 WHEN sl < 15 THEN 4 WHEN sl < 20 THEN 5 ELSE 6 END slope
FROM l2"""

PLANS = {"geodesy": (geodesy, GEODESY), "turns": (turns, TURNS), "way_tags": (way_tags, WAY_TAGS), "edge_flags": (edge_flags, EDGE_FLAGS), "labels": (labels, LABELS)}
