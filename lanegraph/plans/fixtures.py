"""A synthetic street map derived from the tables of a dataset folder.

Each relation is SQL that Spark and DuckDB read alike; ``{name}`` stands for another relation.
Spark plans take relations as DataFrames, oracles as common table expressions of the same text.
Coordinates are integer microdegrees divided once, so both engines hold equal doubles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lanegraph.tables import table

TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "nation", "region")

RELATIONS = {
    # a lattice of 40 columns, jittered
    "nodes": """
select c_custkey node_id, (c_custkey % 40)*1000 + (c_custkey*7919) % 300 x_u,
  cast((c_custkey - c_custkey % 40)/40 as bigint)*1000 + (c_custkey*104729) % 300 y_u,
  cast(-122440000 + (c_custkey % 40)*1000 + (c_custkey*7919) % 300 as double)/1e6 lon,
  cast(47500000 + cast((c_custkey - c_custkey % 40)/40 as bigint)*1000 + (c_custkey*104729) % 300 as double)/1e6 lat,
  cast(10*((c_custkey*613) % 40) as double) elev_ft,
  c_custkey % 17 = 0 has_signal, c_custkey % 23 = 0 has_crosswalk, c_custkey % 29 = 0 has_beacon, c_custkey % 19 = 0 is_circle,
  cast((c_custkey * 37) % 256 as bigint) stop_bits
from {customer}""",
    # right and down neighbours; about one in seventeen is missing
    "seg": """
select 2*u.node_id + d.dir seg_id, u.node_id a, v.node_id b, u.lon alon, u.lat alat, v.lon blon, v.lat blat
from {nodes} u cross join (select 0 dir union all select 1) d
join {nodes} v on v.node_id = u.node_id + case when d.dir=0 then 1 else 40 end
where (d.dir=1 or u.node_id % 40 < 39) and (2*u.node_id + d.dir)*31 % 17 <> 0""",
    # the same with about half missing: many components
    "islands": """
select 2*u.node_id + d.dir seg_id, u.node_id a, v.node_id b, u.lon alon, u.lat alat, v.lon blon, v.lat blat
from {nodes} u cross join (select 0 dir union all select 1) d
join {nodes} v on v.node_id = u.node_id + case when d.dir=0 then 1 else 40 end
where (d.dir=1 or u.node_id % 40 < 39) and (2*u.node_id + d.dir)*31 % 17 > 8""",
    "sega": """
select s.*, o.o_orderkey % 37 = 0 is_bridge, o.o_orderkey % 41 = 0 is_tunnel, o.o_orderkey % 11 = 0 is_sidewalk, o.o_orderkey % 5 = 1 is_oneway,
  o.o_orderkey % 43 = 0 is_embankment, o.o_orderkey % 47 = 0 is_cutting, o.o_orderkey % 53 = 0 is_covered, o.o_orderkey % 59 = 0 is_indoor,
  case when o.o_orderkey % 13 = 0 then cast(o.o_orderkey % 5 as int) - 2 else null end layer,
  case o.o_orderkey % 8 when 0 then 'BKF-PBL' when 1 then 'BKF-BBL' when 2 then 'BKF-BL' when 3 then 'BKF-SHW' else null end facility,
  case when o.o_orderkey % 6 = 0 then 'BKF-ONEWAY' else null end model,
  case when o.o_orderkey % 10 = 3 then null else concat(case o.o_orderkey % 3 when 0 then 'Northeast Oak Street' when 1 then 'Pine Avenue Bike Lane' else 'Lake Boulevard North' end) end street,
  o.o_orderkey % 3 = 0 has_centerline, 1 + cast(o.o_orderkey % 9 as double)/2 lanes,
  2*6371000e0*asin(sqrt(pow(sin((radians(blat)-radians(alat))/2),2)+cos(radians(alat))*cos(radians(blat))
    *pow(sin((radians(blon)-radians(alon))/2),2)))*3.28084e0 len_ft
from {seg} s join {orders} o on o.o_orderkey = s.seg_id""",
    "dir": """
select 2*seg_id + r.rev edge_id, seg_id, r.rev = 1 is_reverse, case when r.rev=0 then a else b end src, case when r.rev=0 then b else a end dst,
  case when r.rev=0 then alon else blon end slon, case when r.rev=0 then alat else blat end slat,
  case when r.rev=0 then blon else alon end dlon, case when r.rev=0 then blat else alat end dlat,
  is_bridge, is_tunnel, is_sidewalk, is_oneway, is_embankment, is_cutting, is_covered, is_indoor, layer, facility, model, street, has_centerline, lanes, len_ft
from {sega} cross join (select 0 rev union all select 1) r where r.rev=0 or not is_oneway""",
    # diagonals of every third cell, which cross without a shared node
    "diagonals": """
select 10000000 + 2*u.node_id + d.dir seg_id, case when d.dir=0 then u.node_id else r.node_id end a, case when d.dir=0 then w.node_id else v.node_id end b,
  case when d.dir=0 then u.x_u else r.x_u end ax, case when d.dir=0 then u.y_u else r.y_u end ay,
  case when d.dir=0 then w.x_u else v.x_u end bx, case when d.dir=0 then w.y_u else v.y_u end by_,
  u.node_id % 7 = 0 and d.dir = 0 tagged
from {nodes} u join {nodes} r on r.node_id = u.node_id + 1 join {nodes} v on v.node_id = u.node_id + 40 join {nodes} w on w.node_id = u.node_id + 41
cross join (select 0 dir union all select 1) d where u.node_id % 40 < 39 and u.node_id % 3 = 0""",
    "signs": """
select s_suppkey sign_id, n.lon + cast((s_suppkey*37) % 400 - 200 as double)/1e6 lon, n.lat + cast((s_suppkey*53) % 400 - 200 as double)/1e6 lat,
  case s_suppkey % 4 when 0 then 'signal' when 1 then 'crosswalk' when 2 then 'beacon' else 'stop' end kind,
  case s_suppkey % 9 when 0 then 'N' when 1 then 'ne ' when 2 then 'E' when 3 then 'SE' when 4 then 'S' when 5 then 'SW' when 6 then 'W' when 7 then 'NW' else '?' end facing
from {supplier} join {nodes} n on n.node_id = s_suppkey * 7""",
    "facilities": """
select s.seg_id fac_id, s.alon + cast((s.seg_id*13) % 160 - 80 as double)/1e6 x0, s.alat + cast((s.seg_id*29) % 160 - 80 as double)/1e6 y0,
  s.blon + cast((s.seg_id*13) % 160 - 80 as double)/1e6 x1, s.blat + cast((s.seg_id*29) % 160 - 80 as double)/1e6 y1,
  case s.seg_id % 5 when 0 then 'BKF-PBL' when 1 then 'BKF-BBL' when 2 then 'BKF-BL' when 3 then 'BKF-SHW' else 'BKF-NGW' end category,
  cast(20 + s.seg_id % 40 as double) width, cast(s.seg_id % 4 as int) arterial
from {seg} s where s.seg_id % 3 <> 1""",
    "addresses": """
select c_custkey addr_id, concat(cast(100 + c_custkey % 900 as varchar(10)), ' ', case c_custkey % 3 when 0 then 'Oak Street' when 1 then 'Pine Avenue Northeast' else 'North Lake Way' end) label, n.lon, n.lat
from {customer} join {nodes} n on n.node_id = c_custkey where c_custkey % 2 = 0""",
    "pois": """
select p_partkey poi_id, p_name name, concat('shop=', lower(replace(p_brand, '#', '_'))) category,
  n.lon + cast((p_partkey*71) % 1000 - 500 as double)/1e6 lon, n.lat + cast((p_partkey*113) % 1000 - 500 as double)/1e6 lat
from (select p.*, 1 + (p_partkey * 31) % (top - 1) home from {part} p cross join (select max(c_custkey) top from {customer})) q join {nodes} n on n.node_id = home""",
    # routes: consecutive nodes of a lattice row, climbing as the nodes do
    "route_points": """
select cast((node_id - node_id % 40)/40 as bigint) route_id, node_id % 40 seq, node_id, lon, lat, elev_ft from {nodes}""",
    "ways": """
select o_orderkey way_id,
  case o_orderkey % 14 when 0 then 'residential' when 1 then 'motorway' when 2 then 'cycleway' when 3 then 'footway' when 4 then 'path' when 5 then 'service' when 6 then 'primary'
    when 7 then 'construction' when 8 then 'tertiary' when 9 then 'track' when 10 then 'pedestrian' when 11 then 'mini_roundabout' when 12 then 'steps' else null end highway,
  case o_orderkey % 5 when 0 then 'yes' when 1 then 'no' when 2 then 'designated' when 3 then 'permissive' else null end bicycle,
  case o_orderkey % 7 when 0 then 'private' when 1 then 'no' when 2 then 'yes' else null end access,
  case o_orderkey % 4 when 0 then 'sidewalk' when 1 then 'crossing' when 2 then 'other' else null end footway,
  case o_orderkey % 9 when 0 then 'yes' when 1 then '-1' when 2 then 'no' when 3 then 'reverse' when 4 then '1' else null end oneway,
  case o_orderkey % 2 when 0 then 'Y' else 'N' end street_oneway,
  case o_orderkey % 6 when 0 then ' Yes ' when 1 then 'no' when 2 then '' when 3 then 'viaduct' else null end bridge,
  case o_orderkey % 8 when 0 then '1' when 1 then '-2' when 2 then 'x' when 3 then ' 0 ' else null end layer,
  case o_orderkey % 10 when 0 then '32.5' when 1 then 'wide' when 2 then '-3' when 3 then '8' when 4 then '' else null end width,
  case o_orderkey % 11 when 0 then '1' when 1 then '2' when 2 then '3' when 3 then '9' when 4 then '5' when 5 then 'a' when 6 then '0' else null end arterial,
  case o_orderkey % 12 when 0 then 'roundabout' when 1 then 'circular' else null end junction,
  case o_orderkey % 3 when 0 then 'INSVC' when 1 then 'UNDERCONS' else 'PLNRECON' end status,
  case o_orderkey % 13 when 0 then 'BKF-NGW' when 1 then 'BKF-PBL' when 2 then 'BKF-OFFST' when 3 then 'BKF-BBL' when 4 then 'BKF-BL' when 5 then 'BKF-CLMB' when 6 then 'BKF-SHW' when 7 then 'BKF-XYZ' else null end category,
  case o_orderkey % 6 when 0 then 'Existing Bike+ - Arterial' when 1 then 'Existing Bike+ - Non-Arterial' when 2 then 'Existing Multi-Use Trail' when 3 then 'Proposed Multi-Use Trail' when 4 then 'Non-Bike+' else null end network
from {orders}""",
}


def relation(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The relation as a DataFrame, from the dataset's tables.

    What it is made from grows with the tables and is joined by shuffles: Spark's estimate of a few columns
    of a large table is small enough to broadcast them, which sends them through the driver.
    """
    if name in TABLES:
        return table(spark, folder, name)
    used = {n: relation(spark, folder, n).hint("merge") for n in set(re.findall(r"\{(\w+)\}", RELATIONS[name]))}
    return spark.sql(RELATIONS[name], **used)


def ctes(*names: str) -> str:
    """WITH and the relations' SQL in the order they need each other, for an oracle to go on with."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done:
            return
        for n in dict.fromkeys(re.findall(r"\{(\w+)\}", RELATIONS[name])):
            add(n)
        done[name] = re.sub(r"\{(\w+)\}", r"\1", RELATIONS[name])

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({sql})" for n, sql in done.items())
