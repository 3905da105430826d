"""Distances spread over a graph: bounded search from many sources, approaches, isoline splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.functions import tags
from lanegraph.stage import discard, materialize


def spread(edges: DataFrame, seeds: DataFrame, limit: float) -> DataFrame:
    """Nearest seed of every node within ``limit``: node_id, dist, priority, category.

    ``edges`` (u, v, len) are walked both ways; seeds are (node_id, category). Each round only
    the nodes that improved go on, and a node keeps its least (distance, priority), so there
    are as many rounds as hops to the limit. All state is in stage tables.
    """
    both = edges.select("u", "v", "len").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "len"))
    adjacent = materialize(both.groupBy("u", "v").agg(F.min("len").alias("len")).filter("u <> v"), "adjacent")
    best = F.min(F.struct("dist", "priority", "category"))
    first = seeds.select("node_id", F.lit(0.0).alias("dist"), tags.source_priority(F.col("category")).alias("priority"), "category")
    reach = materialize(first.groupBy("node_id").agg(best.alias("b")).select("node_id", "b.*"), "reach")
    front = reach
    while True:
        step = front.join(adjacent, front["node_id"] == adjacent["u"]).select(F.col("v").alias("node_id"), (F.col("dist") + F.col("len")).alias("dist"), "priority", "category").filter(F.col("dist") <= limit)
        step = step.groupBy("node_id").agg(best.alias("b"))
        old = reach.select("node_id", F.struct("dist", "priority", "category").alias("o"))
        fresh = materialize(step.join(old, "node_id", "left").filter("o is null or b < o").select("node_id", "b.*"), "reach-new")
        if fresh.isEmpty():
            discard(fresh, adjacent)
            return reach
        merged = materialize(reach.join(fresh, "node_id", "left_anti").unionByName(fresh), "reach")
        reach, front = merged, fresh


def approaches(edges: DataFrame, reach: DataFrame, limit: float) -> DataFrame:
    """Untagged edges in reach: kind full (both ends) or partial (one), category, and for partial ones close, far and cut_ft."""
    a = reach.select(F.col("node_id").alias("src"), F.struct("dist", "priority", "category").alias("x"))
    b = reach.select(F.col("node_id").alias("dst"), F.struct("dist", "priority", "category").alias("y"))
    e = edges.filter("source is null").join(a, "src", "left").join(b, "dst", "left").filter("x is not null or y is not null")
    full = F.col("x").isNotNull() & F.col("y").isNotNull()
    near = F.when(full, F.least("x", "y")).otherwise(F.coalesce("x", "y"))
    part = ~full
    return e.select(
        "edge_id", F.when(full, "full").otherwise("partial").alias("kind"), near["category"].alias("category"),
        F.when(part, F.when(F.col("x").isNotNull(), F.col("src")).otherwise(F.col("dst"))).alias("close"), F.when(part, F.when(F.col("x").isNotNull(), F.col("dst")).otherwise(F.col("src"))).alias("far"),
        F.when(part, limit - near["dist"]).alias("cut_ft"),
    )


def split_at_isoline(segs: DataFrame, partial: DataFrame, least_ft: float = 1.0, base: int = 10**15) -> DataFrame:
    """Segments (seg_id, a, b, len_ft) with those in ``partial`` (seg_id, close, far, cut_ft) cut at cut_ft from their close end.

    Cuts within least_ft of the close end leave the segment as it is, unflagged; within
    least_ft of the far end they flag it whole. New nodes are numbered from ``base`` by
    segment, so both directions of a street share one.
    """
    p = segs.join(partial, "seg_id", "left")
    whole = F.when(F.col("cut_ft").isNull() | (F.col("cut_ft") < least_ft), F.lit(False)).when(F.col("len_ft") - F.col("cut_ft") < least_ft, F.lit(True))
    mid = F.lit(base) + F.col("seg_id")
    part = lambda a, b, feet, flag: F.struct(a.alias("a"), b.alias("b"), feet.alias("len_ft"), flag.alias("approach"))
    near, rest = F.col("cut_ft"), F.col("len_ft") - F.col("cut_ft")
    forward = F.array(part(F.col("a"), mid, near, F.lit(True)), part(mid, F.col("b"), rest, F.lit(False)))
    back = F.array(part(F.col("a"), mid, rest, F.lit(False)), part(mid, F.col("b"), near, F.lit(True)))
    pieces = F.when(whole.isNotNull(), F.array(part(F.col("a"), F.col("b"), F.col("len_ft"), whole))).when(F.col("close") == F.col("a"), forward).otherwise(back)
    return p.select("seg_id", F.posexplode(pieces).alias("piece", "_cut")).select("seg_id", "piece", "_cut.*")


def rings(short: DataFrame, components: DataFrame, nodes: DataFrame, length, most_ft: float = 200.0, wide_ft: float = 60.0) -> DataFrame:
    """Centres of small closed rings: components of short edges (a, b, len_ft) of 3 to 6 nodes, all of degree
    two, at most most_ft around and wide_ft across (``length``: distance of two lon, lat pairs)."""
    ends = short.select(F.col("a").alias("node"), "len_ft").union(short.select(F.col("b").alias("node"), "len_ft"))
    degree = ends.groupBy("node").agg(F.count("*").alias("deg"), F.sum("len_ft").alias("len")).join(components, "node")
    small = degree.groupBy("component").agg(F.count("*").alias("n"), F.min("deg").alias("lo"), F.max("deg").alias("hi"), (F.sum("len") / 2).alias("perimeter"))
    small = small.filter(F.col("n").between(3, 6) & (F.col("lo") == 2) & (F.col("hi") == 2) & (F.col("perimeter") <= most_ft)).select("component")
    at = components.join(small, "component").join(nodes.select(F.col("node_id").alias("node"), "lon", "lat"), "node")
    pairs = at.alias("p").join(at.alias("q"), "component").select("component", length(F.col("p.lon"), F.col("p.lat"), F.col("q.lon"), F.col("q.lat")).alias("d"))
    wide = pairs.groupBy("component").agg(F.max("d").alias("d")).filter(F.col("d") <= wide_ft).select("component")
    return at.join(wide, "component").groupBy("component").agg(F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
