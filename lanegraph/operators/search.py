"""Prefix search over labels, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanegraph.functions import text
from lanegraph.operators.grid import quad_extent
from lanegraph.operators.ordered import dense_ids
from lanegraph.stage import discard, fresh_path, materialize, scoped

#: Shortest query, and how much a degree of longitude counts.
LEAST, LON_SHARE = 2, 0.7
#: Letters of a word under whose beginnings a label is filed.
STEM = 6
#: Folders of postings; lists up to SHORT are ranked whole; levels of cells tried, of a grid of 2**DEEP cells a side.
BUCKETS, SHORT, DEEP, LEVELS = 64, 256, 16, (8, 6, 4, 2)

_POSTINGS = "id bigint, kind string, ws array<string>, lon double, lat double, glon bigint, glat bigint, stem string, bucket int"
_STEMS = "stem string, kind string, n bigint, bucket int"


def search_index(pois: DataFrame, addresses: DataFrame) -> DataFrame:
    """Records with dense ids, points of interest first: id, kind, label, category, address, lon, lat."""
    p = pois.select(F.lit(0).alias("k"), F.col("poi_id").alias("own"), F.lit("p").alias("kind"), F.col("name").alias("label"), "category", "address", "addr_lon", "addr_lat", "lon", "lat")
    a = addresses.select(F.lit(1).alias("k"), F.col("addr_id").alias("own"), F.lit("a").alias("kind"), "label", "lon", "lat")
    both = p.unionByName(a, allowMissingColumns=True).withColumn("place", F.struct("k", "own"))
    return both.join(dense_ids(both, "place", "id"), "place").drop("place", "k")


def _tokens(label) -> F.Column:
    return F.array_distinct(F.filter(F.split(F.lower(text.normalize_address(label)), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def write_index(index: DataFrame, path: str) -> None:
    """Write the records and their postings, so that a search reads the lists of its words' beginnings and no others.

    A posting (stem, kind, place, id, words) lies in the folder of its stem's bucket, sorted by
    stem; the place is a cell of a grid of 2**DEEP by 2**DEEP over the records' extent, null
    for records without one.
    """
    index = materialize(index.withColumn("ws", _tokens(F.col("label"))), "search-index")
    box = quad_extent(index, "lon", "lat")
    index.drop("ws").repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/records")
    begun = lambda w: F.transform(F.sequence(F.lit(1), F.least(F.length(w), F.lit(STEM))), lambda n: F.substring(w, F.lit(1), n))
    cell = lambda c, lo: F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), _cell_at(F.col(c), lo, box[2])).alias(f"g{c}")
    filed = index.filter(F.size("ws") > 0).select("id", "kind", "ws", "lon", "lat", cell("lon", box[0]), cell("lat", box[1]), F.explode(F.array_distinct(F.flatten(F.transform("ws", begun)))).alias("stem"))
    filed = filed.withColumn("bucket", _bucket("stem"))
    # the id among the sort keys lets a list that everything is in be cut between partitions
    filed.repartitionByRange("bucket", "stem", "kind", "id").sortWithinPartitions("bucket", "stem", "kind", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    filed.groupBy("stem", "kind").agg(F.count("*").alias("n")).withColumn("bucket", _bucket("stem")).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/stems")
    index.sparkSession.createDataFrame([box], "x double, y double, side double").coalesce(1).write.parquet(f"{path}/extent")
    discard(index)


def _bucket(stem: str) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(BUCKETS)).cast("int")


def _cell_at(place: Column, low: float, side: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor((place - low) / side * (1 << DEEP)), F.lit((1 << DEEP) - 1))).cast("bigint")


@scoped("search-found")
def find(spark: SparkSession, path: str, queries: DataFrame, limit: int = 6) -> DataFrame:
    """Hits of each query (query_id, q, lon, lat) in a written index: every query word begins a label's word.

    Points of interest come first, then by distance, then by id. A query reads the list of that
    one of its words that fewest labels have, and looks for its other words in the labels there.
    A list of more than SHORT labels is not ranked whole: cells around the query are taken at
    ever coarser LEVELS until they hold ``limit`` hits nearer than any label outside can be; only
    what never finds that many goes through its whole list. Labels without a place count as near.
    """
    q = materialize(queries.filter(F.length(F.trim("q")) >= LEAST).withColumn("ts", _tokens(F.col("q"))).filter(F.size("ts") > 0), "search-queries")
    words = materialize(q.select("query_id", F.explode("ts").alias("t")).select("query_id", "t", F.substring("t", 1, STEM).alias("stem")).withColumn("bucket", _bucket("stem")), "search-words")
    # at most BUCKETS numbers; with them the other folders are not opened
    opened = [r.bucket for r in words.select("bucket").distinct().collect()]
    stems = spark.read.schema(_STEMS).parquet(f"{path}/stems").filter(F.col("bucket").isin(opened))
    often = stems.join(words.select("stem").distinct(), "stem", "left_semi").groupBy("stem").agg(F.sum("n").alias("n"), F.collect_list("kind").alias("kinds"))
    known = words.join(often, "stem").groupBy("query_id").agg(F.min(F.struct("n", "stem", "kinds")).alias("m"), F.count_distinct("t").alias("known"))
    asked = known.join(q, "query_id").filter(F.col("known") == F.size("ts")).select("query_id", "ts", "m.stem", "m.n", F.col("lon").alias("qlon"), F.col("lat").alias("qlat"), F.explode("m.kinds").alias("kind"))
    asked = materialize(asked, "search-asked")
    lists = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").filter(F.col("bucket").isin(opened)).drop("bucket")
    box = spark.read.parquet(f"{path}/extent").first()
    dx, dy = (F.col("lon") - F.col("qlon")) * LON_SHARE, F.col("lat") - F.col("qlat")
    best = Window.partitionBy("query_id", "kind").orderBy("d2", "id")
    hit = F.forall("ts", lambda t: F.exists("ws", lambda w: w.startswith(t)))

    def ranked(pairs: DataFrame) -> DataFrame:
        rows = pairs.filter(hit).select("query_id", "kind", "id", F.coalesce(dx * dx + dy * dy, F.lit(0.0)).alias("d2"))
        return rows.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= limit)

    by_cells = (F.col("n") > SHORT) & F.col("qlon").isNotNull() & F.col("qlat").isNotNull()
    todo, found = asked.filter(by_cells), ranked(asked.filter(~by_cells).join(lists, ["stem", "kind"]))
    for level in LEVELS:
        if todo.isEmpty():
            break
        side, at = box.side / (1 << level), lambda c, k: F.shiftright(c, DEEP - k)
        around = lambda c: F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.floor(c / side).cast("bigint") + d))  # noqa: B023, E731
        cells = todo.withColumn("cx", around(F.col("qlon") - box.x)).withColumn("cy", around(F.col("qlat") - box.y))
        near = cells.join(lists.withColumns({"cx": at("glon", level), "cy": at("glat", level)}), ["stem", "kind", "cx", "cy"]).drop("cx", "cy")
        both = near.unionByName(todo.join(lists.filter("glon is null"), ["stem", "kind"]))
        # all that lies within a cell's side, by the measure, is in the nine cells
        some = materialize(ranked(both.filter(F.coalesce(dx * dx + dy * dy, F.lit(0.0)) < (LON_SHARE * side * 0.999999) ** 2)), "search-near")
        full = materialize(some.groupBy("query_id", "kind").agg(F.count("*").alias("got")).filter(F.col("got") == limit).select("query_id", "kind"), "search-full")
        found = found.unionByName(some.join(full, ["query_id", "kind"], "left_semi"))
        todo = materialize(todo.join(full, ["query_id", "kind"], "left_anti"), "search-todo")
    found = found.unionByName(ranked(todo.join(lists, ["stem", "kind"])))
    first = Window.partitionBy("query_id").orderBy(F.when(F.col("kind") == "p", 0).otherwise(1), "d2", "id")
    top = found.drop("r").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit).select("query_id", "rank", "id")
    out = top.join(spark.read.parquet(f"{path}/records"), "id")
    return out.select("query_id", "rank", "id", "kind", "label", F.coalesce("address", F.when(F.col("kind") == "a", F.col("label"))).alias("address"), F.coalesce("addr_lon", "lon").alias("lon"), F.coalesce("addr_lat", "lat").alias("lat"))


@scoped("search-found")
def search(index: DataFrame, queries: DataFrame, limit: int = 6) -> DataFrame:
    """find() in an index written for these queries."""
    path = fresh_path(index.sparkSession, "search")
    write_index(index, path)
    return find(index.sparkSession, path, queries, limit)
