"""WARC archives: writing with revisits, reading with boundary-chain verification.

Writing. Payload digests are grouped (pre-aggregated, so a third of all pages may share one)
and each payload's first page is kept in full; the others become revisit records that refer
to it. Spark's text writer puts the records into files, so a lost task is simply redone.

Reading. Archives are split at every ``WARC/1.1`` line, wherever it stands, also inside
payloads. Every piece is a candidate record; its header gives the offset of its successor.
Successors that are the next candidate form runs (a running sum per file); runs are then
linked by pointer jumping from offset 0 of each file, in at most log2(runs) rounds, and only
reached candidates are records. A record whose payload holds the magic is put together again
from its pieces; whose piece is which record's is decided by offsets alone, and only such
records' texts are moved. Pieces are located by running sums of their lengths, per split as
they stream by and then per file, so a file may be read by many tasks.

Defined cases: null payload is empty; payloads of any length up to what one row can hold are
written and read whole; null keys and urls are written empty or left out; payloads under ``least`` bytes are always responses; rows repeated with the same key and
payload are alike (both responses where the key is the smallest); an empty table gives no
records; carriage returns and line feeds in urls are percent-encoded; columns other than
key, url and payload are not archived.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lanegraph.stage import discard, materialize

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_URN = "urn:x-page:"


def plan_records(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 100) -> DataFrame:
    """``pages`` (key, url, payload) with payload_digest, payload_bytes, record_type, refers_to."""
    body = F.coalesce(F.col(payload), F.lit(""))
    own = pages.select(
        F.col(key).alias("key"),
        F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"),
        body.alias("payload"),
        F.sha2(body.cast("binary"), 256).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
    )
    light = own.filter(F.col("payload_bytes") >= least).select("key", "payload_digest")
    firsts = light.groupBy("payload_digest").agg(F.min("key").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = light.join(firsts, "payload_digest").filter("key <> refers_to").groupBy("key", "payload_digest").agg(F.min("refers_to").alias("refers_to"))
    return own.join(again.hint("shuffle_hash"), ["key", "payload_digest"], "left").withColumn(
        "record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    )


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", records_per_file: int = 20_000) -> None:
    """Write plan_records() rows as WARC/1.1 files below ``path``, of so many records each: what a file holds is read as one row of offsets."""
    text = F.coalesce(F.col("key").cast("string"), F.lit(""))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    again = F.col("record_type") == "revisit"
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END),
        F.when(again, "").otherwise(F.col("payload")),
    )
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{KEY_URN}"), text, F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(
            again,
            F.concat(
                _line("WARC-Profile", F.lit(PROFILE)),
                _line("WARC-Refers-To", F.concat(F.lit(f"<{KEY_URN}"), F.col("refers_to").cast("string"), F.lit(">"))),
            ),
        ).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "),
        F.octet_length(F.col("block")).cast("string"),
        F.lit(END),
        F.col("block"),
        F.lit("\r\n"),
    )
    rows = records.withColumn("block", block).select(record.alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _parsed(value: Column, payload: bool) -> list[Column]:
    """Columns of the record that begins a piece: header fields, body length, digest."""
    head = F.substring_index(value, END, 1)
    start = F.octet_length(head) + 4
    length = _header(head, "Content-Length").try_cast("long")
    block = F.substring(value.cast("binary"), start + 1, length.cast("int"))
    http = F.substring_index(block.cast("string"), END, 1)
    plain = ~F.coalesce(_header(head, "Content-Type"), F.lit("")).startswith("application/http")
    body = F.when(plain, block).otherwise(F.substring(block, F.octet_length(http) + 5, length.cast("int")))
    full = F.octet_length(value).cast("long") == start + length + 4
    again = _header(head, "WARC-Type") == "revisit"
    stated = F.regexp_replace(_header(head, "WARC-Payload-Digest"), "^sha256:", "")
    known = (_header(head, "WARC-Type").isNotNull()) & _header(head, "WARC-Record-ID").isNotNull()
    return [
        F.when(known, start + length + 4).cast("long").alias("size"),
        full.alias("whole"),
        _header(head, "WARC-Type").alias("record_type"),
        _header(head, "WARC-Record-ID").alias("record_id"),
        _header(head, "WARC-Target-URI").alias("url"),
        _header(head, "WARC-Refers-To").alias("refers_to"),
        F.when(full, F.when(again, _header(http, "Content-Length").try_cast("long")).otherwise(F.octet_length(body).cast("long"))).alias("payload_bytes"),
        F.when(full, F.when(again, stated).otherwise(F.sha2(body, 256))).alias("payload_digest"),
        *([F.when(full & ~again, body).alias("payload")] if payload else []),
    ]


def _located(raw: DataFrame, columns: list[Column]) -> DataFrame:
    """Pieces with ``start``: the offset of the magic before them (the first piece, before any, left out).

    Rows of a split come in order, so offsets inside it are running sums as the rows stream by;
    nothing is sorted, and texts among ``columns`` stay where they are.
    """
    length = (F.octet_length("value") + len(MAGIC)).cast("long")
    pieces = raw.select("file", "split", length.alias("len"), *columns)
    totals = raw.groupBy("file", "split").agg(F.sum(length).alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("file", "split", before.alias("base"))
    rest = [c for c in pieces.columns if c not in ("split", "len")]
    return (
        pieces.mapInArrow(_running, StructType([*pieces.schema.fields, StructField("inside", LongType())]))
        .join(base, ["file", "split"])
        .withColumn("start", F.col("base") + F.col("inside") - len(MAGIC))
        .filter("start >= 0")
        .select(*rest, "start")
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``inside``, the bytes before a piece in its split; a task reads its splits one after the other."""
    last, carried = None, 0
    for b in batches:
        if not len(b):
            continue
        col = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
        files, splits, sizes = col("file").dictionary_encode(), col("split").to_numpy(), col("len").to_numpy()
        codes = files.indices.to_numpy()
        fresh = np.concatenate(([True], (codes[1:] != codes[:-1]) | (splits[1:] != splits[:-1])))
        upto = np.cumsum(sizes)
        begun = np.flatnonzero(fresh)
        lost = (upto - sizes)[begun]
        if last == (files.dictionary[int(codes[0])].as_py(), int(splits[0])):
            lost[0] = -carried
        inside = upto - sizes - lost[np.cumsum(fresh) - 1]
        last, carried = (files.dictionary[int(codes[-1])].as_py(), int(splits[-1])), int(inside[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(inside)], names=[*b.schema.names, "inside"])


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def reachable(candidates: DataFrame) -> DataFrame:
    """Of candidates (file, start, next), those on the chain that begins at offset 0 of their file.

    Adds ``run``, the start of the run a candidate belongs to.
    """
    by_file = Window.partitionBy("file").orderBy("start")
    linked = candidates.withColumn("_far", F.coalesce(F.lead("start").over(by_file) != F.col("next"), F.lit(True)))
    far = linked.filter("_far").select("file", F.col("next").alias("start")).distinct().withColumn("_entry", F.lit(True))
    heads = (
        linked.join(far, ["file", "start"], "left")
        .withColumn("_head", F.coalesce(F.lag("_far").over(by_file), F.lit(True)) | F.coalesce("_entry", F.lit(False)))
        .withColumn("run", F.max(F.when(F.col("_head"), F.col("start"))).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_far", "_entry", "_head")
    )
    heads = materialize(heads, "warc-candidates")
    runs = heads.groupBy("file", "run").agg(F.max_by("next", "start").alias("to"))
    nodes = runs.select("file", F.col("run").alias("to"))
    jump = materialize(runs.join(nodes, ["file", "to"], "left_semi"), "warc-runs")
    reach = runs.filter("run = 0").select("file", "run")
    while not jump.isEmpty():
        step = reach.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"))
        reach = materialize(reach.union(step).distinct(), "warc-reach")
        second = jump.select("file", F.col("run").alias("to"), F.col("to").alias("to2"))
        jump = materialize(jump.join(second, ["file", "to"]).select("file", "run", F.col("to2").alias("to")), "warc-jump")
    return heads.join(reach, ["file", "run"], "left_semi")


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The verified records below ``path``: file, start, record_type, record_id, url, refers_to, payload_bytes, payload_digest."""
    found = _located(_raw(spark, path), _parsed(F.col("value"), payload)).filter("size is not null")
    chain = reachable(found.withColumn("next", F.col("start") + len(MAGIC) + F.col("size"))).drop("run")
    own = [c for c in chain.columns if c not in ("size", "whole", "next")]
    torn = materialize(chain.filter("not whole").select("file", "start"), "warc-torn")
    whole = chain.filter("whole").select(own)
    if torn.isEmpty():
        discard(torn)
        return whole
    raw = _raw(spark, path).join(torn.select("file").distinct(), "file", "left_semi")
    true = chain.select("file", "start", F.col("start").alias("_true"), (~F.col("whole")).alias("_torn"))
    by_file = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    # which record each piece belongs to, by offsets alone; texts are only fetched for the torn records
    owned = (
        _located(raw, [])
        .join(true, ["file", "start"], "left")
        .withColumn("owner", F.last("_true", ignorenulls=True).over(by_file))
        .withColumn("_torn", F.last("_torn", ignorenulls=True).over(by_file))
        .filter("_torn")
        .select("file", "start", "owner")
    )
    pieces = (
        _located(raw, [F.col("value")])
        .join(owned, ["file", "start"])
        .groupBy("file", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("p"))
        .select("file", F.col("owner").alias("start"), F.array_join(F.col("p.value"), MAGIC).alias("value"))
    )
    joined = pieces.select("file", "start", *_parsed(F.col("value"), payload)).filter("whole")
    return whole.unionByName(joined.select(own))


def key_of(record_id: Column) -> Column:
    """The page key that write() put into a record id."""
    return F.regexp_extract(record_id, rf"^<{KEY_URN}(-?\d+)>$", 1).try_cast("long")
