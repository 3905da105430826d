"""File manifests: size, zipped size and hash of every file, and byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


@F.pandas_udf(LongType())
def zipped_size(content: pd.Series) -> pd.Series:
    return content.map(lambda b: len(gzip.compress(b, 6)))


def short_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


#: Names of files that Spark's text reader would unpack; these are read whole.
PACKED = r"\.(gz|gzip|bz2|zst|zstd|lz4|snappy|deflate|xz|lzo)$"


def files(spark: SparkSession, path: str) -> DataFrame:
    """url (the file's name), size, zipped and hash of the files at ``path``.

    Hash and zipped size run through a file's bytes in order, so one task takes a file; it takes
    it in pieces, from one line feed to the next, and holds a batch of them and the packer's window.
    Pieces come from Spark's text reader with their places, so any store that Spark reads will do.
    Files that the reader would unpack (PACKED) or take for a byte order mark alone are read whole; Spark does not list
    those of no bytes.
    """
    small = F.lower("_metadata.file_name").rlike(PACKED) | (F.col("_metadata.file_size") <= 3)
    raw = spark.read.format("binaryFile").load(path).filter(small)
    whole = raw.select(F.element_at(F.split("path", "/"), -1).alias("url"), F.col("length").alias("size"), zipped_size("content").alias("zipped"), short_hash(F.col("content")).alias("hash"))
    text = spark.read.option("lineSep", "\n").text(path).filter(~small)
    place = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_name", "file_size")]
    length = F.octet_length(F.col("value").cast("binary")).cast("bigint")
    pieces = text.select(*place, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("bytes"), F.lit(0).cast("bigint").alias("found"))
    # A file's first row tells how many bytes its pieces have. It is not joined: a join's partitions may be split, a file's may not.
    heads = text.select(*place, length.alias("length")).groupBy("file_path", "file_name", "file_size").agg(F.sum(F.col("length") + 1).alias("found"))
    heads = heads.withColumns({"block": F.lit(-1).cast("bigint"), "n": F.lit(-1).cast("bigint"), "bytes": F.lit(None).cast("binary")})
    ordered = pieces.unionByName(heads).repartition("file_path").sortWithinPartitions("file_path", "block", "n")
    streamed = ordered.select("file_path", "file_name", "file_size", "found", "bytes").mapInArrow(_streamed, "url string, size bigint, zipped bigint, hash string")
    return streamed.unionByName(whole)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """url, size, zipped and hash of every file whose pieces follow one another; the line feeds between them are put back."""
    last, names = None, ("url", "size", "zipped", "hash")

    def end() -> pa.RecordBatch:
        # the text reader leaves a line feed at the end untold
        take(b"\n" if size >= found + marked else b"")
        return pa.RecordBatch.from_pylist([dict(zip(names, (unquote(file), size, packed + len(packer.flush()), digest.hexdigest()[:16]), strict=True))], pa.schema([("url", pa.string()), ("size", pa.int64()), ("zipped", pa.int64()), ("hash", pa.string())]))

    def take(data: bytes) -> None:
        nonlocal packed
        digest.update(data)
        packed += len(packer.compress(data))

    for b in batches:
        for path, name, n, total, data in zip(*(b.column(k) for k in range(5)), strict=True):
            if not data.is_valid:
                if last is not None:
                    yield end()
                last, file, size, found, packed, between = path.as_py(), name.as_py(), n.as_py(), total.as_py(), 0, b""
                # a byte order mark, which the reader takes off, is missed in the sum
                marked = 3 if size > found else 0
                digest, packer = hashlib.sha256(), zlib.compressobj(6, zlib.DEFLATED, 31)
                take(b"\xef\xbb\xbf" if marked else b"")
            elif path.as_py() != last:
                raise ValueError(f"pieces of {path} without their head")
            else:
                take(between + data.as_py())
                between = b"\n"
    if last is not None:
        yield end()


def totals(manifest: DataFrame) -> DataFrame:
    """Files, bytes, and bytes to fetch (zipped where known)."""
    return manifest.agg(F.count("*").alias("n_files"), F.sum("size").alias("size"), F.sum(F.coalesce("zipped", "size")).alias("fetched"))


def byte_range(content: Column, first: Column, last: Column) -> Column:
    """Bytes first to last, both included; null where the range does not start inside."""
    n = F.octet_length(content)
    return F.when((first >= 0) & (first <= last) & (first < n), F.substring(content, first.cast("int") + 1, (F.least(last, n - 1) - first + 1).cast("int")))


def folder_hash(entries: DataFrame, hexes: int = 3) -> DataFrame:
    """One hash over (name, content), whatever the order of rows.

    Entries fall into 16 ** hexes parts by the first digits of their name's hash; each part is
    hashed in the order of names, and then the parts' hashes in their order. So no task holds
    more than a part's names and content hashes, and one those of the parts (4096 lines).
    """
    line = F.concat_ws("\0", "name", F.sha2("content", 256))
    part = F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, hexes)
    joined = lambda key, value: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value.alias("l")))), lambda x: x["l"]), "\n"), 256)
    parts = entries.groupBy(part.alias("part")).agg(joined("name", line).alias("h"))
    return parts.agg(F.substring(joined("part", F.concat_ws("\0", "part", "h")), 1, 16).alias("hash"))
