"""Tables rewritten in place: versions side by side, and a pointer that moves last.

A rewrite goes to a folder of its own; only when it is complete does the pointer file name it,
by a rename, which file systems do at once or not at all (object stores that copy instead want
a pointer in a catalogue). Readers look the version up once and stay with it, so a rewrite that
reads the table it replaces, a failed one, or one that ends while another job reads, does no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The version that the table's pointer names, or None before the first."""
    where, fs = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(int(fs.getFileStatus(where).getLen()))).decode()
    finally:
        stream.close()


def publish(df: DataFrame, path: str, expected: str | None = None) -> str:
    """Write ``df`` as a new version of the table at ``path`` and point to it; the version's name.

    With ``expected`` the pointer moves only if it still names that version (checked right
    before; one writer at a time is assumed), else the new version stays unnamed and an error is raised.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{path}/{version}")
    if expected is not None and current(spark, path) != expected:
        raise RuntimeError(f"{path} was rewritten by another: {current(spark, path)} instead of {expected}")
    fresh, fs = _fs(spark, f"{path}/.{POINTER}-{version}")
    out = fs.create(fresh)
    out.write(version.encode())
    out.close()
    target, _ = _fs(spark, f"{path}/{POINTER}")
    options = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.valueOf("OVERWRITE")
    options.rename(options.makeQualified(fresh), options.makeQualified(target), overwrite)
    return version


def read(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The table at the version given, or at the current one, which this plan then stays with."""
    chosen = version or current(spark, path)
    if chosen is None:
        raise FileNotFoundError(f"no version of {path} is published")
    return spark.read.parquet(f"{path}/{chosen}")


def drop_others(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> int:
    """Delete versions that are neither current nor kept (unnamed ones of failed rewrites too); how many."""
    where, fs = _fs(spark, path)
    kept, gone = {current(spark, path), *keep}, 0
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in kept:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone
