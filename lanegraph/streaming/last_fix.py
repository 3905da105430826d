"""Streaming extras: the latest value per user, and windowed counts with late data dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.stage import fresh_path


def event_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return source.parquet(f"{folder}/events.parquet*")


def _drain(out: DataFrame, keys: list[str]) -> DataFrame:
    """Run the stream over what is there; the last state of every key.

    Every batch writes the keys it changed to a folder of its own, named by its number, so one
    that is repeated after a failure overwrites itself; of a key's rows the last batch's counts.
    """
    spark, path = out.sparkSession, fresh_path(out.sparkSession, "stream")

    def write(df: DataFrame, n: int) -> None:
        df.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{path}/out/{n}")

    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").schema(out.schema.add("batch", "long")).parquet(f"{path}/out")
    rest = [c for c in out.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("m")).select(*keys, "m.*")


def last_fixes(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Latest event of every user: state is one row per user."""
    latest = F.max_by(F.struct("event_id", "ts", "event_type", "value"), F.struct("ts", "event_id")).alias("e")
    state = event_stream(spark, folder, files_per_batch).groupBy("user_id").agg(latest)
    return _drain(state, ["user_id"]).select("user_id", "e.event_id", "e.event_type", "e.value")


def hourly_counts(spark: SparkSession, folder: str, files_per_batch: int | None = None, late: str = "1 day") -> DataFrame:
    """Events per type and hour; hours that ended ``late`` before the latest event of earlier batches are closed, and rows that come for them after one more batch are dropped."""
    events = event_stream(spark, folder, files_per_batch).withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _drain(w, ["w", "event_type"]).select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total")
