"""Stage tables go with their scope."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lanegraph.operators import grid, search
from lanegraph.stage import discard, fresh_path, materialize, scope, shared_folder


def folders(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file://")))


def test_a_scope_deletes_what_it_named(spark):
    before = folders(spark)
    with scope(spark):
        outer = materialize(spark.range(5), "outer")
        with scope(spark):
            materialize(spark.range(7), "inner").count()
            spark.range(3).write.parquet(fresh_path(spark, "by-hand"))
            assert len(folders(spark) - before) == 3
        assert len(folders(spark) - before) == 1 and outer.count() == 5
        gone = materialize(spark.range(2), "gone")
        discard(gone)
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError), scope(spark):
        materialize(spark.range(5), "broken")
        1 / 0  # noqa: B018
    assert folders(spark) == before


def test_operators_leave_their_result_alone(spark):
    """Each run of a scoped operator leaves one table, its result; inside a scope none."""
    points = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 7 % 13).cast("double").alias("px"), F.col("id").cast("double").alias("py"))
    targets = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("tx"), (F.col("id") % 29).cast("double").alias("ty"))
    record = "id long, kind string, label string, category string, address string, addr_lon double, addr_lat double, lon double, lat double"
    index = spark.createDataFrame([(1, "a", "12 oak way", None, None, None, None, 1.0, 1.0)], record)
    asked = spark.createDataFrame([(1, "oak", 0.0, 0.0)], "query_id long, q string, lon double, lat double")
    before = folders(spark)
    a = grid.nearest_anywhere(points, targets, "k", "id", most=16)
    b = search.search(index, asked)
    assert len(folders(spark) - before) == 2 and a.count() == 50 and b.count() == 1
    discard(a, b)
    assert folders(spark) == before
    with scope(spark):
        assert grid.nearest_anywhere(points, targets, "k", "id", most=16).count() == 50
    assert folders(spark) == before


def test_wide_rows_are_kept_in_small_row_groups(spark):
    """Twelve rows of 4 MB: a writer holds some 16 MB of them, not all (by default it looks at what it holds after 100 rows)."""
    rows = spark.range(0, 12, 1, 1).select("id", F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1 << 17)), lambda k: F.sha2(F.concat_ws("-", "id", k), 256)), "")).alias("ways"))
    made = materialize(rows, "wide", wide=True)
    (file,) = made.inputFiles()
    meta = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert meta.num_rows == 12 and max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 5
    assert made.filter(F.octet_length("ways") == 32 << 17).count() == 12
