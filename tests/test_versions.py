"""Rewrites beside readers."""

import pytest
from pyspark.sql import functions as F

from lanegraph.sources import versions


def test_a_rewrite_reads_what_it_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    first = versions.publish(spark.range(5), path)
    pinned = versions.read(spark, path)
    second = versions.publish(versions.read(spark, path).select((F.col("id") * 10).alias("id")), path, expected=first)
    assert versions.current(spark, path) == second and sorted(r.id for r in pinned.collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.id for r in versions.read(spark, path).collect()) == [0, 10, 20, 30, 40]
    assert sorted(r.id for r in versions.read(spark, path, first).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(RuntimeError, match="another"):
        versions.publish(spark.range(1), path, expected=first)
    assert versions.current(spark, path) == second
    assert versions.drop_others(spark, path, (first,)) == 1 and versions.drop_others(spark, path) == 1
    assert versions.read(spark, path).count() == 5


def test_a_rewrite_that_fails_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    versions.publish(spark.range(3), path)
    with pytest.raises(Exception, match="(?i)zero|broken"):
        versions.publish(spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), path)
    assert versions.read(spark, path).count() == 3
