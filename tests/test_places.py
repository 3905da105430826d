"""Places along a space-filling curve: boxes as ranges of keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanegraph.sources import places


def test_boxes_read_their_rows_and_few_others(spark, tmp_path):
    r = np.random.default_rng(2)
    at = np.concatenate([r.normal((-122.3, 47.6), 0.1, (60_000, 2)), r.uniform((-180, -90), (180, 90), (500, 2)), [[-180.0, -90.0], [180.0, 90.0]]])
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)] + [(99_999, None, 1.0)], "id long, lon double, lat double")
    places.write_places(df.repartition(16), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == len(at) + 1
    for box in ((-122.31, 47.59, -122.29, 47.61), (-122.5, 47.6, -122.1, 47.601), (-180.0, -90.0, 180.0, 90.0), (170.0, -90.0, 180.0, 0.0), (10.0, 10.0, 5.0, 20.0)):
        some = places.read_box(spark, f"{tmp_path}/p", box)
        got = sorted(x["id"] for x in some.collect())
        assert got == [k for k, (x, y) in enumerate(at) if box[0] <= x <= box[2] and box[1] <= y <= box[3]]
    plan = places.read_box(spark, f"{tmp_path}/p", (-122.31, 47.59, -122.29, 47.61))
    text = spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(z," in text
    scan = plan._jdf.queryExecution().executedPlan()
    plan._jdf.queryExecution().toRdd().count()
    leaf = scan.collectLeaves().apply(0)
    read = leaf.metrics().get("numOutputRows").get().value()
    assert read < 0.5 * len(at)  # of a file, only the row groups that the ranges meet


@pytest.mark.parametrize("most", [1, 4, 32, 200])
def test_ranges_cover_and_are_few(spark, most):
    r = np.random.default_rng(most)
    for _ in range(20):
        x, y = r.uniform(-170, 160), r.uniform(-80, 70)
        box = (x, y, x + 10 * r.random() ** 3, y + 10 * r.random() ** 3)
        ranges = places.key_ranges(box, most)
        assert 1 <= len(ranges) <= most and all(a <= b for a, b in ranges) and all(p[1] + 1 < q[0] for p, q in zip(ranges, ranges[1:], strict=False))
        inside = [(float(r.uniform(box[0], box[2])), float(r.uniform(box[1], box[3]))) for _ in range(5)] + [(box[0], box[1]), (box[2], box[3])]
        keys = [t.z for t in spark.createDataFrame(inside, "lon double, lat double").select(places.place_key(F.col("lon"), F.col("lat")).alias("z")).collect()] if most == 32 else []
        assert all(any(a <= z <= b for a, b in ranges) for z in keys)
