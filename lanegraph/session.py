"""Session defaults for scripts and tests; a cluster brings its own session."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    """A local session with UTC timestamps, AQE and few shuffle partitions."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lanegraph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once per application, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/lanegraph", "zip", root.parent, root.name))
        _shipped.add(sc.applicationId)
