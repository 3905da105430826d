"""Stage tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: The folders named inside the scopes that are open, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session sets none and runs on this machine alone a local one is made; on a
    cluster other machines would not see it, so there the setting is asked for.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (the master is {master!r})")
    return _own.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="lanegraph-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; the scope that is open deletes it when it ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all folders that fresh_path() named inside it (stage tables, indexes, buckets).

    Plans that read them must have been run by then: write results inside the scope, to a path
    that is not one of its own. Scopes nest; without one, stage tables stay.
    """
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in mine:
            remove(spark, path)


def scoped(name: str) -> Callable:
    """Decorator of operators with narrow results: the result is a stage table, what it took to make it is deleted."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(*args, **kwargs) -> DataFrame:
            spark = next(x for x in (*args, *kwargs.values()) if isinstance(x, (DataFrame, SparkSession)))
            spark = spark if isinstance(spark, SparkSession) else spark.sparkSession
            path = fresh_path(spark, name)
            with scope(spark):
                out = operator(*args, **kwargs)
                out.write.option("compression", "zstd").parquet(path)
                schema = out.schema
            stage = spark.read.schema(schema).parquet(path)
            stage._lanegraph_path = path
            return stage

        return run

    return wrap


#: Parquet looks at its buffer's size after 100 rows only and closes a row group at 128 MB; of rows of megabytes
#: it would hold gigabytes. These look after every row and close at 16 MB, for the writer and for who reads it.
WIDE = {"parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": False}


def materialize(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; ``wide``: its rows may be of megabytes.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.options(compression="zstd", **(WIDE if wide else {})).parquet(path)
    stage = df.sparkSession.read.schema(df.schema).parquet(path)
    stage._lanegraph_path = path
    return stage


def discard(*stages: DataFrame) -> None:
    """Delete what materialize() wrote, once no later plan reads it."""
    for df in stages:
        path = getattr(df, "_lanegraph_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that fresh_path() named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
