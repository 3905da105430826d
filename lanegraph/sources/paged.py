"""Layers served in pages, as a Spark data source: ``spark.read.format("feature_pages")``.

A service answers a request (offset, how many rows, which fields, which filter) with a page of
features and says whether there are more. The reader finds the last page by doubling steps and
halving (the logarithm of the pages in requests, instead of asking one after the other), and
then makes one partition of every page. Field names given as an option become text columns
(others are not asked for); filters on them that Spark pushes down go with the request, so
rows that fail them never leave the reader.

There is no network here: the service is a folder of saved pages (``page=<n>`` and ``meta``),
which any file system that pyarrow opens may hold; driver and executors must both see it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringStartsWith
from pyspark.sql.types import StructType

from lanegraph.operators.ordered import dense_ids

#: A column that is always ``yes``, and filtered by in every plan: Spark hands filters to a source only where a plan
#: has some, and else goes on with those of the last plan that was made of the same DataFrame.
ASKED = "_asked"

#: Rows of a page: what a service allows, this many if it does not say, and no more than so many.
USUAL, MOST = 1000, 2000


def page_size(meta: dict) -> int:
    """Rows to ask for at a time."""
    return min(int(meta.get("maxRecordCount") or USUAL), MOST)


def save_pages(features: DataFrame, path: str, key: str, size: int = USUAL) -> None:
    """Save (key, properties, kind, coordinates as an array) as the pages a service would give, in the key's order.

    Every page but the last says that there are more. Keys are unique.
    """
    spark, size = features.sparkSession, min(size, MOST)
    ids = dense_ids(features, key, "_n")
    body = F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", F.struct(F.col("kind").alias("type"), "coordinates").alias("geometry")))
    last = (ids.agg(F.max("_n")).first()[0] or 0) // size
    rows = features.join(ids, key).select(F.floor(F.col("_n") / size).alias("page"), "_n", body.alias("f"))
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "f"))), lambda x: x["f"]), ",").alias("fs"))
    more = F.when(F.col("page") < last, "true").otherwise("false")
    pages.select("page", F.concat(F.lit('{"type":"FeatureCollection","exceededTransferLimit":'), more, F.lit(',"features":['), "fs", F.lit("]}")).alias("value")).write.partitionBy("page").option("maxRecordsPerFile", 1).text(f"{path}/pages")
    spark.createDataFrame([(json.dumps({"maxRecordCount": size}),)], "value string").coalesce(1).write.text(f"{path}/meta")


class SavedPages:
    """The service: what it answers to requests for pages."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def _text(self, folder: str) -> str | None:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        parts = [x.path for x in found if x.size and not x.base_name.startswith(("_", "."))]
        return "".join(self.files.open_input_stream(p).read().decode() for p in sorted(parts)) or None

    def meta(self) -> dict:
        return json.loads(self._text("meta") or "{}")

    def page(self, number: int) -> dict:
        """The page, or an empty one beyond the end."""
        text = self._text(f"pages/page={number}")
        return json.loads(text) if text else {"features": []}


def has_more(body: dict) -> bool:
    """Whether a page says there are more rows, by either of the places services use."""
    return bool((body.get("properties") or {}).get("exceededTransferLimit") or body.get("exceededTransferLimit")) and bool(body.get("features"))


def last_page(more: Callable[[int], bool]) -> int:
    """Number of the first page that has no more after it; ``more`` holds for all pages before."""
    low, high = -1, 0
    while more(high):
        low, high = high, 2 * high + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if more(mid) else (low, mid)
    return high


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PageReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, fields: list[str]):
        self.path, self.names, self.fields, self.filters = path, schema.names, fields, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on asked-for fields go with the request; the rest is left to Spark."""
        for f in filters:
            if passes(f, {}.get, {*self.fields, ASKED}) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[InputPartition]:
        service = SavedPages(self.path)
        return [Page(k) for k in range(last_page(lambda k: has_more(service.page(k))) + 1)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        rows = []
        for f in SavedPages(self.path).page(partition.number).get("features", []):
            given, shape = f.get("properties") or {}, f.get("geometry") or {}
            value = {n: text_of(given.get(n)) for n in self.fields} | {ASKED: "yes"}
            if all(passes(x, value.get, {*self.fields, ASKED}) for x in self.filters):
                rows.append(value | {"kind": shape.get("type"), "coordinates": json.dumps(shape["coordinates"]) if "coordinates" in shape else None})
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.string()) for n in self.names], names=self.names)


def text_of(value) -> str | None:
    """A property as text, as Spark's JSON reader has it."""
    return value if value is None or isinstance(value, str) else json.dumps(value)


def passes(f: Filter, get: Callable, known: set[str]) -> bool | None:
    """Whether a row passes a filter; None if the service does not know such filters. Null passes none but IsNull and EqualNullSafe."""
    if isinstance(f, Not):
        inner = passes(f.child, get, known)
        child = f.child
        if inner is None or isinstance(child, Not):
            return None
        null = not isinstance(child, (IsNull, IsNotNull, EqualNullSafe)) and get(child.attribute[0]) is None
        return not inner and not null
    if not isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith)) or len(f.attribute) != 1 or f.attribute[0] not in known:
        return None
    value = get(f.attribute[0])
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, In):
        return value in f.value
    return True if isinstance(f, IsNotNull) else value.startswith(f.value) if isinstance(f, StringStartsWith) else value == f.value


class FeaturePages(DataSource):
    """Options: ``path``, and ``fields``, the properties asked for, separated by commas."""

    @classmethod
    def name(cls) -> str:
        return "feature_pages"

    def _fields(self) -> list[str]:
        return [x.strip() for x in self.options.get("fields", "").split(",") if x.strip()]

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n in [*self._fields(), "kind", "coordinates", ASKED])

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options["path"], schema, self._fields())


def read_pages(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """The layer's features: the fields as texts, kind, coordinates (JSON text)."""
    spark.dataSource.register(FeaturePages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("feature_pages").option("path", path).option("fields", ",".join(fields)).load().filter(F.col(ASKED) == "yes").drop(ASKED)
