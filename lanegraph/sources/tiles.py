"""Rasters as tables of square tiles: window reads that prune, and stencils that move only borders.

A tile is one row: tr and tc (its place), ``v`` (side x side doubles, not-a-number where there is
no value) and ``has`` (a byte per cell, whether the raster has it at all). Tables lie in folders
by bands of tile rows and are sorted by place, so a window read skips other bands as partitions
and other tiles by the statistics of row groups.

A stencil needs the cells around each tile. Every tile sends strips of its border to its
neighbours; the tiles themselves are read from a table bucketed by place and meet the strips
where they are, so what is shuffled grows with the borders. One group holds one tile and its
eight strips.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.stage import fresh_path, remove

#: Cells along a tile, and tile rows of a band.
SIDE, BAND = 256, 16
_TILE = "tr bigint, tc bigint, v binary, has binary"
_CELLS = "row bigint, col bigint, v double"


def tiles(raster: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of cells (row, col, v); of a cell given twice the least value counts."""
    at = lambda c: F.floor(F.col(c) / side).cast("bigint")
    cells = raster.select(at("row").alias("tr"), at("col").alias("tc"), F.pmod("row", F.lit(side)).cast("int").alias("r"), F.pmod("col", F.lit(side)).cast("int").alias("c"), F.col("v").cast("double").alias("v"))

    def pack(table: pa.Table) -> pa.Table:
        v, has = np.full((side, side), np.nan), np.zeros((side, side), np.uint8)
        at = table["r"].to_numpy(), table["c"].to_numpy()
        given = table["v"].to_numpy()
        by = np.argsort(-given, kind="stable")  # the least last; not-a-number comes last of all
        by = np.concatenate((by[np.isnan(given[by])], by[~np.isnan(given[by])]))
        v[at[0][by], at[1][by]] = given[by]
        has[at] = 1
        return pa.table({"tr": table["tr"].slice(0, 1), "tc": table["tc"].slice(0, 1), "v": pa.array([v.tobytes()], pa.binary()), "has": pa.array([has.tobytes()], pa.binary())})

    return cells.groupBy("tr", "tc").applyInArrow(pack, _TILE)


def cells(some: DataFrame, side: int = SIDE) -> DataFrame:
    """The cells of tiles: row, col, v (null where there is no value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tr, tc, v, has in zip(*(b.column(c).to_pylist() for c in ("tr", "tc", "v", "has")), strict=True):
                r, c = np.nonzero(np.frombuffer(has, np.uint8).reshape(side, side))
                own = np.frombuffer(v).reshape(side, side)[r, c]
                yield pa.RecordBatch.from_arrays([pa.array(tr * side + r), pa.array(tc * side + c), pa.array(own, mask=np.isnan(own))], names=["row", "col", "v"])

    return some.select("tr", "tc", "v", "has").mapInArrow(run, _CELLS)


def write_tiles(some: DataFrame, path: str) -> None:
    """Write tiles in bands, sorted by place."""
    some.withColumn("band", F.floor(F.col("tr") / BAND)).repartitionByRange("tr", "tc").sortWithinPartitions("band", "tr", "tc").write.partitionBy("band").option("parquet.block.size", 8 << 20).parquet(path)


def read_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], side: int = SIDE) -> DataFrame:
    """The tiles that meet the rows and columns from the first to the last given; other bands are not opened."""
    (r0, r1), (c0, c1) = ((lo // side, hi // side) for lo, hi in (rows, cols))
    return spark.read.parquet(path).filter(F.col("band").between(r0 // BAND, r1 // BAND) & F.col("tr").between(r0, r1) & F.col("tc").between(c0, c1)).drop("band")


def window_cells(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], side: int = SIDE) -> DataFrame:
    """The cells of a window."""
    return cells(read_window(spark, path, rows, cols, side), side).filter(F.col("row").between(*rows) & F.col("col").between(*cols))


@contextmanager
def bucketed(some: DataFrame, buckets: int) -> Iterator[DataFrame]:
    """The tiles as a table bucketed by place; it goes when the block ends."""
    spark, path, name = some.sparkSession, fresh_path(some.sparkSession, "tiles"), f"tiles_{uuid.uuid4().hex}"
    some.write.bucketBy(buckets, "tr", "tc").sortBy("tr", "tc").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def stencil(table: DataFrame, halo: int, compute: Callable[[np.ndarray, np.ndarray], np.ndarray], side: int = SIDE) -> DataFrame:
    """Tiles with new values: ``compute`` takes a tile's values and cells with ``halo`` more on each side and gives the tile's.

    Cells beyond the raster are not-a-number and not there.
    """
    if not 0 < halo <= side:
        raise ValueError(f"a halo of {halo} cells does not fit tiles of {side}")
    ways = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
    # what a tile sends to the neighbour at (dr, dc): its rows and columns next to it
    near = {-1: slice(0, halo), 0: slice(0, side), 1: slice(side - halo, side)}
    # where the neighbour at (dr, dc) lies around a tile
    place = {-1: slice(0, halo), 0: slice(halo, halo + side), 1: slice(halo + side, 2 * halo + side)}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tr, tc, v, has in zip(*(b.column(c).to_pylist() for c in ("tr", "tc", "v", "has")), strict=True):
                v, has = np.frombuffer(v).reshape(side, side), np.frombuffer(has, np.uint8).reshape(side, side)
                parts = [(tr + dr, tc + dc, k, v[near[dr], near[dc]].tobytes(), has[near[dr], near[dc]].tobytes()) for k, (dr, dc) in enumerate(ways)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["to_tr", "to_tc", "way", "v", "has"])

    def apply(tile: pa.Table, strips: pa.Table) -> pa.Table:
        if not len(tile):  # strips sent to where no tile is
            return tile
        v, has = np.full((side + 2 * halo,) * 2, np.nan), np.zeros((side + 2 * halo,) * 2, np.uint8)
        mid = slice(halo, halo + side)
        v[mid, mid] = np.frombuffer(tile["v"][0].as_py()).reshape(side, side)
        has[mid, mid] = np.frombuffer(tile["has"][0].as_py(), np.uint8).reshape(side, side)
        for way, sv, sh in zip(*(strips[c].to_pylist() for c in ("way", "v", "has")), strict=True):
            dr, dc = ways[way]  # it went that way, so it lies the other way from here
            at = place[-dr], place[-dc]
            shape = v[at].shape
            v[at], has[at] = np.frombuffer(sv).reshape(shape), np.frombuffer(sh, np.uint8).reshape(shape)
        out = np.ascontiguousarray(compute(v, has.astype(bool)), float)
        return tile.set_column(tile.column_names.index("v"), "v", pa.array([out.tobytes()], pa.binary()))

    strips = table.mapInArrow(send, "to_tr bigint, to_tc bigint, way int, v binary, has binary")
    return table.groupBy("tr", "tc").cogroup(strips.groupBy("to_tr", "to_tc")).applyInArrow(apply, _TILE)


def smooth(window: int = 5, sigma: float = 2.0) -> tuple[int, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Halo and computation of a median over window x window cells, then a Gaussian of ``sigma`` cells (4 sigma wide), edges cut off and reweighted.

    Every cell that the raster has gets a value if there is one in reach; cells without a value take no part.
    """
    r, reach = window // 2, int(4 * sigma + 0.5)
    halo = r + reach
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))

    def blur(v: np.ndarray, has: np.ndarray, axis: int) -> np.ndarray:
        """Along one axis; the result is shorter by the reach at both ends."""
        ok = ~np.isnan(v)
        n = v.shape[axis] - 2 * reach
        cut = lambda x, k: x.take(range(k, k + n), axis)
        total, weight = 0.0, 0.0
        filled = np.where(ok, v, 0.0)
        for k, w in enumerate(weights):
            total, weight = total + w * cut(filled, k), weight + w * cut(ok, k)
        return np.where((weight > 0) & cut(has, reach), total / np.where(weight > 0, weight, 1.0), np.nan)

    def compute(v: np.ndarray, has: np.ndarray) -> np.ndarray:
        near = np.lib.stride_tricks.sliding_window_view(v, (2 * r + 1, 2 * r + 1)).reshape(v.shape[0] - 2 * r, v.shape[1] - 2 * r, -1)
        inside = has[r : has.shape[0] - r, r : has.shape[1] - r]
        return blur(blur(_median(near, inside), inside, 0), inside[reach : inside.shape[0] - reach], 1)

    return halo, compute


def _median(near: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Median of the values in the last axis, where there are any and the cell is there."""
    out = np.full(inside.shape, np.nan)
    for row in range(len(out)):  # a row at a time: a window of every cell is many times the tile
        some = np.sort(near[row], axis=1)  # not-a-number comes last
        n = (~np.isnan(some)).sum(1)
        ok = (n > 0) & inside[row]
        k = np.arange(len(n))
        low, high = some[k, np.maximum(n - 1, 0) // 2], some[k, np.minimum(n // 2, some.shape[1] - 1)]
        out[row, ok] = np.where(n % 2 == 1, low, (low + high) / 2)[ok]
    return out
