"""Point tables in the order of a space-filling curve, so that a box is a few ranges of one column.

Rows get ``z``, the interleaved bits of their place on a fixed grid of the globe, and lie in its
order. A box is covered by ranges of ``z``; these go to the Parquet reader as filters, which
skips files' row groups by their least and greatest ``z``. The exact box is tested behind them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a coordinate, and ranges that a box is covered by at most.
BITS, RANGES = 24, 32
#: Bytes of a row group: small ones are skipped more exactly.
GROUP_BYTES = 1 << 20


def _grid(x: Column, low: float, wide: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor((x - low) / wide * (1 << BITS)), F.lit((1 << BITS) - 1))).cast("bigint")


def _spread(x: Column) -> Column:
    """The bits of a number with a zero bit before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def place_key(lon: Column, lat: Column) -> Column:
    """The place's position on the curve; null without a place. Beyond the globe's edges the edge counts."""
    return F.shiftleft(_spread(_grid(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(_grid(lon, -180.0, 360.0)))


def key_ranges(box: tuple[float, float, float, float], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of the key, first and last, that cover the box (least lon, lat, greatest lon, lat): at most ``most``.

    Cells that the box cuts are opened, the largest first, while the ranges stay few.
    """
    at = lambda v, low, wide: max(0, min(int((v - low) / wide * (1 << BITS)), (1 << BITS) - 1))
    x0, x1, y0, y1 = at(box[0], -180.0, 360.0), at(box[2], -180.0, 360.0), at(box[1], -90.0, 180.0), at(box[3], -90.0, 180.0)
    if box[0] > box[2] or box[1] > box[3]:
        return []

    def merged(cells: list) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for level, _, _, z in sorted(cells, key=lambda c: c[3]):
            last = z + (1 << 2 * (BITS - level)) - 1
            if out and out[-1][1] + 1 == z:
                out[-1][1] = last
            else:
                out.append([z, last])
        return [(a, b) for a, b in out]

    def meets(level: int, cx: int, cy: int) -> tuple[bool, bool]:
        size = 1 << (BITS - level)
        ax, ay = cx * size, cy * size
        return ax <= x1 and ax + size - 1 >= x0 and ay <= y1 and ay + size - 1 >= y0, ax >= x0 and ax + size - 1 <= x1 and ay >= y0 and ay + size - 1 <= y1

    cells, best = [(0, 0, 0, 0)], [(0, (1 << 2 * BITS) - 1)]
    while True:
        cut = [c for c in cells if not meets(*c[:3])[1] and c[0] < BITS]
        if not cut:
            return merged(cells)
        level = min(c[0] for c in cut)
        opened = [c for c in cells if c not in cut or c[0] > level]
        for _, cx, cy, z in (c for c in cut if c[0] == level):
            for d in range(4):
                x, y = 2 * cx + (d & 1), 2 * cy + (d >> 1)
                if meets(level + 1, x, y)[0]:
                    opened.append((level + 1, x, y, z + (d << 2 * (BITS - level - 1))))
        ranges = merged(opened)
        if len(ranges) > most:
            return best
        cells, best = opened, ranges


def write_places(rows: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    """Write the rows with ``z``, in its order; rows without a place come first."""
    keyed = rows.withColumn("z", place_key(F.col(lon), F.col(lat)))
    keyed.repartitionByRange("z").sortWithinPartitions("z").write.option("parquet.block.size", GROUP_BYTES).option("compression", "zstd").parquet(path)


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The rows inside the box (least lon, least lat, greatest lon, greatest lat; edges included)."""
    ranges = [F.col("z").between(a, b) for a, b in key_ranges(box)]
    near = reduce(lambda a, b: a | b, ranges, F.lit(False))
    return spark.read.parquet(path).filter(near & F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3])).drop("z")
