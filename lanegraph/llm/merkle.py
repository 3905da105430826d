"""Merkle manifest of a dataset, with the authentication path of every row.

A leaf is the hash of a row's fields. Per group the leaves stand in the order of their key;
while several nodes remain, every ARITY consecutive ones (the last run may be shorter) become
the hash of their hexadecimal digests joined. What remains is the group's subroot; subroots in
the order of the groups likewise give the root.

Leaves are numbered by a range partitioning and running counts of its parts, so no task holds a
group. Aligned blocks of BLOCK leaves are subtrees: each gives its top, the tops are the leaves
of the next level, until one node is left. Then the levels are walked downwards: per block,
a stack of unfinished nodes per height (treehash) takes one leaf a step and has the next run of
that height ready when the walk gets there, so the path moves from leaf to leaf with
ARITY nodes a height in memory besides the block's own digests; the path above the block, which
its leaves share, is appended. Only digests and keys are shuffled, never the fields.

Defined cases: a null field is ``-`` and differs from an empty one; a null group comes first;
null keys come first in their group; rows of one key stand in the order of their digests, and
rows equal in both are equal leaves, one each; an empty table gives no rows; texts are hashed
whole; other columns of the table take no part and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.stage import discard, materialize

#: Nodes in a run, and levels of a block.
ARITY, LEVELS = 8, 4
BLOCK = ARITY**LEVELS
#: Hexadecimal digits of a digest.
DIGITS = 64

_PATH = "array<struct<at:int,others:string>>"


def hashed(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """A row's leaf: each field ``-`` if null, else its length in bytes, a colon and itself; numbers as decimals."""
    texts = [f.cast("string") for f in fields]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    step = lambda acc, s: hashed(s["others"].substr(F.lit(1), s["at"] * DIGITS), acc, s["others"].substr(s["at"] * DIGITS + 1, F.lit(DIGITS * ARITY)))
    return F.aggregate(path, leaf, step)


def siblings(path: Column) -> Column:
    """The digests on a path, level by level upwards and from left to right, joined."""
    return F.concat_ws("", F.transform(path, lambda s: s["others"]))


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, group, the columns ``carry`` (narrow ones; they travel along), leaf, subroot, root and path.

    ``path``: per level from the leaf up, ``at``, the own place in the run, and ``others``, the
    digests of the run's other nodes joined. Levels whose run is one node are on it with none.
    """
    row = F.struct(F.col(key).alias("key"), F.col(group).alias("group"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    leaves = docs.select(F.struct(F.col(group)).alias("g"), F.struct(F.col(key)).alias("o"), F.unhex(leaf_of(*[F.col(f) for f in fields])).alias("digest"), row.alias("row"))
    levels, subroots = _climbed(_numbered(materialize(leaves, "merkle-leaves")))
    one = F.struct(F.lit(0))
    upper, roots = _climbed(_numbered(subroots.select(one.alias("g"), F.col("g").alias("o"), "digest", F.struct("g").alias("row"))))
    top = roots.first()
    root = F.lit(top["digest"].hex() if top else None).cast("string")
    none = roots.select("g", F.array().cast(_PATH).alias("path"), F.lit("").alias("end"))
    above = materialize(_walked(upper, none).select(F.col("row.g").alias("g"), "path", F.col("leaf").alias("end")), "merkle-above")
    rows = _walked(levels, above)
    names = [F.col("row.key").alias(key), F.col("row.group").alias(group), *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)]]
    return rows.select(*names, "leaf", F.col("end").alias("subroot"), root.alias("root"), "path")


def _numbered(nodes: DataFrame) -> DataFrame:
    """Nodes (g, o, digest, row: a stage table) with pos, their place in their group from 0, and size, the group's."""
    order = ["g", "o", "digest", "tie"]
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(dealt.select("g", "digest", "row", F.monotonically_increasing_id().alias("at")), "merkle-placed")
    part = F.shiftright("at", 33)
    parts = placed.groupBy("g", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    upto, whole = Window.partitionBy("g").orderBy("part"), Window.partitionBy("g")
    starts = materialize(parts.select("g", "part", (F.sum("n").over(upto) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")), "merkle-starts")
    discard(nodes)
    return placed.withColumn("part", part).join(starts, ["g", "part"]).select("g", (F.col("at") + F.col("shift")).alias("pos"), "size", "digest", "row")


def _climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every block level from below, and what remains of each group (g, digest)."""
    levels, done = [], None
    while True:
        level = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
        levels.append(level)
        schema = level.select("g", "block", "size", "digest").schema
        tops = materialize(level.select("g", "block", "size", "pos", "digest").groupBy("g", "block").applyInArrow(_top, schema), "merkle-tops")
        ended = tops.filter(F.col("size") <= BLOCK).select("g", "digest")
        done = ended if done is None else done.unionByName(ended)
        nodes = tops.filter(F.col("size") > BLOCK).select("g", F.col("block").alias("pos"), F.ceil(F.col("size") / BLOCK).alias("size"), "digest", F.struct("g").alias("row"))
        if nodes.isEmpty():
            return levels, done


def _walked(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level's rows with leaf, path and ``end``; ``above``: g, path and end of every group's top."""
    path = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        # The way up from a block: the path of its top on the next level, or of its group where it is the only one.
        way = level.filter((F.col("size") <= BLOCK) & (F.col("pos") == 0)).select("g", "block").join(above, "g")
        if path is not None:
            way = way.unionByName(path.select("g", F.col("pos").alias("block"), "path", "end"))
        schema = level.select("g", "pos", "row").schema.add("leaf", "string").add("path", above.schema["path"].dataType).add("end", "string")
        way = way.select(F.col("g").alias("up_g"), F.col("block").alias("up_block"), "path", "end")
        path = level.groupBy("g", "block").cogroup(way.groupBy("up_g", "up_block")).applyInArrow(_paths, schema)
        if k:
            path = materialize(path, "merkle-paths")
    return path


def _hash(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _height(size: int) -> int:
    """Levels from the leaves of a block to its top, by the size of the group."""
    return next((h for h in range(LEVELS) if ARITY**h >= size), LEVELS)


class Treehash:
    """A stack of unfinished runs that takes nodes one by one and gives the run of nodes ``height`` levels above."""

    def __init__(self, height: int):
        self.runs: list[list[str]] = [[] for _ in range(height + 1)]

    def push(self, node: str) -> None:
        runs, h = self.runs, 0
        runs[0].append(node)
        while len(runs[h]) == ARITY and h + 1 < len(runs):
            node, runs[h] = _hash(runs[h]), []
            h += 1
            runs[h].append(node)

    def finish(self) -> list[str]:
        """Close the runs that are left; a short one counts as whole."""
        for h, run in enumerate(self.runs[:-1]):
            if run:
                self.runs[h + 1].append(_hash(run))
        return self.runs[-1]


def traversal(leaves: list[str], height: int) -> Iterator[list[tuple[int, str]]]:
    """Per leaf of a block its path (place, others' digests joined), one leaf after the other.

    ``current`` holds the run on the path at each height. ``ahead`` has a treehash per height
    that takes, at leaf i, the leaf one run's width further on; after that width it has the next run.
    """
    width = [ARITY ** (h + 1) for h in range(height)]
    current = []
    for h in range(height):
        stack = Treehash(h)
        for x in leaves[: width[h]]:
            stack.push(x)
        current.append(stack.finish())
    ahead = [Treehash(h) for h in range(height)]
    path: list[tuple[int, str]] = [(0, "")] * height
    for i in range(len(leaves)):
        for h in range(height):
            below = width[h] // ARITY
            if i % below == 0:
                at = i // below % ARITY
                path[h] = (at, "".join(current[h][:at] + current[h][at + 1 :]))
        yield path
        for h in range(height):
            if i + width[h] < len(leaves):
                ahead[h].push(leaves[i + width[h]])
            if (i + 1) % width[h] == 0:
                current[h], ahead[h] = ahead[h].finish(), Treehash(h)


def _top(table: pa.Table) -> pa.Table:
    """A block's top."""
    table = table.sort_by("pos")
    stack = Treehash(_height(table["size"][0].as_py()))
    for x in table["digest"].to_pylist():
        stack.push(x.hex())
    return table.slice(0, 1).select(["g", "block", "size"]).append_column("digest", pa.array([bytes.fromhex(stack.finish()[0])], pa.binary()))


def _paths(table: pa.Table, way: pa.Table) -> pa.Table:
    """A block's leaves with their paths."""
    table = table.sort_by("pos")
    leaves = [x.hex() for x in table["digest"].to_pylist()]
    up, end = way["path"][0].as_py(), way["end"][0].as_py()
    shared_at, shared = [s["at"] for s in up], [s["others"] for s in up]
    height = _height(table["size"][0].as_py()) if leaves else 0
    at: list[int] = []
    others: list[str] = []
    for path in traversal(leaves, height):
        at += [x for x, _ in path] + shared_at
        others += [x for _, x in path] + shared
    each = height + len(up)
    steps = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(others, pa.string())], ["at", "others"])
    paths = pa.ListArray.from_arrays(pa.array(range(0, each * len(leaves) + 1, each) if each else [0] * (len(leaves) + 1), pa.int32()), steps)
    return table.select(["g", "pos", "row"]).append_column("leaf", pa.array(leaves, pa.string())).append_column("path", paths).append_column("end", pa.array([end] * len(leaves), pa.string()))
