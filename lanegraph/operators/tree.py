"""The cells of an overlay joined into larger ones up the quadtree, and paths searched up and down it.

A cell's rim are the states where paths come in (entries) and go out (outs). Of every cell the
cheapest ways inside it from its entries to its outs are known as one matrix; those of a larger
cell follow from its parts' matrices and the arcs between the parts. A search climbs: from a
pair's starts to the outs of ever larger cells, and back from its goals to their entries. A path
is found at the smallest cell that holds it whole, by the arc that enters the goal's part last.
Then the paths found are taken apart down the tree: next to its ends a path is the pair's own, all
else are legs from a state where a cell is entered to one where it is left. Many pairs have the
same legs, so each is told once as legs of the cell's parts, down to the smallest cells.
totals() sums each leg once, from the smallest cells up; search() and shared() give pairs their
legs in the smallest cells by joins.

Rounds follow the tree's depth, and rows are one vector per pair and cell above its ends, however
long the path is. Rims grow as a map's cuts; build() gives None where one is wider than a task
should hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegraph.operators import grid
from lanegraph.operators.cell import Cell, unpacked
from lanegraph.stage import discard, materialize

#: Entries times outs of a cell's parts at most (a matrix of 128 MB), and where several levels are joined at once.
WIDEST, NARROW, LEVELS = 1 << 24, 1 << 19, 3
#: Bits of a cell's number below its graph's.
GRAPH_BITS = 54

_RIM = "cell bigint, entries array<bigint>, entry_depth array<int>, outs array<bigint>, out_depth array<int>, ways binary"
_JOINED = _RIM + (
    ", kids array<bigint>, e_state array<bigint>, e_at array<int>, own_e array<int>, o_state array<bigint>, o_at array<int>, own_o array<int>, "
    "arc_out array<int>, arc_in array<int>, arc_cost array<double>, whole binary, parts binary"
)
_VEC = "pair_id bigint, kind int, cell bigint, vec array<double>"
_LEG = "pair_id bigint, ord string, cell bigint, kind int, a bigint, b bigint"
_PART = "cell bigint, a bigint, b bigint, place string, part bigint, part_a bigint, part_b bigint"
_WALKED = "pair_id bigint, ord string, cell bigint, a bigint, b bigint, start bigint, last bigint, states array<bigint>"
_SUMMED = "pair_id bigint, cell bigint, a bigint, b bigint, start bigint, last bigint, feet double, n bigint"
_MARKED = "base bigint, geom bigint, mask int, n bigint"
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
#: Kinds of rows that climb, and of legs: to a state from the pair's starts, from a state to its goals, the whole way, and from state to state.
UP, DOWN, FOUND, INSIDE = 0, 1, 2, 3


@dataclass(frozen=True)
class Tree:
    """leaves: the rims of the overlay's cells; joined: the cells above them by their depth, from the root down."""

    leaves: DataFrame
    joined: dict[int, DataFrame]


def _shift(c: Column, by: Column) -> Column:
    return F.call_function("shiftright", c, by.cast("int"))


def _parts(cell: Column) -> tuple[Column, Column, Column]:
    """Level, column and row of a cell's number, without its graph's."""
    low = F.lit((1 << grid.DEEPEST) - 1)
    return F.shiftright(cell, 2 * grid.DEEPEST).bitwiseAND(F.lit((1 << (GRAPH_BITS - 2 * grid.DEEPEST)) - 1)), F.shiftright(cell, grid.DEEPEST).bitwiseAND(low), cell.bitwiseAND(low)


def above(cell: Column, depth: Column) -> Column:
    """The cell of that depth around a cell, in its graph."""
    level, x, y = _parts(cell)
    return F.shiftleft(F.shiftright(cell, GRAPH_BITS), GRAPH_BITS) + grid.quad_code(depth, _shift(x, level - depth), _shift(y, level - depth))


def meeting(a: Column, b: Column) -> Column:
    """Depth of the smallest cell that holds two different cells."""
    (la, xa, ya), (lb, xb, yb) = _parts(a), _parts(b)
    least = F.least(la, lb)
    apart = _shift(xa, la - least).bitwiseXOR(_shift(xb, lb - least)).bitwiseOR(_shift(ya, la - least).bitwiseXOR(_shift(yb, lb - least)))
    return (least - F.when(apart > 0, F.length(F.bin(apart))).otherwise(0)).cast("int")


def level(cell: Column) -> Column:
    """Depth of a cell."""
    return _parts(cell)[0].cast("int")


def build(cells: DataFrame, across: DataFrame) -> Tree | None:
    """The tree over packed cells; ``across``: the arcs between them (u, v, uc, vc, cost, meet: see meeting())."""
    packed = cells.filter("cell is not null").select("cell", "states", "entries", "entry_depth", "outs", "out_depth", "ways")
    leaves = materialize(packed.mapInArrow(_rims, _RIM), "tree-leaves")
    top = leaves.agg(F.max(level(F.col("cell")))).first()[0] or 0
    below, joined = leaves.limit(0), {}
    while top:
        for depth in range(max(top - LEVELS, 0), top):
            kids = below.unionByName(leaves.filter((level(F.col("cell")) > depth) & (level(F.col("cell")) <= top))).withColumn("parent", above(F.col("cell"), F.lit(depth)))
            sizes = kids.groupBy("parent").agg((F.sum(F.size("entries")) * F.sum(F.size("outs"))).alias("n"))
            widest = sizes.agg(F.max("n")).first()[0] or 0
            if widest <= NARROW:
                break
        if widest > WIDEST:
            discard(leaves, *joined.values())
            return None
        arcs = across.filter((F.col("meet") >= depth) & (F.col("meet") < top)).select(above(F.col("uc"), F.lit(depth)).alias("at"), "u", "v", "cost")
        made = kids.withColumn("depth", F.lit(depth)).groupBy("parent").cogroup(arcs.groupBy("at")).applyInArrow(_join, _JOINED)
        joined[depth] = materialize(made, "tree-joined", wide=True)
        below, top = joined[depth].select(*_names(_RIM)), depth
    return Tree(leaves, dict(sorted(joined.items())))


@dataclass(frozen=True)
class _Legs:
    """best: pair_id, cost; own: the pairs' legs at their ends, in smallest cells; ends: their starts and goals there;
    inside: their other legs, in cells of any depth; parts: by depth, how a leg inside a joined cell is told by its parts'."""

    best: DataFrame
    own: DataFrame
    ends: DataFrame
    inside: DataFrame
    parts: dict[int, DataFrame]


def _legs(tree: Tree, leaf: DataFrame, begun: DataFrame, goals: DataFrame, lot: int) -> tuple[_Legs, DataFrame]:
    """The legs, and those inside smallest cells that they are told by in the end; ``begun`` and ``goals``: see search()."""
    lot, floors, depth = max(1, lot // 4), list(tree.joined), level(F.col("cell"))
    end = lambda rows, kind, cost, whole: rows.select("pair_id", "cell", F.lit(kind).alias("kind"), "state", F.col(cost).alias("cost"), whole.alias("whole"))
    ends = materialize(end(begun, UP, "g", F.array_contains("path", F.col("state"))).unionByName(end(goals, DOWN, "out_cost", F.lit(True))).filter("cell is not null"), "tree-ends")
    # the depth of the joined cell that a cell is part of
    over = F.coalesce(*[F.when(depth > f, f) for f in reversed(floors)], F.lit(None).cast("int"))
    climbed = [materialize(_grouped(ends.drop("whole"), leaf, lot, _begin, _VEC).withColumn("over", over), "tree-climbed")]
    vecs = {}
    for f in reversed(floors):
        rows = climbed[0] if len(climbed) == 1 else climbed[0].unionByName(climbed[-1])
        vecs[f] = rows.filter((F.col("over") == f) & (F.col("kind") != FOUND)).select("pair_id", "kind", F.col("cell").alias("kid"), above(F.col("cell"), F.lit(f)).alias("cell"), "vec")
        climbed.append(materialize(_grouped(vecs[f], tree.joined[f], lot, _climb, _VEC).withColumn("over", over), "tree-climbed"))
    found = climbed[0].filter(F.col("kind") == FOUND)
    for more in climbed[1:]:
        found = found.unionByName(more.filter(F.col("kind") == FOUND))
    best = materialize(found.groupBy("pair_id").agg(F.min(F.struct(F.col("vec")[0].alias("cost"), "cell")).alias("m")).select("pair_id", "m.*"), "tree-best")
    none = F.lit(None).cast("bigint")
    legs = best.select("pair_id", F.lit("").alias("ord"), "cell", F.lit(FOUND).alias("kind"), none.alias("a"), none.alias("b"))
    for f in floors:
        open_ = legs.filter((depth == f) & (F.col("kind") != INSIDE))
        # a leg from the starts or to the goals is told from their vectors in the cell's parts
        told = vecs[f].withColumnRenamed("kind", "vec_kind").join(open_.select("pair_id", "cell").distinct(), ["pair_id", "cell"])
        legs = legs.unionByName(materialize(_grouped(open_.unionByName(told, allowMissingColumns=True), tree.joined[f], lot, _take_apart, _LEG), "tree-legs"))
    # one table each, and what is wanted as one more: plans of many tables take the driver's memory
    inside = materialize(legs.filter(F.col("kind") == INSIDE).drop("kind"), "tree-inside")
    own = materialize(legs.filter(F.col("kind") != INSIDE).join(tree.leaves.select("cell"), "cell", "left_semi"), "tree-ends")
    wanted, parts = materialize(inside.select("cell", "a", "b").distinct(), "tree-wanted"), {}
    for f in floors:
        parts[f] = materialize(_once(wanted.filter(depth == f).distinct(), tree.joined[f], _tell, _PART), "tree-parts")
        wanted = wanted.unionByName(parts[f].select(F.col("part").alias("cell"), F.col("part_a").alias("a"), F.col("part_b").alias("b")))
    return _Legs(best.select("pair_id", "cost"), own, ends, inside, parts), wanted.distinct().join(tree.leaves.select("cell"), "cell", "left_semi")


def _walks(tree: Tree, cells: DataFrame, begun: DataFrame, goals: DataFrame, lot: int, what, schema: str) -> tuple[_Legs, DataFrame, DataFrame]:
    """The legs, ``what`` of the pairs' own in smallest cells, and of all other legs there, each once."""
    leaf = cells.filter("cell is not null").drop("ways")
    legs, once = _legs(tree, leaf, begun, goals, lot)
    own = materialize(_grouped(_with_ends(legs.own, legs.ends), leaf, max(1, lot // 4), what, schema), "tree-own")
    return legs, own, materialize(_once(once.withColumn("kind", F.lit(INSIDE)), leaf, what, schema), "tree-once")


def _with_ends(own: DataFrame, ends: DataFrame) -> DataFrame:
    """Own legs, and the starts and goals that they may begin or end at."""
    at = ends.join(own.select("pair_id", "cell").distinct(), ["pair_id", "cell"]).withColumnRenamed("kind", "end_kind")
    return own.unionByName(at, allowMissingColumns=True)


def search(tree: Tree, cells: DataFrame, begun: DataFrame, goals: DataFrame, lot: int) -> DataFrame:
    """pair_id, cost, start, last (states) and after (the states behind the start) of every pair's cheapest path.

    ``begun``: pair_id, state, cell, g, path; ``goals``: pair_id, state, cell, out_cost.
    """
    legs, own, once = _walks(tree, cells, begun, goals, lot, _walk, _WALKED)
    passed = _spelled(legs).join(once.select("cell", "a", "b", "states"), ["cell", "a", "b"])
    walked = own.select("pair_id", "ord", "start", "last", "states").unionByName(passed.select("pair_id", "ord", "states"), allowMissingColumns=True)
    paths = walked.groupBy("pair_id").agg(F.max("start").alias("start"), F.max("last").alias("last"), F.sort_array(F.collect_list(F.struct("ord", "states"))).alias("l"))
    return materialize(legs.best.join(paths, "pair_id").select("pair_id", "cost", "start", "last", F.flatten(F.transform("l", lambda x: x["states"])).alias("after")), "tree-paths")


def totals(tree: Tree, cells: DataFrame, begun: DataFrame, goals: DataFrame, lot: int) -> DataFrame:
    """pair_id, cost, start, last, after_ft and n_after: feet and number of the states behind the start."""
    legs, own, once = _walks(tree, cells, begun, goals, lot, _sum, _SUMMED)
    summed = once.select("cell", "a", "b", "feet", "n")
    for f in reversed(legs.parts):
        of = summed.withColumnsRenamed({"cell": "part", "a": "part_a", "b": "part_b"})
        more = legs.parts[f].join(of.hint("merge"), ["part", "part_a", "part_b"]).groupBy("cell", "a", "b").agg(F.sum("feet").alias("feet"), F.sum("n").alias("n"))
        summed = summed.unionByName(materialize(more, "tree-summed"))
    passed = legs.inside.join(summed.hint("merge"), ["cell", "a", "b"]).select("pair_id", "feet", "n")
    each = own.select("pair_id", "start", "last", "feet", "n").unionByName(passed, allowMissingColumns=True)
    return materialize(legs.best.join(each.groupBy("pair_id").agg(F.max("start").alias("start"), F.max("last").alias("last"), F.sum("feet").alias("after_ft"), F.sum("n").alias("n_after")), "pair_id"), "tree-totals")


def shared(tree: Tree, cells: DataFrame, begun: DataFrame, goals: DataFrame, lot: int, runs: int) -> DataFrame:
    """base, mask, n: how many streets are on the paths of just those runs of a base whose bits are set; pair_id is base * ``runs`` + run."""
    leaf = cells.filter("cell is not null").drop("ways")
    legs, _ = _legs(tree, leaf, begun, goals, lot)
    here = F.col("cell").bitwiseAND(F.lit((1 << GRAPH_BITS) - 1)).alias("here")
    passed = _spelled(legs, ordered=False).join(tree.leaves.select("cell"), "cell", "left_semi").withColumn("kind", F.lit(INSIDE))
    rows = _with_ends(legs.own.unionByName(passed), legs.ends).select("*", here, F.floor(F.col("pair_id") / runs).alias("base"), (F.col("pair_id") % runs).cast("int").alias("run"))
    rows = materialize(rows, "tree-rows")
    # cells of all runs over one place, and the legs of some bases there
    lots = rows.groupBy("here").agg(F.ceil(F.approx_count_distinct("base") / (4 * lot)).alias("lots"))
    dealt = rows.join(lots.hint("merge"), "here").withColumn("lot", F.pmod(F.xxhash64("base"), F.col("lots"))).drop("lots")
    packed = leaf.withColumn("here", here).join(lots.hint("merge"), "here").withColumn("lot2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1))).drop("lots").withColumnsRenamed({"here": "here2", "cell": "cell2"})
    marked = materialize(dealt.groupBy("here", "lot").cogroup(packed.groupBy("here2", "lot2")).applyInArrow(_mark, _MARKED), "tree-marked")
    counts = by_mask(marked.filter("geom is not null").drop("n")).unionByName(marked.filter("geom is null").drop("geom"))
    return counts.groupBy("base", "mask").agg(F.sum("n").alias("n"))


def by_mask(rows: DataFrame) -> DataFrame:
    """base, mask, n from base, geom, mask (of one run or several): each street of a base counts once."""
    each = rows.groupBy("base", "geom").agg(F.bit_or("mask").alias("mask"))
    return each.groupBy("base", "mask").agg(F.count("*").alias("n"))


def _spelled(legs: _Legs, ordered: bool = True) -> DataFrame:
    """pair_id, ord, cell, a, b: the pairs' legs in cells of any depth, with all legs that these are told by."""
    spelled = legs.inside if ordered else legs.inside.withColumn("ord", F.lit(""))
    for f, parts in legs.parts.items():
        here = spelled.filter(level(F.col("cell")) == f).join(parts.hint("merge"), ["cell", "a", "b"])
        order = F.concat("ord", "place") if ordered else F.lit("")
        more = here.select("pair_id", order.alias("ord"), F.col("part").alias("cell"), F.col("part_a").alias("a"), F.col("part_b").alias("b"))
        spelled = spelled.unionByName(materialize(more, "tree-spelled"))
    return spelled


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def _grouped(rows: DataFrame, cells: DataFrame, lot: int, what, schema: str) -> DataFrame:
    """``what`` of the rows of each cell, in lots of some ``lot`` pairs, and the cell's packed row."""
    lots = rows.groupBy("cell").agg(F.ceil(F.approx_count_distinct("pair_id") / lot).alias("lots"))
    dealt = rows.join(lots, "cell").withColumn("lot", F.pmod(F.xxhash64("pair_id"), F.col("lots"))).drop("lots")
    packed = cells.join(lots, "cell").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1))).drop("lots").withColumnsRenamed({"cell": "cell2", "lot": "lot2"})
    return dealt.groupBy("cell", "lot").cogroup(packed.groupBy("cell2", "lot2")).applyInArrow(what, schema)


def _once(legs: DataFrame, cells: DataFrame, what, schema: str) -> DataFrame:
    """``what`` of different legs (cell, a, b) of each cell, and the cell's packed row: as many as a cell's rim allows at most."""
    asked = cells.join(legs.select("cell").distinct().hint("merge"), "cell", "left_semi").withColumnRenamed("cell", "cell2")
    return legs.groupBy("cell").cogroup(asked.groupBy("cell2")).applyInArrow(what, schema)


def _table(rows: dict[str, list], schema: str) -> pa.Table:
    kinds = dict(f.split(" ") for f in schema.split(", "))
    return pa.table({n: pa.array(rows[n], _KINDS[kinds[n]]) for n in kinds})


def _rims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each packed cell's rim: an out has one place, whatever arcs leave it."""
    for batch in batches:
        got: dict[str, list] = {n: [] for n in ("cell", "entries", "entry_depth", "outs", "out_depth", "ways")}
        for row in batch.to_pylist():
            states, outs = np.asarray(row["states"], np.int64), np.asarray(row["outs"], np.int64)
            own, first, arc = np.unique(outs, return_index=True, return_inverse=True)
            depth = np.full(len(own), grid.DEEPEST)
            np.minimum.at(depth, arc, np.asarray(row["out_depth"], np.int64))
            ways = np.frombuffer(row["ways"]).reshape(len(row["entries"]), len(outs))[:, first]
            for n, x in zip(got, (row["cell"], states[np.asarray(row["entries"], np.int64)], row["entry_depth"], states[own], depth, np.ascontiguousarray(ways).tobytes()), strict=True):
                got[n].append(x)
        yield from _table(got, _RIM).to_batches()


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least sums over the middle: rows of ``a`` by columns of ``b``."""
    out = np.full((len(a), b.shape[1]), np.inf)
    for k in range(len(b)):
        np.minimum(out, a[:, k, None] + b[k], out=out)
    return out


class _Arcs:
    """The arcs between a cell's parts, from an out's place to an entry's."""

    def __init__(self, out, into, cost):
        self.out, self.into, self.cost = np.asarray(out, np.int64), np.asarray(into, np.int64), np.asarray(cost, float)
        self._by = {id_: np.argsort(x, kind="stable") for id_, x in (("out", self.out), ("into", self.into))}
        self.outs, self._o = np.unique(self.out[self._by["out"]], return_index=True)
        self.ins, self._i = np.unique(self.into[self._by["into"]], return_index=True)

    def ahead(self, costs: np.ndarray) -> np.ndarray:
        """Costs at ``ins`` from those at all outs."""
        by = self._by["into"]
        return np.minimum.reduceat(costs[:, self.out[by]] + self.cost[by], self._i, axis=1) if len(by) else np.empty((len(costs), 0))

    def behind(self, costs: np.ndarray) -> np.ndarray:
        """Costs from ``outs`` on, from those from all entries on."""
        by = self._by["out"]
        return np.minimum.reduceat(costs[:, self.into[by]] + self.cost[by], self._o, axis=1) if len(by) else np.empty((len(costs), 0))


def _join(kids: pa.Table, arcs: pa.Table) -> pa.Table:
    """A cell from its parts: the costs inside it from all parts' entries to all parts' outs."""
    if not kids.num_rows:
        return _table({n: [] for n in _names(_JOINED)}, _JOINED)
    kids = kids.sort_by("cell").to_pydict()
    cat = lambda name, kind: np.concatenate([np.asarray(x, kind) for x in kids[name]])
    e_state, e_depth, o_state, o_depth = cat("entries", np.int64), cat("entry_depth", np.int64), cat("outs", np.int64), cat("out_depth", np.int64)
    e_at, o_at = (np.cumsum([0, *(len(x) for x in kids[n])]) for n in ("entries", "outs"))
    place = lambda states, want: (order := np.argsort(states, kind="stable"))[np.searchsorted(states, want, sorter=order)]
    between = _Arcs(place(o_state, arcs["u"].to_numpy()) if arcs.num_rows else [], place(e_state, arcs["v"].to_numpy()) if arcs.num_rows else [], arcs["cost"].to_numpy())
    whole = np.full((len(e_state), len(o_state)), np.inf)
    parts = []
    for k, ways in enumerate(kids["ways"]):
        e, o = slice(e_at[k], e_at[k + 1]), slice(o_at[k], o_at[k + 1])
        whole[e, o] = np.frombuffer(ways).reshape(e.stop - e.start, o.stop - o.start)
        mine = np.flatnonzero((between.ins >= e.start) & (between.ins < e.stop))
        parts.append((o, mine, whole[between.ins[mine], o].copy()))
    rows, fresh = np.arange(len(e_state)), whole.copy()
    while len(between.out) and len(rows):
        reached = between.ahead(fresh)
        new = np.full((len(rows), len(o_state)), np.inf)
        for o, mine, ways in parts:
            if len(mine):
                new[:, o] = _least(reached[:, mine], ways)
        better = new < whole[rows]
        whole[rows] = np.minimum(whole[rows], new)
        changed = better.any(1)
        rows, fresh = rows[changed], np.where(better, new, np.inf)[changed]
    depth = kids["depth"][0]
    own_e, own_o = np.flatnonzero(e_depth < depth), np.flatnonzero(o_depth < depth)
    row = {
        "cell": kids["parent"][0], "entries": e_state[own_e], "entry_depth": e_depth[own_e], "outs": o_state[own_o], "out_depth": o_depth[own_o], "ways": np.ascontiguousarray(whole[np.ix_(own_e, own_o)]).tobytes(),
        "kids": kids["cell"], "e_state": e_state, "e_at": e_at, "own_e": own_e, "o_state": o_state, "o_at": o_at, "own_o": own_o, "arc_out": between.out, "arc_in": between.into, "arc_cost": between.cost, "whole": whole.tobytes(), "parts": b"".join(kids["ways"]),
    }
    return _table({n: [row[n]] for n in _names(_JOINED)}, _JOINED)


class _Joined:
    """A joined cell's row as arrays."""

    def __init__(self, packed: pa.Table):
        get = lambda name: packed[name][0].values.to_numpy()
        self.cell, self.kids = packed["cell2"][0].as_py(), get("kids").tolist()
        self.e_state, self.e_at, self.own_e, self.o_state, self.o_at, self.own_o = (get(n) for n in ("e_state", "e_at", "own_e", "o_state", "o_at", "own_o"))
        self.arcs = _Arcs(get("arc_out"), get("arc_in"), get("arc_cost"))
        self.whole = np.frombuffer(packed["whole"][0].as_py()).reshape(len(self.e_state), len(self.o_state))
        parts, size = np.frombuffer(packed["parts"][0].as_py()), np.diff(self.e_at) * np.diff(self.o_at)
        self.ways = [x.reshape(e, o) for x, e, o in zip(np.split(parts, np.cumsum(size)[:-1]), np.diff(self.e_at), np.diff(self.o_at), strict=True)]
        self.kid_of = {k: n for n, k in enumerate(self.kids)}
        self.e_place, self.o_place = ({int(s): k for k, s in enumerate(x)} for x in (self.e_state, self.o_state))
        self._walks: dict[tuple[int, int], list] = {}
        self._leaving: dict[int, np.ndarray] = {}

    def spread(self, rows: list[int], n: int, kinds: list[int], kids: list[int], vecs: list) -> tuple[np.ndarray, np.ndarray]:
        """The parts' vectors of n pairs side by side: from the starts to all outs, and from all entries to the goals."""
        up, down = np.full((n, len(self.o_state)), np.inf), np.full((n, len(self.e_state)), np.inf)
        for row, kind, kid, vec in zip(rows, kinds, kids, vecs, strict=True):
            k = self.kid_of[kid]
            if kind == UP:
                up[row, self.o_at[k] : self.o_at[k + 1]] = vec
            else:
                down[row, self.e_at[k] : self.e_at[k + 1]] = vec
        return up, down

    def all_up(self, up: np.ndarray) -> np.ndarray:
        return np.minimum(up, _least(self.arcs.ahead(up), self.whole[self.arcs.ins]))

    def all_down(self, down: np.ndarray) -> np.ndarray:
        return np.minimum(down, _least(self.arcs.behind(down), self.whole[:, self.arcs.outs].T))

    def kid(self, at: np.ndarray, place: int) -> int:
        return int(np.searchsorted(at, place, side="right")) - 1

    def leaving(self, k: int) -> np.ndarray:
        """The arcs that leave a part."""
        if k not in self._leaving:
            self._leaving[k] = np.flatnonzero((self.arcs.out >= self.o_at[k]) & (self.arcs.out < self.o_at[k + 1]))
        return self._leaving[k]

    def walk(self, a: int, b: int) -> list[tuple[int, int, int]]:
        """The way from an entry to an out: (part, from, to)."""
        if (a, b) not in self._walks:
            at, out = a, []
            while True:
                k = self.kid(self.e_at, at)
                lo, hi = self.o_at[k], self.o_at[k + 1]
                ways, mine = self.ways[k][at - self.e_at[k]], self.leaving(k)
                total = ways[self.arcs.out[mine] - lo] + self.arcs.cost[mine] + self.whole[self.arcs.into[mine], b]
                if lo <= b < hi and ways[b - lo] <= total.min(initial=np.inf):
                    out.append((k, at, b))
                    break
                arc = mine[total.argmin()]
                out.append((k, at, int(self.arcs.out[arc])))
                at = int(self.arcs.into[arc])
            self._walks[a, b] = out
        return self._walks[a, b]


def _begin(ends: pa.Table, packed: pa.Table) -> pa.Table:
    """In a cell of the overlay: from the starts to its outs, from its entries to the goals, and ways that stay inside."""
    got: dict[str, list] = {n: [] for n in _names(_VEC)}
    if ends.num_rows and packed.num_rows:
        cell, number = unpacked(packed), packed["cell2"][0].as_py()
        pair, kind, at, cost = ends["pair_id"].to_numpy(), ends["kind"].to_numpy(), cell.index(ends["state"].to_numpy()), ends["cost"].to_numpy()
        first = np.unique(cell.outs, return_index=True)[1]
        starts, row = np.unique(at[kind == UP], return_inverse=True)
        away = cell.out_of(starts)[:, first] if len(starts) else np.empty((0, len(first)))
        cell.toward(at[kind == DOWN])
        for p in np.unique(pair):
            up, down = np.flatnonzero((pair == p) & (kind == UP)), np.flatnonzero((pair == p) & (kind == DOWN))
            vecs = []
            if len(up) and len(first):
                vecs.append((UP, (cost[up][:, None] + away[np.searchsorted(starts, at[up])]).min(0)))
            if len(down):
                to = np.stack([cell.to(int(e)) for e in at[down]]) + cost[down][:, None]
                if len(cell.entries):
                    vecs.append((DOWN, to[:, cell.entries].min(0)))
                if len(up):
                    vecs.append((FOUND, np.array([(to[:, at[up]] + cost[up]).min()])))
            _put(got, int(p), number, vecs)
    return _table(got, _VEC)


def _put(got: dict[str, list], pair: int, cell: int, vecs: list) -> None:
    for kind, vec in vecs:
        if np.isfinite(vec).any():
            for n, x in zip(got, (pair, kind, cell, vec), strict=True):
                got[n].append(x)


def _climb(rows: pa.Table, packed: pa.Table) -> pa.Table:
    """From the parts of a cell to the cell."""
    got: dict[str, list] = {n: [] for n in _names(_VEC)}
    if rows.num_rows and packed.num_rows:
        cell = _Joined(packed)
        pairs, row = np.unique(rows["pair_id"].to_numpy(), return_inverse=True)
        up, down = cell.spread(row.tolist(), len(pairs), rows["kind"].to_pylist(), rows["kid"].to_pylist(), [v.values.to_numpy() for v in rows["vec"]])
        up, last = cell.all_up(up), down
        down = cell.all_down(down)
        found = (up[:, cell.arcs.out] + cell.arcs.cost + last[:, cell.arcs.into]).min(1, initial=np.inf)
        for k, p in enumerate(pairs.tolist()):
            _put(got, p, cell.cell, [(UP, up[k, cell.own_o]), (DOWN, down[k, cell.own_e]), (FOUND, found[k : k + 1])])
    return _table(got, _VEC)


def _take_apart(rows: pa.Table, packed: pa.Table) -> pa.Table:
    """The legs of a cell as legs of its parts."""
    got: dict[str, list] = {n: [] for n in _names(_LEG)}
    if rows.num_rows and packed.num_rows:
        cell, col = _Joined(packed), rows.to_pydict()
        legs = [k for k, kind in enumerate(col["kind"]) if kind is not None]
        vecs = [k for k, kind in enumerate(col["kind"]) if kind is None]
        pairs = {p: k for k, p in enumerate(sorted({col["pair_id"][k] for k in vecs}))}
        up, down = cell.spread([pairs[col["pair_id"][k]] for k in vecs], len(pairs), *([col[n][k] for k in vecs] for n in ("vec_kind", "kid", "vec")))
        all_up, arcs = cell.all_up(up), cell.arcs
        part = lambda kind, k, a, b: (kind, k, None if a is None else int(cell.e_state[a]), None if b is None else int(cell.o_state[b]))
        inside = lambda a, b: [part(INSIDE, *w) for w in cell.walk(a, b)]

        def from_starts(p: int, b: int) -> list:
            total = up[p, arcs.out] + arcs.cost + cell.whole[arcs.into, b]
            if up[p, b] <= total.min(initial=np.inf):
                return [part(UP, cell.kid(cell.o_at, b), None, b)]
            j = total.argmin()
            return [part(UP, cell.kid(cell.o_at, arcs.out[j]), None, arcs.out[j]), *inside(int(arcs.into[j]), b)]

        def to_goals(p: int, a: int) -> list:
            total = cell.whole[a, arcs.out] + arcs.cost + down[p, arcs.into]
            if down[p, a] <= total.min(initial=np.inf):
                return [part(DOWN, cell.kid(cell.e_at, a), a, None)]
            j = total.argmin()
            return [*inside(a, int(arcs.out[j])), part(DOWN, cell.kid(cell.e_at, arcs.into[j]), arcs.into[j], None)]

        for k in legs:
            kind, p = col["kind"][k], pairs[col["pair_id"][k]]
            if kind == UP:
                made = from_starts(p, cell.o_place[col["b"][k]])
            elif kind == DOWN:
                made = to_goals(p, cell.e_place[col["a"][k]])
            else:
                j = (all_up[p, arcs.out] + arcs.cost + down[p, arcs.into]).argmin()
                made = [*from_starts(p, int(arcs.out[j])), part(DOWN, cell.kid(cell.e_at, arcs.into[j]), arcs.into[j], None)]
            for n, leg in enumerate(made):
                for name, x in zip(got, (col["pair_id"][k], f"{col['ord'][k]}{n:05x}", cell.kids[leg[1]], leg[0], *leg[2:]), strict=True):
                    got[name].append(x)
    return _table(got, _LEG)


def _tell(rows: pa.Table, packed: pa.Table) -> pa.Table:
    """Legs inside a cell as legs of its parts, numbered in their order."""
    got: dict[str, list] = {n: [] for n in _names(_PART)}
    if rows.num_rows and packed.num_rows:
        cell = _Joined(packed)
        for a, b in zip(rows["a"].to_pylist(), rows["b"].to_pylist(), strict=True):
            for n, (k, at, out) in enumerate(cell.walk(cell.e_place[a], cell.o_place[b])):
                for name, x in zip(got, (cell.cell, a, b, f"{n:05x}", cell.kids[k], int(cell.e_state[at]), int(cell.o_state[out])), strict=True):
                    got[name].append(x)
    return _table(got, _PART)


def _walked(col: dict[str, list], cells: dict[int, Cell]) -> Iterator[tuple[int, Cell, int, list[int]]]:
    """Of each leg in smallest cells its row, cell, first state and the states on it by index, that of the pair's start left out."""
    ends: dict[tuple[int, int, int], list] = {}
    index = lambda k, name: int(cells[col["cell"][k]].index(col[name][k]))
    n, aims = len(col["cell"]), {}
    for k, kind in enumerate(col.get("end_kind", [])):
        if kind is not None:
            ends.setdefault((col["cell"][k], col["pair_id"][k], kind), []).append((index(k, "state"), col["cost"][k]))
    legs = [k for k in range(n) if col["kind"][k] is not None]
    spots = {}
    for k in legs:
        cell, kind = col["cell"][k], col["kind"][k]
        starts = ends[cell, col["pair_id"][k], UP] if kind in (UP, FOUND) else [(index(k, "a"), 0.0)]
        goals = ends[cell, col["pair_id"][k], DOWN] if kind in (DOWN, FOUND) else [(index(k, "b"), 0.0)]
        spots[k] = starts, goals
        aims.setdefault(cell, set()).update(t for t, _ in goals)
    for cell, some in aims.items():
        cells[cell].toward(np.array(sorted(some)))
    for k in legs:
        cell, (starts, goals) = cells[col["cell"][k]], spots[k]
        a, b = (starts[0][0], goals[0][0]) if len(starts) == len(goals) == 1 else min((g + cell.to(t)[s] + out, s, t) for s, g in starts for t, out in goals)[1:]
        yield k, cell, a, cell.way(a, b) if col["kind"][k] in (UP, FOUND) else [a, *cell.way(a, b)]


def _walk(rows: pa.Table, packed: pa.Table) -> pa.Table:
    """The states of the legs inside one cell of the overlay."""
    return _each(rows, packed, _WALKED, lambda cell, way: (cell.states[way].tolist(),))


def _sum(rows: pa.Table, packed: pa.Table) -> pa.Table:
    """Feet and number of these states."""
    return _each(rows, packed, _SUMMED, lambda cell, way: (float(cell.feet[way].sum()), len(way)))


def _each(rows: pa.Table, packed: pa.Table, schema: str, tell) -> pa.Table:
    """A row for each leg, with the pair's start and last state where it begins or ends a path, and what ``tell`` says."""
    got: dict[str, list] = {n: [] for n in _names(schema)}
    if rows.num_rows and packed.num_rows:
        col = rows.to_pydict()
        names = _names(schema)
        heads = [col.get(n, [None] * rows.num_rows) for n in names[: names.index("start")]]
        for k, cell, a, way in _walked(col, {packed["cell2"][0].as_py(): unpacked(packed)}):
            kind = col["kind"][k]
            start = int(cell.states[a]) if kind in (UP, FOUND) else None
            last = int(cell.states[way[-1] if way else a]) if kind in (DOWN, FOUND) else None
            for name, x in zip(got, (*(h[k] for h in heads), start, last, *tell(cell, way)), strict=True):
                got[name].append(x)
    return _table(got, schema)


def _mark(rows: pa.Table, packed: pa.Table) -> pa.Table:
    """In the cells of all runs over one place: the streets that lie there whole by the runs that pass them, counted, and the others one by one."""
    got: dict[str, list] = {n: [] for n in _names(_MARKED)}
    if rows.num_rows and packed.num_rows:
        col = rows.drop_columns(["base", "run", "lot", "here"]).to_pydict()
        cells = {c: unpacked(packed, k) for k, c in enumerate(packed["cell2"].to_pylist())}
        geoms = np.unique(np.concatenate([c.geom for c in cells.values()]))
        split = np.zeros(len(geoms), bool)
        spot = {}
        for number, c in cells.items():
            spot[id(c)] = np.searchsorted(geoms, c.geom)
            split[spot[id(c)]] |= c.split
        bases, row = np.unique(rows["base"].to_numpy(), return_inverse=True)
        bit = (1 << rows["run"].to_numpy()).tolist()
        marks, row = np.zeros((len(bases), len(geoms)), np.int32), row.tolist()
        whole = {(c, p, s): w for c, p, s, w, kind in zip(*(col[n] for n in ("cell", "pair_id", "state", "whole", "end_kind")), strict=True) if kind == UP}
        for k, cell, a, way in _walked(col, cells):
            if col["kind"][k] in (UP, FOUND) and whole[col["cell"][k], col["pair_id"][k], int(cell.states[a])]:
                way = [a, *way]
            marks[row[k], spot[id(cell)][way]] |= bit[k]
        at, geom = np.nonzero(marks * split)
        one = marks[:, ~split]
        for base, masks in zip(bases.tolist(), one, strict=True):
            mask, n = np.unique(masks[masks > 0], return_counts=True)
            got["base"] += [base] * len(mask)
            got["geom"] += [None] * len(mask)
            got["mask"] += mask.tolist()
            got["n"] += n.tolist()
        got["base"] += bases[at].tolist()
        got["geom"] += geoms[geom].tolist()
        got["mask"] += marks[at, geom].tolist()
        got["n"] += [1] * len(at)
    return _table(got, _MARKED)
