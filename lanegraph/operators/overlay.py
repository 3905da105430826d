"""Shortest paths across a large map over an overlay of cells.

The state of a path is the directed edge last taken (see routing.py). States are dealt to the
cells of a quadtree, so none holds more than a given number. Per cell the cheapest ways from
each state where paths come in to each state where they go out are computed once, in one matrix.
Where cuts of the map are of a size that a task can hold, these cells are joined into larger
ones up the quadtree and rounds follow its depth (tree.py). Of wider maps a search goes from cell
to cell: a round takes all pairs' states at the border of a cell to
the borders of its neighbours, by that matrix, so rounds follow the cells that a path crosses
and not its edges; only the first and the last cell are searched inside.

Two passes: the first keeps one state per pair and cell, which is quick and ends with some way
to the goal; its cost is the bound by which the second, which keeps every state, drops what
cannot be better (cost so far, and a foot a unit as the crow flies). What is known of a pair and
state is one row of one table, rewritten each round, with the state it came from. At the end
pointer jumping over these finds the states on the best paths, and the edges between two of
them are found inside their cell. Paths and costs are those of Dijkstra over edge states.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.functions import geo
from lanegraph.operators import grid, tree
from lanegraph.operators.cell import Cell, unpacked
from lanegraph.stage import discard, materialize, scoped

#: States of a cell at most, and pairs that meet one cell in one group on average.
CELL_STATES, LOT = 512, 1024

_PACKED = (
    "cell bigint, states array<bigint>, lon array<double>, lat array<double>, feet array<double>, geom array<bigint>, split array<boolean>, a array<int>, b array<int>, c array<double>, "
    "entries array<int>, entry_depth array<int>, outs array<int>, out_depth array<int>, out_cost array<double>, out_state array<bigint>, out_cell array<bigint>, ways binary"
)
_STEP = "pair_id bigint, arrived boolean, state bigint, cell bigint, g double, parent bigint, last bigint"


@dataclass(frozen=True)
class Overlay:
    """places: state, cell, node (it ends at); cells: one packed row each; above: the tree over them, None where its rims are too wide."""

    places: DataFrame
    cells: DataFrame
    above: tree.Tree | None = None


def build(edges: DataFrame, steps: DataFrame, most: int = CELL_STATES) -> Overlay:
    """The overlay of ``edges`` (edge_id, dst, dlon, dlat, len_ft, cost; blocked ones are left out) and ``steps``, their transitions.

    Edges may have a ``graph`` (0, 1, ...): graphs over the same places that no step joins. Each
    has cells of its own, of at most ``most`` states on average. They may have a ``geom``, which
    both directions and all graphs share: what shared() counts.
    """
    usable = edges if "graph" in edges.columns else edges.withColumn("graph", F.lit(0))
    usable = usable if "geom" in edges.columns else usable.withColumn("geom", F.col("edge_id"))
    own = usable.filter("cost is not null").select(F.col("edge_id").alias("state"), F.col("dst").alias("node"), F.col("dlon").alias("lon"), F.col("dlat").alias("lat"), F.col("len_ft").cast("double").alias("feet"), F.col("geom").cast("bigint").alias("geom"), "graph")
    graphs = own.agg(F.count_distinct("graph")).first()[0]
    dealt = grid.quad_cells(own, "lon", "lat", most * max(graphs, 1))
    places = materialize(dealt.withColumn("cell", F.shiftleft(F.col("graph").cast("bigint"), tree.GRAPH_BITS) + F.col("cell")).drop("graph"), "overlay-places")
    end = lambda c, cell: places.select(F.col("state").alias(c), F.col("cell").alias(cell))
    arcs = steps.select(F.col("prev_edge").alias("u"), F.col("next_edge").alias("v"), "cost").join(end("u", "uc"), "u").join(end("v", "vc"), "v")
    arcs = materialize(arcs.groupBy("u", "v", "uc", "vc").agg(F.min("cost").alias("cost")), "overlay-arcs")
    across = arcs.filter("uc <> vc").withColumn("meet", tree.meeting(F.col("uc"), F.col("vc")))
    row = lambda rows, cell, kind, u, v, other, x, y, z: rows.select(F.col(cell).alias("cell"), F.lit(kind).alias("kind"), F.col(u).alias("u"), F.col(v).alias("v"), F.col(other).alias("other"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))
    here = F.col("cell").bitwiseAND(F.lit((1 << tree.GRAPH_BITS) - 1))
    split = places.withColumn("here", here).groupBy("geom").agg((F.min("here") < F.max("here")).cast("bigint").alias("split")) if "geom" in edges.columns else None
    dealt = places.join(split.hint("merge"), "geom") if split is not None else places.withColumn("split", F.lit(0).cast("bigint"))
    rows = (
        row(dealt, "cell", "state", "state", "geom", "split", "lon", "lat", "feet")
        .unionByName(row(arcs.filter("uc = vc"), "uc", "inner", "u", "v", "vc", "cost", "cost", "cost"))
        .unionByName(row(across, "uc", "out", "u", "v", "vc", "cost", "meet", "cost"))
        .unionByName(row(across.groupBy("v", "vc").agg(F.min("meet").alias("meet")), "vc", "entry", "v", "v", "vc", "meet", "meet", "meet"))
    )
    cells = materialize(rows.groupBy("cell").applyInArrow(_pack, _PACKED), "overlay-cells", wide=True)
    joined = tree.build(cells, across)
    discard(arcs)
    return Overlay(places, cells, joined)


@scoped("overlay-found")
def search(overlay: Overlay, edges: DataFrame, entries: DataFrame, exits: DataFrame) -> DataFrame:
    """Cheapest way from any entry to any exit of every pair: pair_id, cost, feet, path (edge ids). Pairs without a way have no row.

    ``entries``: pair_id, edge_id (the edge taken so far, whole or in part), g, feet (of a part),
    path; ``exits``: pair_id, node_id, cost, feet, lon, lat (of the goal).
    """
    begun, goals = _ends(overlay, entries, exits)
    found = tree.search(overlay.above, overlay.cells, begun, goals, LOT) if overlay.above else _by_rounds(overlay, begun, goals)
    paths = materialize(_whole(found, begun, goals).select("pair_id", "cost", F.concat("before", "after").alias("path"), (F.col("feet") + F.col("out_ft")).alias("part_ft")), "overlay-paths")
    between = paths.select("pair_id", F.explode("path").alias("edge_id")).join(edges.select("edge_id", "len_ft"), "edge_id").groupBy("pair_id").agg(F.sum("len_ft").alias("whole_ft"))
    return paths.join(between, "pair_id", "left").select("pair_id", "cost", (F.col("part_ft") + F.coalesce("whole_ft", F.lit(0.0))).alias("feet"), "path")


@scoped("overlay-totals")
def totals(overlay: Overlay, edges: DataFrame, entries: DataFrame, exits: DataFrame) -> DataFrame:
    """Cost and feet of the paths of search(), and n_edges, those in ``path``: each way through a cell is summed once for all pairs, and no path is written out."""
    begun, goals = _ends(overlay, entries, exits)
    if not overlay.above:
        return search(overlay, edges, entries, exits).select("pair_id", "cost", "feet", F.size("path").alias("n_edges"))
    whole = _whole(tree.totals(overlay.above, overlay.cells, begun, goals, LOT), begun, goals)
    own = begun.select(F.explode("path").alias("edge_id")).distinct().join(edges.select("edge_id", "len_ft"), "edge_id")
    before = whole.select("pair_id", F.explode("before").alias("edge_id")).join(own.hint("merge"), "edge_id").groupBy("pair_id").agg(F.sum("len_ft").alias("before_ft"))
    feet = F.col("feet") + F.col("out_ft") + F.coalesce("before_ft", F.lit(0.0)) + F.col("after_ft")
    return whole.join(before, "pair_id", "left").select("pair_id", "cost", feet.alias("feet"), (F.size("before") + F.col("n_after")).cast("int").alias("n_edges"))


@scoped("overlay-shared")
def shared(overlay: Overlay, edges: DataFrame, entries: DataFrame, exits: DataFrame, runs: int) -> DataFrame:
    """Of the paths of search(), whose pair_id is base * ``runs`` + run: base, mask, n, the streets (``geom``) that the base's paths have in common.

    ``n`` streets are on the paths of the runs whose bits are set in ``mask``, and no others. Of
    an entry, ``path`` is its edge or nothing. Paths are compared cell by cell and not written out.
    """
    begun, goals = _ends(overlay, entries, exits)
    if overlay.above:
        return tree.shared(overlay.above, overlay.cells, begun, goals, LOT, runs)
    passed = search(overlay, edges, entries, exits).select("pair_id", F.explode("path").alias("edge_id")).join(edges.select("edge_id", "geom"), "edge_id")
    return tree.by_mask(passed.select(F.floor(F.col("pair_id") / runs).alias("base"), "geom", F.call_function("shiftleft", F.lit(1), (F.col("pair_id") % runs).cast("int")).alias("mask")))


def _ends(overlay: Overlay, entries: DataFrame, exits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and exits as states in their cells."""
    place = overlay.places.select(F.col("state"), "cell")
    begun = entries.groupBy("pair_id", F.col("edge_id").alias("state")).agg(F.min(F.struct("g", "feet", "path")).alias("m")).select("pair_id", "state", "m.*")
    at = exits.select("pair_id", F.col("node_id").alias("node"), F.col("cost").alias("out_cost"), F.col("feet").alias("out_ft"), F.col("lon").alias("glon"), F.col("lat").alias("glat"))
    return materialize(begun.join(place, "state"), "overlay-begun"), materialize(at.join(overlay.places.select("state", "cell", "node"), "node"), "overlay-goals")


def _whole(found: DataFrame, begun: DataFrame, goals: DataFrame) -> DataFrame:
    """Paths found with what belongs to their start (feet, before) and their last state (out_ft)."""
    first = begun.select("pair_id", F.col("state").alias("start"), "feet", F.col("path").alias("before"))
    out_ft = goals.groupBy("pair_id", F.col("state").alias("last")).agg(F.min(F.struct("out_cost", "out_ft")).alias("o")).select("pair_id", "last", "o.out_ft")
    return found.join(first, ["pair_id", "start"]).join(out_ft, ["pair_id", "last"])


def _by_rounds(overlay: Overlay, begun: DataFrame, goals: DataFrame) -> DataFrame:
    """pair_id, cost, start, last (states) and after (the states behind the start), cell by cell."""
    aims = materialize(goals.groupBy("pair_id").agg(F.first("glon").alias("glon"), F.first("glat").alias("glat")), "overlay-aims")
    quick = _rounds(overlay, begun, goals, aims, ["pair_id", "arrived", "cell"], None)
    bound = materialize(quick.filter("arrived").groupBy("pair_id").agg(F.min("g").alias("bound")), "overlay-bound")
    known = _rounds(overlay, begun, goals, aims, ["pair_id", "arrived", "state"], bound)
    best = materialize(known.filter("arrived").groupBy("pair_id").agg(F.min(F.struct("g", "parent", "last")).alias("m")).select("pair_id", "m.*"), "overlay-best")
    legs = _legs(known.filter("not arrived"), best)
    inside = _inside(overlay, legs)
    origin = legs.filter("first").select("pair_id", F.col("from_state").alias("start")).distinct()
    whole = inside.groupBy("pair_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", "states"))), lambda x: x["states"])).alias("after"))
    return best.join(origin, "pair_id").join(whole, "pair_id").select("pair_id", F.col("g").alias("cost"), "start", "last", "after")


def _rounds(overlay: Overlay, begun: DataFrame, goals: DataFrame, aims: DataFrame, keys: list[str], bound: DataFrame | None) -> DataFrame:
    """pair_id, arrived, state, cell, g, parent, last: the least cost of what was reached by ``keys``.

    ``parent`` is the state by which the cell before was entered, null at the start, and
    ``last`` the state by which that cell was left, or of an arrival the state at the goal.
    """
    rest = [c for c in ("g", "fresh", "state", "cell", "parent", "last") if c not in keys]
    none = F.lit(None).cast("bigint")
    least = lambda rows: rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("m")).select(*keys, "m.*")
    # of equal costs what is known comes first (its fresh is 0)
    known = materialize(least(begun.select("pair_id", F.lit(False).alias("arrived"), "state", "cell", "g", none.alias("parent"), none.alias("last"), F.lit(1).alias("fresh"))), "overlay-known")
    ends = goals.select("pair_id", "cell", "state", "out_cost")
    while True:
        met = known.filter("arrived").groupBy("pair_id").agg(F.min("g").alias("met"))
        front = known.filter("fresh = 1 and not arrived").select("pair_id", "cell", "state", "g").join(met, "pair_id", "left").join(aims, "pair_id")
        front = (front.join(bound, "pair_id", "left") if bound is not None else front.withColumn("bound", F.lit(None).cast("double"))).withColumn("bound", F.least("met", F.col("bound") * (1 + 1e-12)))
        live = materialize(front.filter("bound is null or g <= bound").drop("met"), "overlay-front")
        if live.isEmpty():
            break
        lots = live.groupBy("cell").agg(F.ceil(F.approx_count_distinct("pair_id") / LOT).alias("lots"))
        lot = F.pmod(F.xxhash64("pair_id"), F.col("lots")).alias("lot")
        seeds = live.join(lots, "cell").select("pair_id", "cell", lot, "state", "g", "glon", "glat", "bound", F.lit(False).alias("goal"))
        here = ends.join(live.select("pair_id", "cell").distinct(), ["pair_id", "cell"]).join(lots, "cell")
        aim = here.select("pair_id", "cell", lot, "state", F.col("out_cost").alias("g"), *[F.lit(None).cast("double").alias(c) for c in ("glon", "glat", "bound")], F.lit(True).alias("goal"))
        cells = overlay.cells.join(lots, "cell").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1))).drop("lots").withColumnsRenamed({"cell": "cell2", "lot": "lot2"})
        moved = seeds.unionByName(aim).groupBy("cell", "lot").cogroup(cells.groupBy("cell2", "lot2")).applyInArrow(_cross, _STEP)
        new = known.withColumn("fresh", F.lit(0)).unionByName(moved.withColumn("fresh", F.lit(1)))
        after = materialize(least(new), "overlay-known")
        discard(known, live)
        known = after
    discard(live)
    return known


def _legs(known: DataFrame, best: DataFrame) -> DataFrame:
    """The legs of the best paths, each inside one cell: pair_id, n (in order), cell, from_state, to_state, after, first.

    A leg goes from a state to another of its cell (to_state) and on to the next cell's state
    (``after``; none on the last leg). The states of a path are marked from its end by pointers
    that double; the cost so far puts them in order.
    """
    mine = known.join(best.select("pair_id"), "pair_id", "left_semi").select("pair_id", "state", "cell", "g", "parent", "last")
    up = materialize(mine.select("pair_id", "state", F.col("parent").alias("up")).filter("up is not null"), "overlay-up")
    marked = materialize(best.select("pair_id", F.col("parent").alias("state")), "overlay-marked")
    while not up.isEmpty():
        more = materialize(marked.unionByName(marked.join(up, ["pair_id", "state"]).select("pair_id", F.col("up").alias("state"))).distinct(), "overlay-marked")
        far = materialize(up.join(up.select("pair_id", F.col("state").alias("up"), F.col("up").alias("up2")), ["pair_id", "up"]).select("pair_id", "state", F.col("up2").alias("up")), "overlay-up")
        discard(marked, up)
        marked, up = more, far
    on = materialize(mine.join(marked, ["pair_id", "state"]), "overlay-on")
    ends = on.filter("parent is not null").select("pair_id", F.col("parent").alias("state"), F.col("last").alias("to_state"), F.col("state").alias("after"))
    ends = ends.unionByName(best.select("pair_id", F.col("parent").alias("state"), F.col("last").alias("to_state"), F.lit(None).cast("bigint").alias("after")))
    legs = on.join(ends, ["pair_id", "state"]).select("pair_id", F.col("g").alias("n"), "cell", F.col("state").alias("from_state"), "to_state", "after", F.col("parent").isNull().alias("first"))
    out = materialize(legs, "overlay-legs")
    discard(marked, up, on)
    return out


def _inside(overlay: Overlay, legs: DataFrame) -> DataFrame:
    """pair_id, n and states: the edges of each leg after its first, with the one that follows it."""
    lots = legs.groupBy("cell").agg(F.ceil(F.count("*") / LOT).alias("lots"))
    dealt = legs.join(lots, "cell").select("pair_id", "n", "cell", F.pmod(F.xxhash64("from_state"), F.col("lots")).alias("lot"), "from_state", "to_state", "after")
    cells = overlay.cells.join(lots, "cell").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1))).drop("lots").withColumnsRenamed({"cell": "cell2", "lot": "lot2"})
    return dealt.groupBy("cell", "lot").cogroup(cells.groupBy("cell2", "lot2")).applyInArrow(_walk, "pair_id bigint, n double, states array<bigint>")


def _pack(table: pa.Table) -> pa.Table:
    """One cell's row: states and arcs by index, and the costs from every entry to every way out."""
    kind = np.array(table["kind"].to_pylist())
    col = {c: table[c].to_numpy() for c in ("u", "v", "other", "x", "y", "z")}
    of = lambda name, c: col[c][kind == name]
    order = np.argsort(of("state", "u"))
    row = {"cell": table["cell"][0].as_py(), "states": of("state", "u")[order], "lon": of("state", "x")[order], "lat": of("state", "y")[order], "feet": of("state", "z")[order], "geom": of("state", "v")[order], "split": of("state", "other")[order] > 0}
    at = lambda x: np.searchsorted(row["states"], x)
    by = np.lexsort((of("inner", "u"), of("inner", "v")))
    row |= {"a": at(of("inner", "u")[by]), "b": at(of("inner", "v")[by]), "c": of("inner", "x")[by]}
    rim = np.argsort(of("entry", "v"))
    row |= {"entries": at(of("entry", "v")[rim]), "entry_depth": of("entry", "x")[rim].astype(int), "out_depth": of("out", "y").astype(int), "outs": at(of("out", "u")), "out_cost": of("out", "x"), "out_state": of("out", "v"), "out_cell": of("out", "other")}
    row["ways"] = np.ascontiguousarray(Cell(row).out_of(row["entries"])).tobytes()
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.split(" ") for f in _PACKED.split(", ")]
    return pa.table({n: pa.array([row[n].tolist() if isinstance(row[n], np.ndarray) else row[n]], kinds[k]) for n, k in fields})


def _cross(rows: pa.Table, packed: pa.Table) -> pa.Table:
    """A round in one cell: from the states given to the next cells' states, and to the goals inside."""
    cell, is_goal = unpacked(packed), rows["goal"].to_numpy()
    ways = np.frombuffer(packed["ways"][0].as_py()).reshape(len(cell.entries), len(cell.outs))
    entry = np.full(len(cell.states), -1)
    entry[cell.entries] = np.arange(len(cell.entries))
    col = lambda name, want: rows[name].to_numpy()[is_goal == want]
    pairs, row = np.unique(col("pair_id", False), return_inverse=True)
    at, g = cell.index(col("state", False)), col("g", False)
    bound, glon, glat = (col(c, False) for c in ("bound", "glon", "glat"))
    goal_pair, goal_at, goal_cost = col("pair_id", True), cell.index(col("state", True)), col("g", True)
    names = ("pair_id", "arrived", "state", "cell", "g", "parent", "last")
    out: dict[str, list] = {n: [] for n in names}

    def emit(pair: int, arrived: bool, states, cells, costs, parents, lasts, ok) -> None:
        for n, c in zip(names, (pair, arrived, states, cells, costs, parents, lasts), strict=True):
            out[n].append(np.broadcast_to(c, np.shape(costs))[ok])

    by_pair = np.argsort(row, kind="stable")
    for p, mine in enumerate(np.split(by_pair, np.searchsorted(row[by_pair], np.arange(1, len(pairs))))):
        if not len(mine):
            continue
        starts, limit = at[mine], np.inf if np.isnan(bound[mine[0]]) else bound[mine[0]]
        wanted = np.flatnonzero(goal_pair == pairs[p])
        if len(wanted):
            total = g[mine][:, None] + np.stack([cell.to(int(e))[starts] for e in goal_at[wanted]], 1) + goal_cost[wanted]
            best = total.argmin(0)
            cost = total[best, np.arange(len(wanted))]
            ends = cell.states[goal_at[wanted]]
            emit(pairs[p], True, ends, -1, cost, cell.states[starts[best]], ends, np.isfinite(cost))
        if len(cell.outs):
            through = ways[entry[starts]] if (entry[starts] >= 0).all() else cell.out_of(starts)
            left = g[mine][:, None] + through
            best = left.argmin(0)
            left = left[best, np.arange(len(cell.outs))]
            ok = np.isfinite(left) & (left + _crow(cell.lon[cell.outs], cell.lat[cell.outs], glon[mine[0]], glat[mine[0]]) <= limit)
            emit(pairs[p], False, cell.out_state, cell.out_cell, left + cell.out_cost, cell.states[starts[best]], cell.states[cell.outs], ok)
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    return pa.table({n: pa.array(np.concatenate(out[n]) if out[n] else [], k) for n, k in zip(names, kinds, strict=True)})


def _crow(lon: np.ndarray, lat: np.ndarray, glon: float, glat: float) -> np.ndarray:
    """Feet as the crow flies, a little less for rounding."""
    a, b = np.radians(lat), np.radians(glat)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(glon - lon) / 2) ** 2
    return 2 * geo.EARTH_FT * np.arcsin(np.sqrt(h)) * (1 - 1e-9)


def _walk(legs: pa.Table, packed: pa.Table) -> pa.Table:
    """The states of each leg."""
    cell, known = unpacked(packed), {}
    states = []
    for a, b, after in zip(*(legs[c].to_pylist() for c in ("from_state", "to_state", "after")), strict=True):
        if (a, b) not in known:
            known[a, b] = cell.path(int(cell.index(a)), int(cell.index(b)))
        states.append(known[a, b] + ([] if after is None else [after]))
    return pa.table({"pair_id": legs["pair_id"], "n": legs["n"], "states": pa.array(states, pa.list_(pa.int64()))})
