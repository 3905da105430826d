"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.stage import discard, materialize

#: Contracted edges up to this many are finished in one task, as arrays of 16 bytes an edge.
LAST_EDGES = 500_000
#: Times the hooks of a round are doubled.
JUMPS = 3


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", last_edges: int = LAST_EDGES) -> DataFrame:
    """Rows (node, component) for every end of an edge; nodes are whole numbers, component is its smallest node.

    Each round every node hooks to its first neighbour in a random order (a hash) if that
    comes before it, the hooks are followed JUMPS doublings far, and the edges are rewritten
    between the nodes reached, which keeps what is connected connected. Hooks are short in a
    random order, so the nodes shrink by a factor and there are O(log n) rounds of a few stage
    tables each. Once few edges are left (they are counted) one task finishes them. Minima are
    pre-aggregated and joins are between stage tables, so one component or node may hold any
    share of the edges; nothing is collected. Joins are shuffled: ids pack so well that by the
    stage tables' sizes they would be broadcast, in every round again.
    """
    both = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).filter("u is not null and v is not null")
    live = materialize(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    while live.count() > last_edges:
        ends = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = ends.groupBy("u").agg(F.min(place("v")).alias("v"))
        up = materialize(first.select(F.col("u").alias("node"), F.least(place("u"), "v")["node"].alias("up")), "hooks")
        for _ in range(JUMPS):
            jumped = materialize(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")).hint("merge"), "up").select("node", F.col("top").alias("up")), "hooks")
            discard(up)
            up = jumped
        u, v = (up.select(F.col("node").alias(c), F.col("up").alias(f"{c}2")).hint("merge") for c in ("u", "v"))
        moved = live.join(u, "u").join(v, "v").filter("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
        rest = materialize(moved.distinct(), "edges")
        discard(live)
        live = rest
        rounds.append(up)
    labels = materialize(_finished(live), "labels")
    discard(live)
    for up in reversed(rounds):
        found = materialize(up.join(labels.withColumnRenamed("node", "up").hint("merge"), "up", "left").select("node", F.coalesce("component", "up").alias("component")), "labels")
        discard(labels, up)
        labels = found
    if not rounds:
        return labels
    least = materialize(labels.groupBy("component").agg(F.min("node").alias("least")), "least")
    return labels.join(least.hint("merge"), "component").select("node", F.col("least").alias("component"))


def _finished(edges: DataFrame) -> DataFrame:
    """Components of all edges in one task: roots hook to smaller roots until no edge joins two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
        u, v, top = place[: len(u)], place[len(u) :], np.arange(len(nodes))
        while True:
            a, b = top[u], top[v]
            open_ = a != b
            if not open_.any():
                break
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
            while (top[top] != top).any():
                top = top[top]
        for k in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(nodes[top[k : k + 100_000]])], names=["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node bigint, component bigint")


def main_component(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The nodes (node) of the component with most nodes; of equals, of the lowest id."""
    labels = connected_components(edges, src, dst)
    top = labels.groupBy("component").agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), "component")).alias("t")).select("t.component")
    return labels.join(F.broadcast(top), "component", "left_semi").select("node")
