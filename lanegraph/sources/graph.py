"""The routing graph as tables: nodes, edges and their lines, in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.operators.ordered import dense_ids


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that edges use, numbered from 0 in the order of their ids, and the edges between the numbers."""
    used = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    ids = dense_ids(used.join(nodes.select("node_id"), "node_id", "left_semi"), "node_id", "node")
    a, b = ids.select(F.col("node_id").alias("src"), F.col("node").alias("from")), ids.select(F.col("node_id").alias("dst"), F.col("node").alias("to"))
    return nodes.join(ids, "node_id").drop("node_id"), edges.join(a, "src").join(b, "dst").drop("src", "dst")


def write_graph(nodes: DataFrame, edges: DataFrame, lines: DataFrame, path: str) -> None:
    """Write nodes (node, ...), edges (edge_id, from, to, geom, ...) and lines (geom, points) below ``path``.

    Edges are laid out by the node they leave, so a reader of one place reads few files' ranges.
    """
    nodes.repartitionByRange("node").sortWithinPartitions("node").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/nodes")
    edges.repartitionByRange("from").sortWithinPartitions("from", "edge_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/edges")
    lines.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/lines")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What write_graph() wrote: nodes, edges, lines."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "lines"))
