"""Two streams joined on a key and a time interval, with what is too late dropped on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges_with_nodes(edges: DataFrame, nodes: DataFrame, *, within: str, late: str, end: str = "src", watermark: bool = True) -> DataFrame:
    """Edges (id, src, dst, type, at) with the properties of a node (id, at, ...) that arrives at most ``within`` before or after them.

    Each side waits for the other in state only until its watermark, ``late`` behind the newest
    row of its own, has passed the interval. The batch twin has no watermarks.
    """
    own = [c for c in nodes.columns if c not in ("id", "at")]
    e = edges.withColumnRenamed("at", "edge_at")
    n = nodes.select(F.col("id").alias("node"), F.col("at").alias("node_at"), *own)
    if watermark:
        e, n = e.withWatermark("edge_at", late), n.withWatermark("node_at", late)
    near = F.expr(f"node_at between edge_at - interval {within} and edge_at + interval {within}")
    return e.join(n, (F.col(end) == F.col("node")) & near).select("id", "src", "dst", "type", F.col("edge_at").alias("at"), *own)
