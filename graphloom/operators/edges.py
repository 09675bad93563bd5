"""Edges as first-class rows: additions, lookups, properties, differences of whole graphs, schema fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.updates import diff
from graphloom.plans.graph import Graph, least_of_each


def add_nodes(graph: Graph, rows: DataFrame) -> Graph:
    """The graph with new nodes; an id that exists already keeps its node, of new rows with one id the least as JSON counts."""
    new = least_of_each(rows, "id").join(graph.nodes.select("id"), "id", "left_anti")
    return Graph(graph.nodes.unionByName(new, allowMissingColumns=True), graph.edges)


def add_edges(graph: Graph, rows: DataFrame) -> Graph:
    """The graph with new edges between existing nodes, parallel ones too; without an id it is a hash of ends, type and number."""
    from pyspark.sql import Window

    known = graph.nodes.select("id").distinct()
    ok = rows.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if "id" not in rows.columns:
        others = [c for c in ok.columns if c not in ("src", "dst", "type")]
        before = graph.edges.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("__n"))
        nth = F.row_number().over(Window.partitionBy("src", "dst", "type").orderBy(*(others or [F.lit(0)])))
        ok = ok.join(before, ["src", "dst", "type"], "left").withColumn("id", F.sha2(F.concat_ws("\u0001", "src", "dst", "type", (nth + F.coalesce("__n", F.lit(0))).cast("string")), 256)).drop("__n")
    return Graph(graph.nodes, graph.edges.unionByName(ok, allowMissingColumns=True))


def between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges from one node to another."""
    return edges.filter((F.col("src") == a) & (F.col("dst") == b))


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, id): the edges that touch each of the given nodes, a self-loop once."""
    ends = edges.select("id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    return ends.join(ids.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", "id")


def graph_diff(before: Graph, after: Graph, node_props: list[str], edge_props: list[str]) -> DataFrame:
    """(kind, id, status, changed) of nodes and edges; a change of type or ends alone isn't reported."""
    n = diff(before.nodes, after.nodes, node_props).select(F.lit("node").alias("kind"), "*")
    return n.unionAll(diff(before.edges, after.edges, edge_props).select(F.lit("edge").alias("kind"), "*"))


def diff_counts(changes: DataFrame) -> DataFrame:
    """(kind, status, n), always six rows."""
    spark = changes.sparkSession
    every = spark.createDataFrame([(k, s) for k in ("node", "edge") for s in ("added", "removed", "changed")], "kind string, status string")
    n = changes.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(every), ["kind", "status"], "right").select("kind", "status", F.coalesce("n", F.lit(0)).alias("n"))


def schema_hash(registry: DataFrame) -> str:
    """A short fingerprint of node types, edge types and node property keys, from ``registry`` (as large as the schema)."""
    names: dict[str, list[str]] = {"nodeType": [], "edgeType": [], "nodeProperty": []}
    for r in registry.filter(F.col("kind").isin(*names)).collect():
        names[r["kind"]].append(r["name"])
    text, h = "|".join(",".join(sorted(v)) for v in names.values()), 0
    units = text.encode("utf-16-le")
    for k in range(0, len(units), 2):
        h = (31 * h + int.from_bytes(units[k : k + 2], "little")) & 0xFFFFFFFF
    h -= (h & 0x80000000) << 1
    digits, n = "", abs(h)
    while n or not digits:
        n, d = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return f"-{digits}" if h < 0 else digits
