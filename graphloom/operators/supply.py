"""Supply networks: tiers of nodes with their links, certificates held along them, and gaps in sourcing and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.aggregates import sole_sources
from graphloom.operators.filters import induced
from graphloom.plans.graph import Graph


def network(tiers: dict[str, DataFrame], links: DataFrame) -> Graph:
    """The graph of tables (id, name, ...), one a tier, and links (src, dst, type); the tier is type and property, links to nothing are dropped."""
    parts = [df.withColumns({"types": F.array(F.lit(tier)), "tier": F.lit(tier)}) for tier, df in tiers.items()]
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    edges = links.select(F.concat_ws("/", "type", "src", "dst").alias("id"), "src", "dst", "type").distinct()
    return induced(Graph(nodes, edges), nodes)


def thread(items: DataFrame, supplies: DataFrame, held: DataFrame, wanted: str) -> DataFrame:
    """(id, supplier_count, held, status) of items(id): suppliers (edges into them), the sorted certificates (id, certificate) they hold, and whether ``wanted`` is one.

    Without any certificate the status is ``n/a``. Certificates are a short list of kinds.
    """
    n = supplies.select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("supplier_count"))
    kinds = held.groupBy("id").agg(F.sort_array(F.collect_set("certificate")).alias("held"))
    status = F.when(F.col("held").isNull(), "n/a").when(F.array_contains("held", wanted), "covered").otherwise("missing")
    rows = items.select("id").join(n, "id", "left").join(kinds, "id", "left")
    return rows.select("id", F.coalesce("supplier_count", F.lit(0)).alias("supplier_count"), "held", status.alias("status"))


def gaps(supplies: DataFrame, critical: Column, findings: DataFrame | None = None) -> DataFrame:
    """(id, gap, severity): items with a single source (``critical``, over the column id, makes it a violation), their suppliers, and findings of shapes (id, path, severity)."""
    sole = sole_sources(supplies)
    items = sole.select(F.col("part").alias("id"), F.lit("sole-source").alias("gap"))
    items = items.withColumn("severity", F.when(critical, "violation").otherwise("warning"))
    points = sole.select(F.col("supplier").alias("id"), F.lit("single-point").alias("gap"), F.lit("warning").alias("severity")).distinct()
    out = items.unionByName(points)
    if findings is None:
        return out
    return out.unionByName(findings.select("id", F.concat(F.lit("shape:"), "path").alias("gap"), "severity").distinct())
