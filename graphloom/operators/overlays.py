"""Named id sets over a graph: overlays of gaps, severities and paths, clusters and their members, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.shapes import SEVERITIES, severity_rank


def overlay(ids: DataFrame, name: str | Column, element: str = "node") -> DataFrame:
    """(overlay, element, id): an overlay is rows, so a large one is never one value."""
    return ids.select((F.lit(name) if isinstance(name, str) else name).alias("overlay"), F.lit(element).alias("element"), "id").distinct()


def by_worst(findings: DataFrame, prefix: str = "gap-") -> DataFrame:
    """One overlay a severity, each node in that of its worst finding only."""
    worst = findings.groupBy("id").agg(F.max(severity_rank(F.col("severity"))).cast("int").alias("w"))
    return overlay(worst, F.concat(F.lit(prefix), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("w"))))


def by_severity(findings: DataFrame, prefix: str = "shacl-") -> DataFrame:
    """One overlay a severity, with every node that has a finding of it."""
    return overlay(findings, F.concat(F.lit(prefix), F.col("severity")))


def of_paths(paths: DataFrame, edges: DataFrame, name: str = "path", path: str = "path") -> DataFrame:
    """The nodes on the paths, and the edges between neighbours on them."""
    nodes = overlay(paths.select(F.explode(path).alias("id")), name)
    pairs = paths.select(F.explode(F.arrays_zip(F.slice(path, 1, F.size(path) - 1).alias("src"), F.slice(path, 2, F.size(path)).alias("dst"))).alias("x")).select("x.*").distinct()
    return nodes.unionAll(overlay(edges.join(pairs, ["src", "dst"], "left_semi"), name, "edge"))


def active_members(overlays: DataFrame, active: list[str], element: str = "node") -> DataFrame:
    """(id) of the union of the active overlays."""
    return overlays.filter(F.col("overlay").isin(active) & (F.col("element") == element)).select("id").distinct()


def cluster_labels(nodes: DataFrame, mode: str, *, region: str = "region", tier: str = "tier") -> DataFrame:
    """(id, label) by region (non-empty text) or by tier (a number)."""
    if mode == "region":
        return nodes.filter(F.col(region).isNotNull() & (F.col(region) != "")).select("id", F.col(region).alias("label"))
    if mode == "tier":
        return nodes.filter(F.col(tier).isNotNull()).select("id", F.concat(F.lit("Tier "), F.col(tier).cast("string")).alias("label"))
    raise ValueError(f"unknown mode {mode!r}")


def component_labels(components: DataFrame) -> DataFrame:
    """(id, label) of components numbered from 0."""
    return components.select("id", F.concat(F.lit("Component "), (F.col("component") + 1).cast("string")).alias("label"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(label, members), the largest first, then by label; the ids stay rows of ``labels``."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("members")).orderBy(F.desc("members"), "label")


def source_counts(nodes: DataFrame, source: str = "source") -> DataFrame:
    """(source, n) of the nodes that name one, the most frequent first."""
    return nodes.filter(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


def row_severities(findings: DataFrame) -> DataFrame:
    """(row, severity): the worst severity of each property of each shape, by row id."""
    worst = F.max(severity_rank(F.col("severity"))).cast("int")
    return findings.groupBy("shape", "path").agg(worst.alias("w")).select(row_id(F.col("shape"), F.col("path")).alias("row"), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("w")).alias("severity"))


def row_id(shape: Column, path: Column) -> Column:
    return F.concat_ws("::", shape, F.lit("prop"), path)


def result_targets(findings: DataFrame) -> DataFrame:
    """(id, row, shape, detail) of each finding: what a selection of it leads to."""
    detail = F.concat(F.col("path"), F.lit(": "), F.col("message"), F.lit(" ("), F.col("severity"), F.lit(")"))
    return findings.select("id", row_id(F.col("shape"), F.col("path")).alias("row"), "shape", detail.alias("detail"))


def node_summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, neighbours, breakdown): each node's different neighbours, by type in order of name."""
    from graphloom.operators.aggregates import both_ends

    types = nodes.select(F.col("id").alias("other"), F.coalesce(F.get("types", 0), F.lit("Unknown")).alias("type"))
    # each pair is made distinct once, before it counts from both ends
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src != dst").distinct()
    per = both_ends(pairs).join(types, "other").groupBy("id", "type").agg(F.count(F.lit(1)).alias("k"))
    # one entry a type, so the list is as short as the schema
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "k"))), lambda x: F.concat(x["k"].cast("string"), F.lit(" "), x["type"])), ", ")
    return nodes.select("id").join(per.groupBy("id").agg(F.sum("k").alias("neighbours"), text.alias("breakdown")), "id", "left").select("id", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.coalesce("breakdown", F.lit("")).alias("breakdown"))
