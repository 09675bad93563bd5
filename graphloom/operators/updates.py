"""Update joins, graph differences, groups and collapsing by cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.aggregates import both_ends
from graphloom.plans.graph import Graph, primary_type
from graphloom.plans.session import released, stored


def update_join(target: DataFrame, rows: DataFrame, key: str, *, order: str | None = None) -> DataFrame:
    """``target`` with the columns of ``rows`` merged in by id; keys match as text.

    Of rows with one key the last by ``order`` wins, without it the greatest; a null keeps the old value.
    """
    props = [c for c in rows.columns if c not in (key, order)]
    r = rows.withColumn("id", F.col(key).cast("string"))
    last = F.max_by(F.struct(*props), F.col(order)) if order else F.max(F.struct(*props))
    merged = target.join(r.groupBy("id").agg(last.alias("__new")), "id", "left")
    for p in props:
        new = F.col(f"__new.{p}")
        merged = merged.withColumn(p, F.coalesce(new, F.col(p)) if p in target.columns else new)
    return merged.drop("__new")


def remove_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Without the nodes of an id set and without their edges."""
    gone = ids.select("id").distinct()
    edges = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges.select(graph.edges.columns))


def diff(before: DataFrame, after: DataFrame, props: list[str], key: str = "id") -> DataFrame:
    """(id, status, changed): added, removed or changed rows with the properties that differ; repeated keys count once."""
    b, a = (d.groupBy(key).agg(F.max(F.struct(*props)).alias(n)) for d, n in ((before, "b"), (after, "a")))
    j = b.join(a, key, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"b.{p}").eqNullSafe(F.col(f"a.{p}")), F.lit(p)) for p in props)))
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(changed) > 0, "changed")
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    return j.select(key, status.alias("status"), F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed")).filter("status is not null")


def change_ratio(changes: DataFrame, current: int) -> str:
    """none, incremental (under 40 % added or removed) or full."""
    n = changes.filter(F.col("status").isin("added", "removed")).count()
    return "none" if n == 0 else "incremental" if n / max(current, 1) < 0.4 else "full"


def regroup_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with each collapsed member's end moved to its group; edges inside a group are dropped.

    A node belongs to its first group (least ``group``).
    """
    m = membership.groupBy("id").agg(F.min("group").alias("group"))
    out = edges.join(m.select(F.col("id").alias("src"), F.col("group").alias("__s")), "src", "left").join(m.select(F.col("id").alias("dst"), F.col("group").alias("__d")), "dst", "left")
    out = out.withColumns({"src": F.coalesce("__s", "src"), "dst": F.coalesce("__d", "dst")}).drop("__s", "__d")
    return out.filter("src != dst").select(edges.columns)


def collapse(graph: Graph, cluster: Column, *, ceiling: int = 200) -> Graph:
    """Supernodes (cluster, members, main type) and weighted directed links between them.

    The largest ``ceiling`` - 1 clusters stay, all others are pooled in ``other``.
    """
    named = graph.nodes.select("id", primary_type().alias("type"), F.coalesce(cluster.cast("string"), F.lit("unclustered")).alias("c"))
    sizes = named.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    # at most one more than the ceiling
    top = [r["c"] for r in sizes.orderBy(F.desc("size"), "c").limit(ceiling + 1).collect()]
    kept = top if len(top) <= ceiling else top[: ceiling - 1]
    member = named.withColumn("cluster", F.when(F.col("c").isin(kept), F.col("c")).otherwise("other"))
    per_type = member.groupBy("cluster", "type").agg(F.count(F.lit(1)).alias("k"))
    nodes = per_type.groupBy("cluster").agg(F.sum("k").alias("members"), F.max_by("type", F.struct("k", "type")).alias("main_type"))
    ends = member.select("id", "cluster")
    links = graph.edges.join(ends.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").join(ends.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst")
    return Graph(nodes, links.filter("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")))


def propagate_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label) after ``rounds`` rounds of synchronous label propagation (the feature's own limit); the commonest label around wins, then the least."""
    links = stored(both_ends(edges).groupBy("id", "other").agg(F.count(F.lit(1)).alias("w")))
    labels = stored(nodes.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = links.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("best"))
        labels, old = stored(labels.join(best, "id", "left").select("id", F.coalesce("best", "label").alias("label"))), labels
        released(old)
    released(links)
    return labels


def tags_added(nodes: DataFrame, tagged: DataFrame) -> DataFrame:
    """``nodes`` with a tags array that has the tags of ``tagged(id, tag)`` added, as a set."""
    t = tagged.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("__t"))
    old = F.col("tags") if "tags" in nodes.columns else F.array().cast("array<string>")
    return nodes.join(t, "id", "left").withColumn("tags", F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce("__t", F.array().cast("array<string>")))).drop("__t")


def working_set(rows: DataFrame, limit: int) -> tuple[bool, int]:
    """(allowed, rows counted up to one more than the limit)."""
    n = rows.limit(limit + 1).count()
    return n <= limit, n
