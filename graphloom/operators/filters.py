"""Filters: condition trees over property columns, view filters, facets and time windows."""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.graph import Graph

#: So many ids may be sent to every executor.
_FEW = 200_000
_COMPARE = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def condition(prop: str, op: str, value: Any = None) -> Column:
    """One condition; a missing property differs from every value, an unknown operator is an error."""
    c = F.col(prop)
    if op == "eq":
        return c.eqNullSafe(F.lit(value))
    if op == "neq":
        return ~c.eqNullSafe(F.lit(value))
    if op in _COMPARE:
        return F.coalesce(_COMPARE[op](c, F.lit(value)), F.lit(False))
    if op == "contains":
        return F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(str(value).lower())), F.lit(False))
    if op == "exists":
        return c.isNotNull()
    raise ValueError(f"unknown operator {op!r}")


def tree(spec: dict[str, Any]) -> Column:
    """A nested {"and": [...]} / {"or": [...]} / {"prop", "op", "value"} tree as one column."""
    for key, empty, join in (("and", True, operator.and_), ("or", False, operator.or_)):
        if key in spec:
            return reduce(join, map(tree, spec[key]), F.lit(empty))
    return condition(spec["prop"], spec["op"], spec.get("value"))


def view_nodes(nodes: DataFrame, visible: DataFrame | None = None, hidden: DataFrame | None = None, pinned: DataFrame | None = None) -> DataFrame:
    """Nodes that a view shows: pinned before hidden before the visible set (none means all)."""
    out = nodes.withColumns({"__in": F.lit(visible is None), "__out": F.lit(False), "__pin": F.lit(False)})
    for ids, flag in ((visible, "__in"), (hidden, "__out"), (pinned, "__pin")):
        if ids is not None:
            marks = ids.select("id").distinct().withColumn("__m", F.lit(True))
            out = out.join(marks, "id", "left").withColumn(flag, F.coalesce("__m", F.lit(False))).drop("__m")
    return out.filter(F.col("__pin") | (~F.col("__out") & F.col("__in"))).drop("__in", "__out", "__pin")


def locked(nodes: DataFrame, pinned: DataFrame, all_pinned: bool = False) -> DataFrame:
    """(id): the nodes that stay where they are, all or those of the pinned ids that exist."""
    ids = nodes.select("id").distinct()
    return ids if all_pinned else ids.join(pinned.select("id"), "id", "left_semi")


def induced(graph: Graph, ids: DataFrame) -> Graph:
    """The nodes of an id set and the edges with both ends in it.

    The ids are hashed, by every executor if they are few and else by partition, so the edges are never sorted.
    """
    keep = ids.select("id").distinct()
    way = "broadcast" if keep.limit(_FEW + 1).count() <= _FEW else "shuffle_hash"
    src, dst = (keep.select(F.col("id").alias(end)).hint(way) for end in ("src", "dst"))
    edges = graph.edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi")
    return Graph(graph.nodes.join(keep.hint(way), "id", "left_semi"), edges.select(graph.edges.columns))


def facet_counts(nodes: DataFrame) -> DataFrame:
    """(type, n) over all types of every node."""
    return nodes.select(F.explode("types").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def without_types(nodes: DataFrame, hidden: list[str]) -> DataFrame:
    """Nodes with none of the hidden types."""
    return nodes.filter(~F.arrays_overlap("types", F.array(*map(F.lit, hidden)).cast("array<string>")))


def in_window(nodes: DataFrame, time: str, position: float, days: float) -> DataFrame:
    """Nodes inside the window of ``days`` whose start lies at ``position`` (0..1) of the free range."""
    t = F.col(time).cast("timestamp").cast("double")
    span = nodes.agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    start = F.col("lo") + position * F.greatest(F.lit(0.0), F.col("hi") - F.col("lo") - days * 86400)
    return nodes.join(F.broadcast(span)).filter(t.between(start, start + days * 86400)).drop("lo", "hi")


def hidden_by_range(items: DataFrame, start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    """Items whose interval (or instant, where the end is null) misses [lo, hi]; untimed ones are never hidden."""
    s = F.col(start)
    return items.filter(s.isNotNull() & ((F.coalesce(F.col(end), s) < lo) | (s > hi)))


def search(nodes: DataFrame, text: str, props: list[str], limit: int = 20) -> DataFrame:
    """Top nodes by fuzzy match: exact before prefix before substring before edit distance up to 2."""
    q = text.lower()
    best = F.lit(None).cast("int")
    for p in props:
        c = F.lower(F.col(p).cast("string"))
        s = F.when(c == q, 0).when(c.startswith(q), 1).when(F.contains(c, F.lit(q)), 2).when(F.levenshtein(c, F.lit(q), 2) >= 0, 3)
        best = F.least(best, s)
    return nodes.withColumn("rank", best).filter("rank is not null").orderBy("rank", "id").limit(limit)
