"""Breadth-first operators: frontier joins whose steps are stored, so a loop's plan stays short."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.aggregates import both_ends
from graphloom.plans.session import joined, number_rows, released, stored


def _steps(edges: DataFrame, directed: bool, types: list[str] | None) -> DataFrame:
    if types is not None:
        edges = edges.filter(F.col("type").isin(types))
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")) if directed else both_ends(edges)


#: A frontier of at most so many ids is sent to every executor; a larger one is joined by a shuffle.
_FEW = 200_000
#: Steps of a loop that are read side by side before they are written as one.
_PARTS = 8


def _onto(steps: DataFrame, frontier: DataFrame, on: str = "id") -> DataFrame:
    """``steps`` from a stored frontier, whose files tell its size."""
    return steps.join(F.broadcast(frontier) if frontier.count() <= _FEW else frontier, on)


def _levels(start: DataFrame, grow: Callable[[DataFrame, DataFrame, int], DataFrame], depth: int | None, end: Callable[[DataFrame], bool] = lambda _: False) -> DataFrame:
    """Rows found level by level (``depth`` names the level): ``grow`` makes the next ones from the last ones and all before, until there are none."""
    parts, level = [stored(start)], 0
    while (depth is None or level < depth) and not end(parts[-1]):
        if len(parts) > _PARTS:
            parts = [joined(parts)]
        last, level = parts[-1].filter(F.col("depth") == level), level + 1
        new = stored(grow(last, reduce(DataFrame.unionByName, parts), level))
        if new.isEmpty():
            released(new)
            break
        parts.append(new)
    return joined(parts)


def hops(edges: DataFrame, start: DataFrame, depth: int | None = None, *, directed: bool = False, types: list[str] | None = None) -> DataFrame:
    """(id, depth) of all nodes within ``depth`` steps of the start ids, these at depth 0."""
    steps = _steps(edges, directed, types)

    def grow(last: DataFrame, seen: DataFrame, level: int) -> DataFrame:
        new = _onto(steps, last.select("id")).select(F.col("other").alias("id")).distinct()
        return new.join(seen, "id", "left_anti").withColumn("depth", F.lit(level))

    return _levels(start.select("id").distinct().withColumn("depth", F.lit(0)), grow, depth)


def neighbors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, neighbor): different adjacent nodes in either direction."""
    return both_ends(edges).join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("other").alias("neighbor")).distinct()


def shortest_path(edges: DataFrame, source: str, target: str, *, max_hops: int | None = None, directed: bool = False, types: list[str] | None = None) -> DataFrame:
    """(step, id) of one shortest path, empty if there is none (within ``max_hops``, if given); ties go to the least previous id.

    A node's path to itself is the node alone, whether or not it has edges.
    """
    spark = edges.sparkSession
    steps = _steps(edges, directed, types)

    def grow(last: DataFrame, seen: DataFrame, level: int) -> DataFrame:
        new = _onto(steps, last.select("id")).groupBy("other").agg(F.min("id").alias("parent"))
        return new.select(F.col("other").alias("id"), "parent", F.lit(level).alias("depth")).join(seen, "id", "left_anti")

    start = spark.createDataFrame([(source, None, 0)], "id string, parent string, depth int")
    seen = _levels(start, grow, max_hops, lambda level: not level.filter(F.col("id") == target).isEmpty())
    path, at = [], target
    while at is not None and (row := seen.filter(F.col("id") == at).first()):
        path.append((row["depth"], at))
        at = row["parent"]
    released(seen)
    return spark.createDataFrame(path[::-1], "step int, id string")


def simple_paths(edges: DataFrame, start: DataFrame, max_depth: int, *, ends: DataFrame | None = None) -> DataFrame:
    """(path, hops): all directed simple paths from the start ids, up to ``max_depth`` steps.

    With ``ends`` a path stops at the first node of that set and only such paths are returned.
    """
    out = edges.select(F.col("src").alias("at"), "dst").distinct()
    stop = ends.select(F.col("id").alias("at"), F.lit(True).alias("end")).distinct() if ends is not None else None
    frontier = start.select(F.array("id").alias("path"))
    found = []
    for level in range(1, max_depth + 1):
        grown = frontier.withColumn("at", F.element_at("path", -1)).join(out, "at").filter(~F.array_contains("path", F.col("dst")))
        frontier = grown.select(F.concat("path", F.array("dst")).alias("path"))
        if stop is not None:
            marked = frontier.withColumn("at", F.element_at("path", -1)).join(stop, "at", "left")
            found.append(marked.filter("end").select("path", F.lit(level).alias("hops")))
            frontier = marked.filter("end is null").select("path")
        else:
            found.append(frontier.select("path", F.lit(level).alias("hops")))
    result = found[0]
    for f in found[1:]:
        result = result.unionAll(f)
    return result


def paths_of_length(edges: DataFrame, sources: DataFrame, targets: DataFrame, steps: int) -> DataFrame:
    """(path): undirected paths of exactly ``steps`` steps from a source to a target, no node twice; parallel edges count once.

    Half paths grow from both ends and meet in the middle, so none is longer than half the way.
    """
    links = both_ends(edges).filter("id != other").distinct()

    def grown(ends: DataFrame, far: int) -> DataFrame:
        out = ends.select("id").distinct().select(F.col("id").alias("at"), F.array("id").alias("path"))
        for _ in range(far):
            step = out.join(links, out["at"] == links["id"]).filter(~F.array_contains("path", F.col("other")))
            out = step.select(F.col("other").alias("at"), F.concat("path", F.array("other")).alias("path"))
        return out

    there, back = grown(sources, (steps + 1) // 2), grown(targets, steps // 2)
    back = back.select("at", F.slice(F.reverse("path"), F.lit(2), F.lit(max(steps, 1))).alias("rest"))
    met = there.join(back, "at").filter(~F.arrays_overlap("path", "rest"))
    return met.select(F.concat("path", "rest").alias("path"))


#: Links that are contracted together in a task.
_CONTRACTED = 1_000_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) with v < u, a bounded number at a time, as links of each node to the least one they connect it with."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("u", "v"))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            # a node's root takes the least root around it, then all nodes go to their root's root
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(root != np.arange(len(ids)))
        held.clear()
        return pa.RecordBatch.from_pydict({"u": ids[some], "v": ids[root[some]]})

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= _CONTRACTED:
            yield stars()
    if held:
        yield stars()


#: A key that so many rows share is sent to them instead of their being gathered at it.
_HUB = 10_000


def _spread(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Stored ``rows`` joined with ``table``, whose keys are unique, without gathering the rows of a frequent key."""
    hubs = rows.groupBy(on).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= _HUB).select(on)
    far = F.broadcast(table.join(F.broadcast(hubs), on, "left_semi"))
    rest = rows.join(F.broadcast(hubs), on, "left_anti").join(table, on)
    return rows.join(far, on).unionByName(rest)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, by large-star and small-star rounds over numbered ids.

    Each task first contracts its own links, a bounded number at a time. A round is then a grouped
    minimum, combined before its shuffle, and an equi-join; links come to hang on the least id,
    and no component or hub is gathered in one place.
    """
    # parallel links go in the contraction
    links = edges.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).filter("low != high")
    ends = links.select(F.explode(F.array("low", "high")).alias("id")).distinct()
    # numbers are in order of the ids, so the least number is that of the least id
    named = stored(number_rows(ends, "id"))
    low, high = (named.select(F.col("id").alias(c), F.col("n").alias(v)) for c, v in (("low", "v"), ("high", "u")))
    e = stored(links.join(low, "low").join(high, "high").select("u", "v").mapInArrow(_contracted, "u long, v long").distinct())
    before = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e, old = stored(small.filter("u != v").distinct()), e
        released(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now[0] == now[2] and now == before:
            break
        before = now
    least = named.select(F.col("n").alias("v"), F.col("id").alias("component"))
    of = stored(_spread(e, least, "v").join(named.select("id", F.col("n").alias("u")), "u").select("id", "component"))
    released(e, named)
    return nodes.select("id").join(of, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def numbered_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with components numbered from 0, the largest first, then by least id."""
    of = stored(components(nodes, edges))
    sizes = number_rows(of.groupBy(F.col("component").alias("least")).agg(F.count(F.lit(1)).alias("size")), F.desc("size"), "least")
    numbers = sizes.select(F.col("least").alias("component"), (F.col("n") - 1).alias("number"))
    return _spread(of, numbers, "component").select("id", F.col("number").alias("component"))


def tree_depths(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth, parent) of a spanning tree: each node hangs on its least parent at the first depth reached."""
    # parallel edges need not be made one first: the least parent is the same
    out = edges.select(F.col("src").alias("parent"), F.col("dst").alias("id"))

    def grow(last: DataFrame, seen: DataFrame, level: int) -> DataFrame:
        new = _onto(out, last.select(F.col("id").alias("parent")), "parent").groupBy("id").agg(F.min("parent").alias("parent"))
        return new.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("depth"), "parent")

    return _levels(roots.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")), grow, max_depth)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def breadcrumbs(edges: DataFrame, ids: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth, ancestor): up the first incoming edge of each node, with a guard against cycles."""
    # one row a node that every level reads
    up = stored(edges.groupBy(F.col("dst").alias("at")).agg(F.min_by("src", "id").alias("up")))

    def grow(last: DataFrame, _: DataFrame, level: int) -> DataFrame:
        above = last.withColumnRenamed("ancestor", "at").join(up, "at").filter(~F.array_contains("seen", F.col("up")))
        return above.select("id", F.lit(level).alias("depth"), F.col("up").alias("ancestor"), F.concat("seen", F.array("up")).alias("seen"))

    start = ids.select("id", F.lit(0).alias("depth"), F.col("id").alias("ancestor"), F.array("id").alias("seen"))
    out = _levels(start, grow, max_depth)
    released(up)
    return out.drop("seen")


def parallel_edges(edges: DataFrame) -> DataFrame:
    """Edges with same_way (parallel in this direction), either_way and self_loop."""
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.withColumns({
        "same_way": F.count(F.lit(1)).over(Window.partitionBy("src", "dst")),
        "either_way": F.count(F.lit(1)).over(Window.partitionBy(lo, hi)),
        "self_loop": F.col("src") == F.col("dst"),
    })
