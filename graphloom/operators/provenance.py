"""Provenance graphs: agents, activities and entities, their chains, events and time ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.graph import Graph
from graphloom.plans.session import released, stored, stored_by

#: Edge types a chain follows (fixed values of the vocabulary).
CHAIN = ("wasAttributedTo", "wasGeneratedBy", "wasAssociatedWith", "used", "wasDerivedFrom")

#: Roots in one bucket of rows.
_ROOTS_A_PART = 100_000


def build(agents: DataFrame, activities: DataFrame, entities: DataFrame) -> Graph:
    """The graph of agents(id, name), activities(id, name, agent, started, ended) and entities(id, name, attributed_to, generated_by, generated).

    Entities get ``attributed``, whether anything is recorded about where they come from.
    """
    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("types", F.array(F.lit(name)))

    known = F.col("attributed_to").isNotNull() | F.col("generated_by").isNotNull()
    nodes = [
        kind(agents, "Agent").select("id", "types", "name"), kind(activities, "Activity").select("id", "types", "name", "started", "ended"),
        kind(entities, "Entity").select("id", "types", "name", "generated", known.alias("attributed")),
    ]

    def edges(df: DataFrame, to: str, kind: str) -> DataFrame:
        return df.filter(F.col(to).isNotNull()).select(F.concat_ws("/", F.lit(kind), "id", to).alias("id"), F.col("id").alias("src"), F.col(to).alias("dst"), F.lit(kind).alias("type"))

    links = [edges(activities, "agent", "wasAssociatedWith"), edges(entities, "attributed_to", "wasAttributedTo"), edges(entities, "generated_by", "wasGeneratedBy")]
    return Graph(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), nodes), reduce(DataFrame.unionAll, links))


def chains(graph: Graph, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """(root, id, depth, parent, via, absence, place): what each root comes from, along out-edges of the chain's types, depth first.

    Children go by their edges' ids, and a node counts once for each root, where the walk comes
    to it first; from there alone it goes on, so no way through a later place counts. An entity that is
    a leaf without attribution is followed by a row that marks the gap. ``place`` numbers a
    root's rows in the order of the walk. ``max_depth`` is the feature's own limit.
    """
    parts = max(int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), roots.count() // _ROOTS_A_PART)
    steps = graph.edges.filter(F.col("type").isin(*CHAIN)).select(F.col("src").alias("id"), "dst", F.struct(F.col("id").alias("edge"), "type").alias("e"))
    steps = steps.repartition(parts, "id").groupBy("id", "dst").agg(F.min("e").alias("e"))
    # ways of a root that part do so at one node, so its edges' numbers give the order of their ids
    nth = F.row_number().over(Window.partitionBy("id").orderBy("e.edge", "dst"))
    steps = stored_by(steps.select("id", "dst", F.col("e.type").alias("type"), nth.alias("nth")), "id", parts)
    bare = graph.nodes.filter(F.array_contains("types", "Entity") & ~F.coalesce("attributed", F.lit(True))).select("id").distinct()
    within = stored(bare.join(steps.select(F.col("dst").alias("id")).distinct(), "id", "left_semi"))
    marked = F.lit(True).alias("bare")
    walked = steps.withColumn("bare", F.lit(False))
    if not within.isEmpty():
        walked = steps.join(within.select(F.col("id").alias("dst"), marked), "dst", "left").withColumn("bare", F.coalesce("bare", F.lit(False)))
    none = F.lit(None).cast("string")
    level = roots.select("id").distinct().join(bare.select("id", marked), "id", "left")
    level = level.select(F.col("id").alias("root"), "id", none.alias("parent"), none.alias("via"), F.coalesce("bare", F.lit(False)).alias("bare"), F.array().cast("array<string>").alias("between"), F.array().cast("array<int>").alias("order"))
    found = [level.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        grown = level.select("root", "id", "between", "order").join(walked, "id").filter((F.col("dst") != F.col("root")) & (F.col("dst") != F.col("id")) & ~F.array_contains("between", F.col("dst")))
        # what lies between a root and a node, without both
        between = F.concat("between", F.array("id")) if depth > 1 else F.col("between")
        level = grown.select("root", F.col("dst").alias("id"), F.col("id").alias("parent"), F.col("type").alias("via"), "bare", between.alias("between"), F.concat("order", F.array("nth")).alias("order"))
        found.append(level.withColumn("depth", F.lit(depth)))
    # a root's rows are bounded by the walk's depth and its nodes' out-edges, and from here on lie together
    every = stored_by(reduce(DataFrame.unionByName, found).drop("between").repartition(parts, "root"), "root", parts)
    released(steps, within)
    # only from roots whose ways meet again can a way not count
    met = stored(every.groupBy("root", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root").distinct())
    if met.isEmpty():
        released(met)
        first = every
    else:
        first = every.join(met, "root", "left_anti").unionByName(_first_ways(stored(every.join(met, "root", "left_semi")))).repartition(parts, "root")
    # a leaf is where the walk doesn't go on, for want of edges, depth or nodes not met yet
    row = F.struct("depth", "parent", "via", "bare", "order")
    both = F.array_compact(F.array(F.struct("id", row.alias("row")), F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("id"), F.lit(None).cast(first.select(row).schema[0].dataType).alias("row")))))
    own = first.select("root", F.explode(both).alias("x")).select("root", "x.id", "x.row")
    leaf = F.count_if(F.col("row").isNull()).over(Window.partitionBy("root", "id")) == 0
    own = own.withColumn("leaf", leaf).filter("row is not null").select("root", "id", "row.*", "leaf")
    names = ("id", "depth", "parent", "via", "absence", "order")
    here = F.struct("id", "depth", "parent", "via", F.lit(False).alias("absence"), "order")
    gap = F.struct(*(c.alias(n) for n, c in zip(names, (F.concat("id", F.lit("::absence")), F.col("depth") + 1, F.col("id"), none, F.lit(True), F.concat("order", F.array(F.lit(0)))), strict=True)))
    rows = own.select("root", F.explode(F.array_compact(F.array(here, F.when(F.col("leaf") & F.col("bare"), gap)))).alias("x")).select("root", "x.*")
    place = F.row_number().over(Window.partitionBy("root").orderBy("order", "absence")) - 1
    return rows.select("root", "id", "depth", "parent", "via", "absence", place.alias("place"))


def _first_ways(every: DataFrame) -> DataFrame:
    """(root, id, order, depth, parent, via, bare): the first way to each node, of ways that come to every node between by its own first way."""
    while True:
        first = stored(every.groupBy("root", "id").agg(F.min(F.struct("order", "depth", "parent", "via", "bare")).alias("x")).select("root", "id", "x.*"))
        # a way to a parent that isn't the parent's first one is none
        own = first.select("root", F.col("id").alias("parent"), F.col("order").alias("before"))
        held = every.join(own, ["root", "parent"], "left")
        kept = stored(held.filter(F.col("parent").isNull() | (F.col("before") == F.slice("order", F.lit(1), F.greatest(F.size("order") - 1, F.lit(0))))).select(*every.columns))
        same = kept.count() == every.count()
        released(every)
        if same:
            released(kept)
            return first
        released(first)
        every = kept


def events(nodes: DataFrame) -> DataFrame:
    """(time, kind, id): one row a time that a node carries."""
    stamps = F.array(*(F.struct(F.col(c).alias("time"), F.lit(c).alias("kind")) for c in ("generated", "started", "ended")))
    return nodes.select("id", F.explode(stamps).alias("x")).filter("x.time is not null").select("x.time", "x.kind", "id")


def time_bounds(found: DataFrame) -> DataFrame:
    """(least, most) in milliseconds, both 0 without events."""
    ms = F.unix_millis(F.col("time").cast("timestamp"))
    return found.agg(F.coalesce(F.min(ms), F.lit(0)).alias("least"), F.coalesce(F.max(ms), F.lit(0)).alias("most"))


def in_range(found: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events from ``start`` to ``end``, both included."""
    return found.filter(F.col("time").between(start, end))


def hidden(graph: Graph, start: Column, end: Column) -> DataFrame:
    """(id) of nodes out of a time range: by their own times, agents by those of all that refers to them.

    A node without any time of its own stays.
    """
    own = events(graph.nodes)
    timed = own.groupBy("id").agg(F.max(F.col("time").between(start, end)).alias("seen"))
    agents = graph.nodes.filter(F.array_contains("types", "Agent")).select("id")
    around = graph.edges.select(F.col("dst").alias("id"), F.col("src").alias("by")).join(agents, "id", "left_semi").join(timed.withColumnRenamed("id", "by"), "by")
    return timed.filter("not seen").select("id").unionAll(around.groupBy("id").agg(F.max("seen").alias("seen")).filter("not seen").select("id"))


_PROV = "http://www.w3.org/ns/prov#"
#: Vocabulary keys and the keys they are copied to (fixed values): full addresses, then prefixed and plain names.
COPIED = {
    f"{_PROV}startedAtTime": "temporal_start", f"{_PROV}endedAtTime": "temporal_end", f"{_PROV}generatedAtTime": "temporal_generated",
    f"{_PROV}wasGeneratedBy": "generatedBy", f"{_PROV}wasAttributedTo": "attributedTo", f"{_PROV}wasDerivedFrom": "derivedFrom",
    f"{_PROV}used": "used", f"{_PROV}wasAssociatedWith": "associatedWith",
    "prov:startedAtTime": "temporal_start", "prov:endedAtTime": "temporal_end", "prov:generatedAtTime": "temporal_generated",
    "startedAtTime": "temporal_start", "endedAtTime": "temporal_end",
}


def copied_properties(props: Column, mapping: dict[str, str] | None = None) -> Column:
    """A props map with mapped keys copied to their targets, unless a target exists; of several keys the last in the map counts."""
    targets = F.create_map(*(F.lit(x) for kv in (mapping or COPIED).items() for x in kv))
    named = F.transform(F.map_entries(props), lambda e: F.struct(F.try_element_at(targets, e["key"]).alias("key"), e["value"].alias("value")))
    new = F.filter(named, lambda e: e["key"].isNotNull() & ~F.map_contains_key(props, e["key"]))
    nothing = F.map_filter(props, lambda k, v: F.lit(False))
    last = F.aggregate(new, nothing, lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
    return F.when(F.size(new) > 0, F.map_concat(props, last)).otherwise(props)
