"""Groups of nodes as a membership table (group, id), their summaries, tags, and subgraphs of one group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.communities import communities, numbered
from graphloom.operators.filters import induced
from graphloom.operators.updates import collapse, regroup_edges
from graphloom.plans.graph import Graph, primary_type
from graphloom.plans.session import joined, released, stored


def created(membership: DataFrame, group: str, ids: DataFrame) -> DataFrame:
    """The memberships with a new group, or with more members of an old one."""
    return membership.unionByName(ids.select(F.lit(group).alias("group"), "id")).distinct()


def dissolved(membership: DataFrame, group: str) -> DataFrame:
    """Without a group; groups nested in it stay, on their own."""
    return membership.filter((F.col("group") != group) & (F.col("id") != group))


def nested(membership: DataFrame) -> DataFrame:
    """(group, id): memberships of nodes in all groups around their own, for groups that are members of groups."""
    inner = membership.select(F.col("group").alias("via"), "id")
    parts = [stored(membership.select("group", "id").distinct())]
    while True:
        seen = reduce(DataFrame.unionAll, parts)
        level = stored(parts[-1].select("group", F.col("id").alias("via")).join(inner, "via").select("group", "id").distinct().join(seen, ["group", "id"], "left_anti"))
        if level.isEmpty():
            released(level)
            return joined(parts)
        parts = [*(parts if len(parts) < 8 else [joined(parts)]), level]


def serialized(membership: DataFrame, details: DataFrame) -> DataFrame:
    """(id, json): one document a group of details(id, name, ...) with its sorted ``memberIds``; groups without members have an empty list.

    A group's members are a selection somebody made, so they fit into a document.
    """
    m = membership.groupBy(F.col("group").alias("id")).agg(F.sort_array(F.collect_set("id")).alias("memberIds"))
    whole = details.join(m, "id", "left").withColumn("memberIds", F.coalesce("memberIds", F.array().cast("array<string>")))
    return whole.select("id", F.to_json(F.struct(*whole.columns)).alias("json"))


def deserialized(docs: DataFrame, json: str) -> tuple[DataFrame, DataFrame, int]:
    """(membership, details, the next group's number) of such documents; a document without an id is left out."""
    d = docs.select(F.from_json(json, "id string, name string, memberIds array<string>").alias("g")).select("g.*").filter("id is not null")
    last = d.agg(F.max(F.regexp_extract("id", r"^combo_(\d+)$", 1).try_cast("long"))).first()[0]
    return d.select(F.col("id").alias("group"), F.explode("memberIds").alias("id")).distinct(), d.select("id", "name"), (last or 0) + 1


def breakdown(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(group, members, types, label): members by type, and the commonest one's name; ties go to the lesser name."""
    per = membership.join(nodes.select("id", primary_type().alias("type")), "id").groupBy("group", "type").agg(F.count(F.lit(1)).alias("k"))
    # one entry a type, so the list is as short as the schema
    listed = F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "type")))
    all_ = per.groupBy("group").agg(F.sum("k").alias("members"), listed.alias("t"))
    types = F.array_join(F.transform("t", lambda x: F.concat(x["type"], F.lit(" ("), (-x["k"]).cast("string"), F.lit(")"))), ", ")
    return all_.select("group", "members", types.alias("types"), F.concat(F.get("t", 0)["type"], F.lit(" cluster ("), F.col("members").cast("string"), F.lit(")")).alias("label"))


def collapsed_groups(graph: Graph, membership: DataFrame) -> Graph:
    """A summary node in place of each group's members, edges moved to it, edges inside a group dropped."""
    own = membership.groupBy("id").agg(F.min("group").alias("group"))
    parts = breakdown(graph.nodes, own)
    rest = graph.nodes.join(own.select("id"), "id", "left_anti").select("id", "types", F.lit(None).cast("string").alias("summary"))
    made = parts.select(F.col("group").alias("id"), F.array(F.lit("Group")).alias("types"), F.col("types").alias("summary"))
    return Graph(rest.unionAll(made), regroup_edges(graph.edges, membership))


def with_parents(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """Nodes with the group they hang in (the least one), null without."""
    return nodes.join(membership.groupBy("id").agg(F.min("group").alias("parent")), "id", "left")


def tags_removed(nodes: DataFrame, untagged: DataFrame) -> DataFrame:
    """Nodes whose tags lack those of ``untagged(id, tag)``."""
    gone = untagged.groupBy("id").agg(F.collect_set("tag").alias("__t"))
    return nodes.join(gone, "id", "left").withColumn("tags", F.array_except("tags", F.coalesce("__t", F.array().cast("array<string>")))).drop("__t")


def tag_counts(nodes: DataFrame) -> DataFrame:
    """(tag, n) of all tags in use, sorted."""
    return nodes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy("tag")


def subgraph(graph: Graph, ids: DataFrame, most: int = 1500) -> tuple[Graph, bool]:
    """The induced subgraph of the first ``most`` members in order, and whether members were left out; the bound is the feature's."""
    chosen = graph.nodes.join(ids.select("id").distinct(), "id", "left_semi").orderBy("ord", "id").limit(most + 1)
    truncated = chosen.count() > most
    return induced(graph, chosen.orderBy("ord", "id").limit(most)), truncated


def collapse_above(graph: Graph, cluster: str | None = None, *, threshold: int = 2000, ceiling: int = 200) -> tuple[Graph, bool]:
    """The graph itself up to ``threshold`` nodes, else its clusters by a property, or by modularity without one; and whether it was collapsed."""
    if graph.nodes.limit(threshold + 1).count() <= threshold:
        return graph, False
    if cluster is not None:
        return collapse(graph, F.col(cluster), ceiling=ceiling), True
    own = numbered(communities(graph.nodes, graph.edges)).withColumnRenamed("cluster", "__cluster")
    return collapse(Graph(graph.nodes.join(own, "id"), graph.edges), F.col("__cluster"), ceiling=ceiling), True


def ranked_members(nodes: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` nodes of each group in an order (a top-k report, ranked with a limit before the shuffle)."""
    return nodes.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order), "id"))).filter(F.col("nth") <= most)
