"""Structural graphs of model diagrams: blocks, inner parts, constraints and requirements, from tables.

A model is four tables: ``blocks`` (id, name, kind, stereotype, parts, parameters, constraint),
``links`` (id, source, target, kind, stereotype, label, source_port, target_port),
``requirements`` (id, name, text, parent) and ``diagrams`` (id, type, context, members): what a diagram
shows are the ids in its members. Of all diagrams of a type at once, nodes are (diagram, id,
header, rows, ports) and edges (diagram, id, source, target, kind, label).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.traversal import hops
from graphloom.plans.graph import Graph

_NONE = "array<string>"


@dataclass(frozen=True)
class Model:
    blocks: DataFrame
    links: DataFrame
    requirements: DataFrame
    diagrams: DataFrame


def _members(model: Model, kind: str) -> DataFrame:
    shown = model.diagrams.filter(F.col("type") == kind)
    return shown.select(F.col("id").alias("diagram"), "context", F.explode("members").alias("member"))


def _empty() -> Column:
    return F.array().cast(_NONE)


def _header(stereotype: Column, name: Column) -> Column:
    return F.when(stereotype.isNotNull(), F.concat(F.lit("«"), stereotype, F.lit("» "), name)).otherwise(name)


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends the same diagram shows."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select("diagram", F.col("id").alias(end)).distinct(), ["diagram", end], "left_semi")
    return edges.select("diagram", "id", "source", "target", "kind", "label")


def definitions(model: Model) -> Graph:
    """Block definition diagrams: member blocks with their parts and parameters as rows, and the member links between them."""
    m = _members(model, "bdd")
    rows = F.concat(F.coalesce(F.transform("parts", lambda p: F.concat(p["name"], F.lit(" : "), p["type"])), _empty()), F.coalesce("parameters", _empty()))
    nodes = m.join(model.blocks, F.col("member") == F.col("id")).select("diagram", "id", _header(F.col("stereotype"), F.col("name")).alias("header"), rows.alias("rows"), _empty().alias("ports"))
    label = F.when(F.col("stereotype").isNotNull(), F.concat(F.lit("«"), "stereotype", F.lit("»"))).otherwise(F.col("label"))
    edges = m.join(model.links, F.col("member") == F.col("id")).select("diagram", "id", "source", "target", "kind", label.alias("label"))
    return Graph(nodes, _between(edges, nodes))


def interiors(model: Model) -> Graph:
    """Internal block diagrams: the context block's parts, named with their type's name, with their ports, and the member links between them."""
    shown = model.diagrams.filter("type = 'ibd'").select(F.col("id").alias("diagram"), "context")
    parts = shown.join(model.blocks, F.col("context") == F.col("id")).select("diagram", F.explode("parts").alias("p"))
    named = model.blocks.select(F.col("id").alias("type"), F.col("name").alias("type_name"))
    nodes = parts.select("diagram", "p.*").join(named, "type", "left")
    header = F.concat("name", F.lit(" : "), F.coalesce("type_name", "type"))
    nodes = nodes.select("diagram", "id", header.alias("header"), _empty().alias("rows"), F.coalesce("ports", _empty()).alias("ports"))
    edges = _members(model, "ibd").join(model.links, F.col("member") == F.col("id")).select("diagram", "id", "source", "target", F.lit("association").alias("kind"), "label")
    return Graph(nodes, _between(edges, nodes))


def parametrics(model: Model) -> Graph:
    """Parametric diagrams: the context constraint with its equation and parameters, and a value for each member link, bound to it if its target port is a parameter."""
    shown = model.diagrams.filter("type = 'par'").select(F.col("id").alias("diagram"), "context")
    own = shown.join(model.blocks.filter("kind = 'constraint'"), F.col("context") == F.col("id"))
    equation = F.when(F.col("constraint").isNotNull(), F.array(F.concat(F.lit("{"), "constraint", F.lit("}")))).otherwise(_empty())
    held = F.coalesce("parameters", _empty())
    constraints = own.select("diagram", "id", F.concat(F.lit("«constraint» "), "name").alias("header"), F.concat(equation, held).alias("rows"), held.alias("ports"))
    bound = _members(model, "par").join(model.links, F.col("member") == F.col("id")).join(own.select("diagram", F.col("id").alias("block"), held.alias("known")), "diagram")
    values = bound.select("diagram", F.concat(F.lit("val."), "id").alias("id"), F.col("source").alias("header"), _empty().alias("rows"), _empty().alias("ports"))
    edges = bound.filter(F.array_contains("known", F.col("target_port"))).select("diagram", F.concat(F.lit("bind."), "id").alias("id"), F.concat(F.lit("val."), "id").alias("source"), F.col("block").alias("target"), F.lit("association").alias("kind"), "label")
    return Graph(constraints.unionByName(values), edges)


def requirements(model: Model) -> Graph:
    """Requirement diagrams: member requirements with all below them, their containment, and the blocks of member links that satisfy one of them."""
    m = _members(model, "req")
    tops = m.join(model.requirements.select(F.col("id").alias("member")), "member", "left_semi")
    # the walk is keyed by diagram, so that diagrams share requirements
    key = F.concat_ws("\u0001", "diagram", "member")
    inside = model.requirements.filter("parent is not null").join(m.select("diagram").distinct().hint("broadcast"))
    down = inside.select(F.concat_ws("\u0001", "diagram", "parent").alias("src"), F.concat_ws("\u0001", "diagram", "id").alias("dst"), F.lit("contains").alias("type"))
    reached = hops(down, tops.select(key.alias("id")), directed=True).select(F.substring_index("id", "\u0001", 1).alias("diagram"), F.substring_index("id", "\u0001", -1).alias("id"))
    nodes = reached.join(model.requirements, "id").select("diagram", "id", _header(F.lit("requirement"), F.col("name")).alias("header"), F.array("id", "text").alias("rows"), _empty().alias("ports"), "parent")
    contained = nodes.filter("parent is not null").select("diagram", F.concat_ws(".", F.lit("ct"), "parent", "id").alias("id"), F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("composition").alias("kind"), F.lit(None).cast("string").alias("label"))
    contained = contained.join(reached.select("diagram", F.col("id").alias("source")), ["diagram", "source"], "left_semi").select(contained.columns)
    links = m.join(model.links.filter("stereotype = 'satisfy'"), F.col("member") == F.col("id")).join(reached.select("diagram", F.col("id").alias("target")), ["diagram", "target"], "left_semi")
    blocks = links.select("diagram", F.col("source").alias("id")).distinct().join(model.blocks, "id")
    boxes = blocks.select("diagram", "id", _header(F.lit("block"), F.col("name")).alias("header"), _empty().alias("rows"), _empty().alias("ports"))
    satisfied = links.select("diagram", "id", "source", "target", F.lit("dependency").alias("kind"), F.lit("«satisfy»").alias("label"))
    return Graph(nodes.drop("parent").unionByName(boxes), contained.unionByName(satisfied))


#: Diagram types and what projects them.
TYPES = {"bdd": definitions, "ibd": interiors, "par": parametrics, "req": requirements}
