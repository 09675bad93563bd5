"""Graphs from JSON of any shape by a user's mapping of paths, and documents of algorithm results.

JSON is parsed once into VARIANT columns; what can't be parsed, or isn't what it has to be, goes
to a table of rejects with the reason instead of ending the job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.updates import update_join
from graphloom.plans.graph import Graph


@dataclass(frozen=True)
class Items:
    """Where a document has its nodes or edges, and where each of them has its parts; ``properties`` is an object or {name: path}."""

    at: str
    id: str = "$.id"
    type: str = "$.type"
    source: str = "$.source"
    target: str = "$.target"
    properties: str | dict[str, str] = "$.properties"
    default_type: str = "Resource"


@dataclass(frozen=True)
class Mapping:
    nodes: tuple[Items, ...] = (Items("$.nodes"),)
    edges: tuple[Items, ...] = field(default_factory=lambda: (Items("$.edges", default_type="related"),))


def parsed(docs: DataFrame, json: str) -> tuple[DataFrame, DataFrame]:
    """Documents with a VARIANT column ``__doc``, and the rejects (with ``reason``): null, or no JSON."""
    d = docs.withColumn("__doc", F.try_parse_json(json))
    bad = d.filter("__doc is null").drop("__doc").withColumn("reason", F.when(F.col(json).isNull(), "no document").otherwise("not JSON"))
    return d.filter("__doc is not null"), bad


def _each(docs: DataFrame, order: list[str], place: int, items: Items) -> DataFrame:
    """(doc order, place, pos, x): the items of one path; a path that holds no array gives none."""
    held = F.try_variant_get("__doc", items.at, "array<variant>")
    return docs.select(*order, F.lit(place).alias("__place"), F.posexplode(held).alias("__pos", "x"))


def _text(path: str) -> Column:
    return F.try_variant_get("x", path, "string")


def _properties(items: Items) -> Column:
    if isinstance(items.properties, str):
        held = F.try_variant_get("x", items.properties, "map<string, variant>")
        texts = F.transform_values(held, lambda _, v: F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))
    else:
        texts = F.create_map(*(c for name, path in items.properties.items() for c in (F.lit(name), _text(path)))) if items.properties else F.create_map()
        texts = texts.cast("map<string,string>")
    return F.coalesce(F.map_filter(texts, lambda _, v: v.isNotNull()), F.create_map().cast("map<string,string>"))


def mapped_graph(docs: DataFrame, json: str, mapping: Mapping, *, key: str) -> tuple[Graph, DataFrame]:
    """(graph, rejects) of documents ordered by ``key``: nodes (id, types, props), edges (id, src, dst, type, props).

    Given ids are kept; a repeated node id keeps its first mention, edges without an id get one
    from their ends, type and place, and edges whose ends aren't nodes are dropped. Items without an id
    (nodes) or ends (edges) are left out; a type may be one text or a list.
    """
    good, rejects = parsed(docs.select(key, json), json)
    parts = []
    for place, items in enumerate(mapping.nodes):
        kinds = F.coalesce(F.try_variant_get("x", items.type, "array<string>"), F.when(_text(items.type).isNotNull(), F.array(_text(items.type))), F.array(F.lit(items.default_type)))
        parts.append(_each(good, [key], place, items).select(key, "__place", "__pos", _text(items.id).alias("id"), kinds.alias("types"), _properties(items).alias("props")))
    nodes = _union(parts).filter("id is not null")
    at = F.struct(F.col(key), "__place", "__pos")
    nodes = nodes.groupBy("id").agg(F.min_by(F.struct("types", "props"), at).alias("x")).select("id", "x.types", "x.props")
    parts = []
    for place, items in enumerate(mapping.edges):
        kind = F.coalesce(_text(items.type), F.lit(items.default_type))
        made = F.sha2(F.concat_ws("\u0001", _text(items.source), _text(items.target), kind, F.col(key).cast("string"), "__place", "__pos"), 256)
        parts.append(_each(good, [key], place, items).select(F.coalesce(_text(items.id), made).alias("id"), _text(items.source).alias("src"), _text(items.target).alias("dst"), kind.alias("type"), _properties(items).alias("props")))
    edges = _union(parts).filter("src is not null and dst is not null")
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return Graph(nodes, edges.select("id", "src", "dst", "type", "props")), rejects


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# documents of algorithm results: version 1, one of three kinds

#: The version that is read, and the kinds.
VERSION, KINDS = 1, ("nodeProperties", "edgeProperties", "overlay")


def algorithm_results(docs: DataFrame, json: str) -> tuple[DataFrame, DataFrame]:
    """(results, rejects): the documents' kind, algorithm, properties by element, and overlay; rejects say why.

    A document needs version 1, a known kind, and for an overlay its id, else an object of
    properties. The version is a number: one as text is another version.
    """
    d, bad = parsed(docs, json)
    version = F.when(F.schema_of_variant(F.try_variant_get("__doc", "$.version", "variant")).isin("BIGINT", "DOUBLE") | F.schema_of_variant(F.try_variant_get("__doc", "$.version", "variant")).startswith("DECIMAL"), F.try_variant_get("__doc", "$.version", "double"))
    overlay = "struct<id: string, label: string, nodeIds: array<string>, edgeIds: array<string>>"
    d = d.withColumns({
        "version": version, "kind": F.try_variant_get("__doc", "$.kind", "string"), "algorithm": F.try_variant_get("__doc", "$.algorithm", "string"),
        "properties": F.try_variant_get("__doc", "$.properties", "map<string, map<string, variant>>"), "overlay": F.try_variant_get("__doc", "$.overlay", overlay),
    })
    is_overlay = F.col("kind") == "overlay"
    reason = (
        F.when(F.coalesce(F.col("version") != VERSION, F.lit(True)), "unsupported version").when(F.coalesce(~F.col("kind").isin(*KINDS), F.lit(True)), "unknown kind")
        .when(is_overlay & F.col("overlay.id").isNull(), "overlay without id").when(~is_overlay & F.col("properties").isNull(), "no properties object")
    )
    d = d.withColumn("reason", reason)
    given = docs.columns
    return d.filter("reason is null").select(*given, "kind", "algorithm", "properties", "overlay"), bad.unionByName(d.filter("reason is not null").select(*given, "reason"))


def property_rows(results: DataFrame, kind: str, names: dict[str, str], order: str) -> DataFrame:
    """(element, place, one column a name): the properties of a kind of document, of the types in ``names``; place is the documents' order."""
    each = results.filter(F.col("kind") == kind).select(F.col(order).alias("place"), F.explode("properties").alias("element", "p"))
    return each.select("element", "place", *(F.try_variant_get(F.col("p")[n], "$", t).alias(n) for n, t in names.items()))


def _last(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row an element: of each property the last document's value that isn't null."""
    value = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("place"))).alias(n) for n in names]
    return rows.groupBy("element").agg(*value)


def overlays(results: DataFrame, order: str) -> DataFrame:
    """(overlay, label, algorithm, element, id): members of the documents' overlays; of documents with one id the last counts."""
    o = results.filter("kind = 'overlay'").groupBy("overlay.id").agg(F.max_by(F.struct("overlay", "algorithm"), order).alias("x"))
    o = o.select(F.col("id").alias("overlay"), F.coalesce("x.overlay.label", "id").alias("label"), F.col("x.algorithm").alias("algorithm"), F.col("x.overlay.nodeIds").alias("n"), F.col("x.overlay.edgeIds").alias("e"))
    none = F.array().cast("array<string>")

    def members(element: str, ids: str) -> Column:
        return F.transform(F.coalesce(ids, none), lambda i: F.struct(F.lit(element).alias("element"), i.alias("id")))

    return o.select("overlay", "label", "algorithm", F.explode(F.concat(members("node", "n"), members("edge", "e"))).alias("m")).select("overlay", "label", "algorithm", "m.element", "m.id")


def applied(graph: Graph, results: DataFrame, node_properties: dict[str, str], edge_properties: dict[str, str], *, order: str) -> tuple[Graph, DataFrame]:
    """(graph, overlays): property documents merged into nodes and edges by id, later ones last; overlays leave the graph alone.

    Elements that the graph lacks are ignored, properties not named are left out.
    """
    parts = []
    for df, kind, names in ((graph.nodes, "nodeProperties", node_properties), (graph.edges, "edgeProperties", edge_properties)):
        rows = _last(property_rows(results, kind, names, order), names)
        parts.append(update_join(df, rows, "element") if names else df)
    return Graph(*parts), overlays(results, order)
