"""Sinks: Turtle lines, JSON documents and CSV rows of a (sub)graph, all written distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.filters import induced
from graphloom.plans.graph import Graph

_PREFIX = "urn:node:"


def literal(value: Column, kind: str) -> Column:
    """A Turtle literal: numbers and booleans bare, anything else quoted."""
    if kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return value.cast("string")
    t = value.cast("string")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), t, F.lit('"'))


def iri(value: Column) -> Column:
    """An IRI of an id; blanks come out as %20."""
    return F.concat(F.lit(f"<{_PREFIX}"), F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit(">"))


def turtle(graph: Graph) -> DataFrame:
    """(line): type, property and edge statements."""
    kinds = dict(graph.nodes.dtypes)
    props = [c for c in graph.nodes.columns if c not in ("id", "types", "ord") and not kinds[c].startswith(("array", "map", "struct"))]
    s = iri(F.col("id"))
    lines = [F.transform("types", lambda t: F.concat(s, F.lit(" a "), iri(t), F.lit(" .")))]
    for p in props:
        predicate = "<http://www.w3.org/2000/01/rdf-schema#label>" if p == "name" else f"<urn:prop:{p}>"
        lines.append(F.array(F.concat(s, F.lit(f" {predicate} "), literal(F.col(p), kinds[p]), F.lit(" ."))))
    nodes = graph.nodes.select(F.explode(F.array_compact(F.concat(*lines))).alias("line"))
    edges = graph.edges.select(F.concat(iri(F.col("src")), F.lit(" <urn:edge:"), F.url_encode("type"), F.lit("> "), iri(F.col("dst")), F.lit(" .")).alias("line"))
    return nodes.unionAll(edges)


def json_lines(df: DataFrame) -> DataFrame:
    """(line): one JSON object a row; null properties are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def _elements(df: DataFrame, section: int) -> DataFrame:
    """(section, key, line): the elements of a JSON list, by key; all but the first begin with a comma."""
    rows = df.select(F.lit(section).alias("section"), F.col("id").cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("json"))
    # repeated ids have different texts, or are the same element twice
    first = rows.agg(F.min(F.struct("key", "json")).alias("first"))
    comma = F.when(F.struct("key", "json").eqNullSafe(F.col("first")), "").otherwise(",")
    return rows.distinct().join(F.broadcast(first)).select("section", "key", F.concat(comma, "json").alias("line"))


def document(graph: Graph) -> DataFrame:
    """(section, key, line): the lines of one JSON document {version, nodes, edges}, in the order of section, key and line without its comma.

    The lines are written by as many tasks as there are partitions; null properties are left out.
    """
    spark = graph.nodes.sparkSession
    frame = spark.createDataFrame([(0, "", '{"version":1,"nodes":['), (2, "", '],"edges":['), (4, "", "]}")], "section int, key string, line string")
    return frame.unionByName(_elements(graph.nodes, 1)).unionByName(_elements(graph.edges, 3))


def export(graph: Graph, fmt: str, ids: DataFrame | None = None) -> tuple[str, dict[str, DataFrame]]:
    """(scope, tables of lines or rows) of the induced subgraph of ``ids`` as json, turtle or csv; without ids, or with none of them, of the whole graph."""
    chosen = ids is not None and not ids.isEmpty()
    part = induced(graph, ids) if chosen else graph
    made = {"json": lambda: {"document": document(part)}, "turtle": lambda: {"lines": turtle(part)}, "csv": lambda: {"nodes": csv_ready(part.nodes), "edges": csv_ready(part.edges)}}
    if fmt not in made:
        raise ValueError(f"unknown format {fmt!r}")
    return "selection" if chosen else "graph", made[fmt]()


def csv_ready(df: DataFrame) -> DataFrame:
    """All columns as text: arrays joined by ``;``, other nested values as JSON, property columns sorted."""
    kinds = dict(df.dtypes)
    first = [c for c in ("id", "types", "src", "dst", "type") if c in kinds]
    rest = sorted(c for c in kinds if c not in first)

    def text(c: str) -> Column:
        if kinds[c] == "array<string>":
            return F.array_join(c, ";")
        return F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c).cast("string")

    return df.select(*(text(c).alias(c) for c in first + rest))
