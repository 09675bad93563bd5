"""What tabular, geographic, temporal and schema views show of a graph, as DataFrames; and notes on its elements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.aggregates import number_of
from graphloom.operators.filters import induced
from graphloom.operators.shapes import Shape
from graphloom.operators.traversal import hops
from graphloom.plans.graph import Graph, primary_type

#: Property names that hold a start or an end, in the order they are tried.
START_KEYS = ("temporal_start", "date", "datetime", "timestamp", "time", "start")
END_KEYS = ("temporal_end", "end")
#: Rows that each view takes at most.
LIMITS = {"canvas": 500, "table": 10000, "tree": 1000, "matrix": 200, "sankey": 100, "streaming": 500}
_FIXED = ("id", "types", "ord")


def neighborhood(graph: Graph, start: DataFrame, depth: int, *, types: list[str] | None = None) -> Graph:
    """The induced subgraph within ``depth`` undirected steps; unknown start ids give an empty graph."""
    known = start.select("id").distinct().join(graph.nodes.select("id"), "id", "left_semi")
    return induced(graph, hops(graph.edges, known, depth, types=types))


def ring(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id): the nodes exactly ``depth`` undirected steps away."""
    return hops(edges, start, depth).filter(F.col("depth") == depth).select("id")


def _first(nodes: DataFrame, names: tuple[str, ...], type_: str) -> Column:
    """The first of some columns that can be read as a type; whole numbers are times in milliseconds."""
    types = dict(nodes.dtypes)
    held = [F.timestamp_millis(n) if type_ == "timestamp" and types[n] in ("int", "bigint") else F.col(n).cast("string").try_cast(type_) for n in names if n in types]
    return F.coalesce(*held) if held else F.lit(None).cast(type_)


def geo_points(nodes: DataFrame, width: float = 800, height: float = 400) -> DataFrame:
    """(id, name, type, x, y) of nodes with latitude and longitude, in an equirectangular projection; text that holds a number is read as one."""
    lat, lon = _first(nodes, ("lat", "latitude"), "double"), _first(nodes, ("lon", "longitude"), "double")
    name = F.coalesce(F.col("name"), F.col("id")) if "name" in nodes.columns else F.col("id")
    x, y = (F.col("__lon") + 180) / 360 * width, (90 - F.col("__lat")) / 180 * height
    placed = nodes.withColumns({"__lat": lat, "__lon": lon}).filter("__lat is not null and __lon is not null and not isnan(__lat) and not isnan(__lon)")
    return placed.select("id", name.alias("name"), primary_type().alias("type"), x.alias("x"), y.alias("y"))


def geo_lines(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, x1, y1, x2, y2) of edges between two placed nodes."""
    a, b = (points.select(F.col("id").alias(end), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k, end in ((1, "src"), (2, "dst")))
    return edges.join(a, "src").join(b, "dst").select("id", "type", "x1", "y1", "x2", "y2")


def timeline_items(nodes: DataFrame) -> DataFrame:
    """(id, content, kind, start, end) of nodes whose first readable start key holds a time; end may be null."""
    name = F.coalesce(F.col("name"), F.col("id")) if "name" in nodes.columns else F.col("id")
    items = nodes.select("id", name.alias("content"), primary_type().alias("kind"), _first(nodes, START_KEYS, "timestamp").alias("start"), _first(nodes, END_KEYS, "timestamp").alias("end"))
    return items.filter("start is not null")


def overlapping(items: DataFrame, start: Column, end: Column) -> DataFrame:
    """Items whose interval (a point without an end) meets the closed range."""
    return items.filter((F.col("start") <= end) & (F.coalesce("end", "start") >= start))


def coverage(substantiated: Column, claimable: Column) -> tuple[Column, Column, Column]:
    """Shares held to 0..1 (none for NaN), the claim never below what is shown, and the rounded gap between them."""
    def held(c: Column) -> Column:
        return F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))

    shown = held(substantiated)
    claim = F.greatest(shown, held(claimable))
    return shown, claim, F.round(claim - shown, 3)


def fields(nodes: DataFrame, spec: dict[str, str] | None = None, *, rest: bool = True) -> DataFrame:
    """(place, key, widget): the columns to show, those of ``spec`` (key -> widget) first, the others by their type.

    Columns are schema, so this reads no rows; keys of ``spec`` that aren't columns are left out.
    """
    types = {c: t for c, t in nodes.dtypes if c not in _FIXED}

    def widget(t: str) -> str:
        if t == "boolean":
            return "checkbox"
        if t.startswith("decimal") or t in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            return "number"
        return "text" if t == "string" else "readonly"

    rows = [(k, w) for k, w in (spec or {}).items() if k in types]
    if rest:
        rows += [(k, widget(t)) for k, t in types.items() if k not in dict(rows)]
    return nodes.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, key string, widget string")


def coerced(widget: str, raw: Column) -> Column:
    """Text from a widget as its property's type: numbers that can't be read are 0, any text checks a box."""
    if widget == "number":
        n = F.trim(raw).try_cast("double")
        return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(n)
    if widget in ("checkbox", "toggle"):
        return F.coalesce(raw != "", F.lit(False))
    return raw.cast("string")


def schema_view(nodes: DataFrame, shapes: list[Shape] = ()) -> DataFrame:
    """(name, properties, constraints): classes with the keys that their nodes hold and their shape's number of rules."""
    props = [c for c in nodes.columns if c not in _FIXED]
    held = nodes.select(F.explode("types").alias("__class"), *(F.col(p).isNotNull().alias(f"__has_{p}") for p in props)).groupBy("__class").agg(*(F.bool_or(f"__has_{p}").alias(f"__has_{p}") for p in props), F.lit(1).alias("__one"))
    keys = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"__has_{p}"), F.lit(p)) for p in props)))) if props else F.array().cast("array<string>")
    rules = reduce(lambda c, s: c.when(F.col("__class") == s.target, len(s.rules)), shapes, F.when(F.lit(False), 0)).otherwise(0)
    return held.select(F.col("__class").alias("name"), F.array_join(keys, ",").alias("properties"), rules.cast("long").alias("constraints"))


def shape_rows(spark: SparkSession, shapes: list[Shape]) -> DataFrame:
    """(row, shape, text, closed): one row a rule, as name : type [least..most] (+other rules). Shapes are schema."""
    rows = []
    for s in shapes:
        for r in s.rules:
            more = sum(x is not None for x in (r.pattern, r.values, r.least, r.most))
            text = f"{r.path}{f' : {r.datatype}' if r.datatype else ''} [{r.min_count}..*]{f' (+{more})' if more else ''}"
            rows.append((f"{s.id}::prop::{r.path}", s.id, text, s.closed))
    return spark.createDataFrame(rows, "row string, shape string, text string, closed boolean")


def within_limits(views: dict[str, DataFrame], limits: dict[str, int] = LIMITS) -> DataFrame:
    """(view, allowed, requested): whether each view's rows fit; counting stops one past the limit."""
    def one(name: str, rows: DataFrame) -> DataFrame:
        most = limits[name]
        return rows.limit(most + 1).agg(F.count(F.lit(1)).alias("requested")).select(F.lit(name).alias("view"), (F.col("requested") <= most).alias("allowed"), "requested")

    return reduce(DataFrame.unionAll, (one(*v) for v in views.items()))


def label_size(label: Column, *, header: bool = False) -> Column:
    """Width of a label's box."""
    per, margin = (9, 12) if header else (7, 4)
    return F.ceil(F.length(label) * per) + margin


#: Endings of image files, and schemes whose addresses are taken for images.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "webp", "gif", "svg")
WEB_SCHEMES = ("http", "https")


def is_image(ref: Column) -> Column:
    """Whether text names an image: embedded data, a web address, or a file whose ending (before any query) is an image's; no file name has white space."""
    low = F.lower(ref)
    scheme, rest = F.substring_index(low, ":", 1), F.substring(low, F.instr(low, ":") + 1, F.length(low))
    embedded = (scheme == "data") & rest.startswith("image/")
    web = scheme.isin(*WEB_SCHEMES) & rest.startswith("//")
    name = F.substring_index(low, "?", 1)
    dot = F.length(name) - F.length(F.substring_index(name, ".", -1))
    # something has to stand in front of the dot
    ended = (dot > 1) & F.substring_index(name, ".", -1).isin(*IMAGE_ENDINGS) & ~F.regexp_like(low, F.lit(r"\s")) & (F.substring(name, 1, dot - 1) != "/")
    return F.coalesce((F.instr(low, ":") > 0) & (embedded | web) | ended, F.lit(False))


def page(rows: DataFrame, order: list[Column | str], number: int = 0, size: int = 50) -> DataFrame:
    """One page of a table in an order (a view's limit); later pages skip the rows before them."""
    ordered = rows.orderBy(*order)
    return ordered.offset(number * size).limit(size) if number else ordered.limit(size)


def property_range(nodes: DataFrame, name: str) -> DataFrame:
    """(least, most, missing) of a property's numbers."""
    x = number_of(nodes, name)
    return nodes.agg(F.min(x).alias("least"), F.max(x).alias("most"), F.count_if(x.isNull()).alias("missing"))


def chart_rows(rows: DataFrame, label: str, value: str) -> DataFrame:
    """(label, value) of an answer's rows that have a number in ``value``; text is read."""
    return rows.select(F.col(label).cast("string").alias("label"), number_of(rows, value).alias("value")).filter("value is not null")


# notes: a table (id, text, at), its last row of an id counting


def notes_set(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """Notes with newer ones put in place of old; a null or empty text deletes its note."""
    last = notes.select("id", "text", "at").unionByName(rows.select("id", "text", "at")).groupBy("id").agg(F.max(F.struct("at", "text")).alias("x"))
    return last.select("id", "x.text", "x.at").filter("text is not null and text != ''")


def with_notes(elements: DataFrame, notes: DataFrame) -> DataFrame:
    """Elements with their note, null without."""
    return elements.join(notes.select("id", F.col("text").alias("note")), "id", "left")
