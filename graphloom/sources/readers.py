"""Sources: N-Triples text, CSV rows, nested JSON documents and the JSON answers of graph services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.values import local_part, to_number
from graphloom.plans.graph import Graph, least_of_each

_TERM = r'<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z-]+))?'


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples or N-Quads text (splittable; the graph name is dropped, comments are skipped)."""
    lines = spark.read.text(path).filter(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    s = F.regexp_extract("value", r"^\s*(?:<([^>]*)>|(_:\S+))\s", 1)
    rest = F.regexp_replace("value", r"^\s*(?:<[^>]*>|_:\S+)\s+<([^>]*)>\s+", "")
    o = [F.regexp_extract(rest, "^(?:" + _TERM + ")", k) for k in range(1, 6)]
    blank_s = F.regexp_extract("value", r"^\s*(_:\S+)\s", 1)
    text = o[2]
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\\\", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    otype = F.when(rest.startswith("<"), "uri").when(rest.startswith("_:"), "bnode").otherwise("literal")
    return lines.select(
        F.when(blank_s != "", blank_s).otherwise(s).alias("s"), F.regexp_extract("value", r"^\s*(?:<[^>]*>|_:\S+)\s+<([^>]*)>", 1).alias("p"),
        F.when(otype == "uri", o[0]).when(otype == "bnode", o[1]).otherwise(text).alias("o"), otype.alias("otype"),
        F.nullif(o[3], F.lit("")).alias("datatype"), F.nullif(o[4], F.lit("")).alias("lang"), F.monotonically_increasing_id().alias("ord"),
    )


def csv_rows(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """CSV with a header, trimmed; the named columns become numbers (text that isn't one becomes null)."""
    d = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return d.withColumns({c: to_number(F.col(c)) for c in numbers})


def json_graph(spark: SparkSession, path: str) -> Graph:
    """{nodes: [...], edges: [...]} documents; ids are kept, of a repeated node the one that is least as JSON, edges without both ends are dropped."""
    d = spark.read.json(path, multiLine=True)
    nodes = least_of_each(d.select(F.explode("nodes").alias("n")).select("n.*"), "id")
    edges = d.select(F.explode("edges").alias("e")).select("e.*")
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return Graph(nodes, edges)


_BINDING = "struct<type:string,value:string,datatype:string>"


def bindings(df: DataFrame, column: str) -> Graph:
    """Graph of SELECT ?s ?p ?o answers: IRIs become edges, anything else a property (the last wins)."""
    schema = f"results struct<bindings:array<struct<s:{_BINDING},p:{_BINDING},o:{_BINDING}>>>"
    b = df.select(F.posexplode(F.from_json(column, schema)["results"]["bindings"]).alias("ord", "b")).select("ord", "b.*")
    b = b.filter("s.value != '' and p.value != '' and o.value != ''")
    edges = b.filter("o.type = 'uri'").select(F.concat_ws("|", "s.value", "p.value", "o.value").alias("id"), F.col("s.value").alias("src"), F.col("o.value").alias("dst"), local_part(F.col("p.value")).alias("type"))
    last = b.filter("o.type != 'uri'").groupBy(F.col("s.value").alias("id"), local_part(F.col("p.value")).alias("k")).agg(F.max_by("o.value", "ord").alias("v"))
    props = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    ids = b.select(F.col("s.value").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    return Graph(ids.join(props, "id", "left").withColumn("types", F.array(F.lit("Resource"))), edges)


def transaction(df: DataFrame, column: str) -> Graph:
    """Graph of a transaction answer's graph rows: first node of an id wins, confidence is lifted from the properties."""
    node, rel = "struct<id:string,labels:array<string>,properties:map<string,string>>", "struct<id:string,type:string,startNode:string,endNode:string,properties:map<string,string>>"
    schema = f"results array<struct<data:array<struct<graph:struct<nodes:array<{node}>,relationships:array<{rel}>>>>>>"
    g = df.select(F.explode(F.from_json(column, schema)["results"]).alias("r")).select(F.posexplode("r.data").alias("row", "d")).select("row", "d.graph.*")
    n = g.select("row", F.posexplode("nodes").alias("k", "n")).select("row", "k", "n.*")
    n = n.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("row", "k"))).filter("rn = 1").select("id", F.col("labels").alias("types"), F.col("properties").alias("props"))
    e = g.select(F.explode("relationships").alias("e")).select("e.*")
    edges = e.select("id", F.col("startNode").alias("src"), F.col("endNode").alias("dst"), "type", F.col("properties")["confidence"].try_cast("double").alias("confidence"))
    for end in ("src", "dst"):
        edges = edges.join(n.select(F.col("id").alias(end)), end, "left_semi")
    return Graph(n, edges)


def elements(df: DataFrame, column: str) -> Graph:
    """Graph of a traversal answer's vertices, edges and element maps, in the order of ``result.data``.

    The first mention of an id gives its type (an edge mentions its ends), a vertex property's
    first value counts; items of no id, or of neither form, are left out.
    """
    items = df.select(F.posexplode(F.from_json(column, "result struct<data:array<string>>")["result"]["data"]).alias("ord", "j"))
    plain = "id string, label string, inV string, outV string, inVLabel string, outVLabel string, properties string"
    i = items.select("ord", "j", F.from_json("j", plain).alias("x")).select("ord", "j", "x.*")
    is_edge = F.col("inV").isNotNull() & F.col("outV").isNotNull() & F.col("label").isNotNull()
    is_vertex = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("inV").isNull() & F.coalesce(F.col("properties").startswith("{"), F.lit(False))
    e = i.filter(is_edge)
    values = F.transform_values(F.from_json("properties", "map<string,array<struct<value:string>>>"), lambda k, v: F.coalesce(F.get(v, 0)["value"], F.lit("")))
    flat = F.map_filter(F.from_json("j", "map<string,string>"), lambda k, v: ~k.isin("id", "label"))
    v = i.filter(is_vertex).select("ord", F.lit(0).alias("at"), "id", F.col("label").alias("type"), F.map_concat(F.create_map(F.lit("name"), "id"), F.map_filter(values, lambda k, x: k != "name")).alias("props"), values["name"].alias("own"))
    v = v.withColumn("props", F.when(F.col("own").isNull(), F.col("props")).otherwise(F.map_concat(F.map_filter("props", lambda k, x: k != "name"), F.create_map(F.lit("name"), "own")))).drop("own")
    m = i.filter(~is_edge & ~is_vertex & (F.col("id") != "")).select("ord", F.lit(0).alias("at"), "id", F.coalesce("label", F.lit("Vertex")).alias("type"), flat.alias("props"))
    none = F.lit(None).cast("map<string,string>")
    ends = [e.select("ord", F.lit(k).alias("at"), F.col(f"{end}V").alias("id"), F.coalesce(f"{end}VLabel", F.lit("Vertex")).alias("type"), none.alias("props")) for k, end in enumerate(("out", "in"))]
    first = v.unionByName(m).unionByName(ends[0]).unionByName(ends[1]).groupBy("id").agg(F.min_by(F.struct("type", "props"), F.struct("ord", "at")).alias("x"))
    nodes = first.select("id", F.array("x.type").alias("types"), F.coalesce("x.props", F.create_map().cast("map<string,string>")).alias("props"))
    return Graph(nodes, e.select(F.col("ord").cast("string").alias("id"), F.col("outV").alias("src"), F.col("inV").alias("dst"), F.col("label").alias("type")))


def holons(d: DataFrame) -> Graph:
    """Nested holons (id, label, types, portals) as nodes, their portals with an existing target as edges."""
    name = F.col("label") if "label" in d.columns else F.lit(None).cast("string")
    nodes = d.select("id", F.concat("types", F.array(F.lit("_Holon"))).alias("types"), name.alias("name"), F.lit(True).alias("is_holon"), F.size("portals").alias("portal_count"))
    p = d.select(F.col("id").alias("src"), F.explode("portals").alias("p")).select(F.col("p.id").alias("id"), "src", F.col("p.target").alias("dst"), F.col("p.label").alias("type"))
    return Graph(nodes, p.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("id", "src", "dst", "type"))


def holon_interiors(d: DataFrame) -> Graph:
    """Interior nodes of holons (``nodes``: array of id, types) with their holon, and interior edges (``edges``: src, dst, type) whose ends are both inside it."""
    nodes = d.select(F.col("id").alias("holon"), F.explode("nodes").alias("n")).select("holon", F.col("n.id").alias("id"), F.col("n.types").alias("types"))
    nodes = least_of_each(nodes, "holon", "id")
    edges = d.select(F.col("id").alias("holon"), F.explode("edges").alias("e")).select("holon", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), F.col("e.type").alias("type"))
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("holon", F.col("id").alias(end)), ["holon", end], "left_semi")
    return Graph(nodes, edges.select("holon", "src", "dst", "type"))


def holon_schema(d: DataFrame) -> DataFrame:
    """(kind, name): different types of holons and labels of portals."""
    types = d.select(F.lit("nodeType").alias("kind"), F.explode("types").alias("name"))
    return types.unionAll(d.select(F.lit("edgeType"), F.explode("portals.label"))).distinct()
