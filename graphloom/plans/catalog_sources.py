"""Registered queries: readers over files and answers written from the tables, encoding specs, literals, lookups in reports and ontologies, sliding windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import values
from graphloom.operators import encoding_spec, groups, ontology, rdf, shapes, summaries, views
from graphloom.plans.catalog import _CHECKS, _N, _NE, _inferred, _ontology, _read, _triples, _validated, query
from graphloom.plans.graph import Graph, star_edges, star_nodes
from graphloom.plans.session import shared_dir
from graphloom.sources import readers
from graphloom.streaming import changes


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# files


@query("select 'urn:c:' || c_custkey as s, 'urn:name' as p, c_name || ' \"x\"' as o, 'literal' as otype, 'en' as lang from customer union all select 'urn:c:' || c_custkey, 'urn:in', 'urn:n:' || c_nationkey, 'uri', null from customer union all select '_:b' || c_custkey, 'urn:of', 'urn:c:' || c_custkey, 'uri', null from customer")
def ntriples_file(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    s = F.concat(F.lit("<urn:c:"), key, F.lit(">"))
    lines = F.array(
        F.lit("# a comment"), F.concat(s, F.lit(' <urn:name> "'), "c_name", F.lit(' \\"x\\""@en .')), F.concat(s, F.lit(" <urn:in> <urn:n:"), F.col("c_nationkey").cast("string"), F.lit("> <urn:graph> .")),
        F.concat(F.lit("_:b"), key, F.lit(" <urn:of> "), s, F.lit(" .")), F.lit(""),
    )
    path = _path(spark, "nt")
    c.select(F.explode(lines).alias("value")).write.text(path)
    return readers.ntriples(spark, path).select("s", "p", "o", "otype", "lang")


@query("select 'part:' || p_partkey as id, p_name as name, case when p_partkey % 3 != 0 then p_size::double end as size from part")
def csv_file(spark: SparkSession, d: str) -> DataFrame:
    p = _read(spark, d, "part")
    size = F.when(F.col("p_partkey") % 3 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    path = _path(spark, "csv")
    p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"), size.alias("size")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.csv_rows(spark, path, ["size"])


def _json_folder(spark: SparkSession, d: str) -> str:
    """One document a nation, with its customers and an edge to nowhere."""
    c = _read(spark, d, "customer")
    ref, to = F.concat(F.lit("customer:"), "c_custkey"), F.concat(F.lit("nation:"), "c_nationkey")
    per = c.groupBy("c_nationkey").agg(
        F.collect_list(F.struct(ref.alias("id"), F.col("c_name").alias("name"))).alias("nodes"), F.collect_list(F.struct(F.concat(F.lit("in/"), "c_custkey").alias("id"), ref.alias("src"), to.alias("dst"))).alias("edges"), F.first(to).alias("n"),
    )
    nodes = F.concat("nodes", F.array(F.struct(F.col("n").alias("id"), F.lit(None).cast("string").alias("name"))))
    extra = F.array(F.struct(F.concat(F.lit("bad/"), "c_nationkey").alias("id"), F.col("n").alias("src"), F.lit("nowhere").alias("dst")))
    path = _path(spark, "json")
    per.select(F.to_json(F.struct(nodes.alias("nodes"), F.concat("edges", extra).alias("edges"))).alias("value"), "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return path


@query("select 'customer:' || c_custkey as id, c_name as name from customer union all select distinct 'nation:' || c_nationkey, null from customer")
def json_file_nodes(spark: SparkSession, d: str) -> DataFrame:
    return readers.json_graph(spark, _json_folder(spark, d)).nodes.select("id", "name")


@query("select 'in/' || c_custkey as id, 'customer:' || c_custkey as src, 'nation:' || c_nationkey as dst from customer")
def json_file_edges(spark: SparkSession, d: str) -> DataFrame:
    return readers.json_graph(spark, _json_folder(spark, d)).edges.select("id", "src", "dst")


# answers of services, one a nation


def _binding(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"))


def _bindings(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer")
    s, t = F.concat(F.lit("urn:x/c"), F.col("c_custkey").cast("string")), F.concat(F.lit("urn:x/n"), F.col("c_nationkey").cast("string"))
    rows = F.array(
        F.struct(_binding("uri", s).alias("s"), _binding("uri", F.lit("urn:x#name")).alias("p"), _binding("literal", F.col("c_name")).alias("o")),
        F.struct(_binding("uri", s).alias("s"), _binding("uri", F.lit("urn:x#in")).alias("p"), _binding("uri", t).alias("o")),
        F.struct(_binding("uri", s).alias("s"), _binding("uri", F.lit("urn:x#none")).alias("p"), _binding("literal", F.lit("")).alias("o")),
    )
    per = c.groupBy("c_nationkey").agg(F.flatten(F.collect_list(rows)).alias("bindings"))
    return per.select(F.to_json(F.struct(F.struct("bindings").alias("results"))).alias("answer"))


@query("select 'urn:x/c' || c_custkey as id, c_name as name from customer union all select distinct 'urn:x/n' || c_nationkey, null from customer")
def bindings_nodes(spark: SparkSession, d: str) -> DataFrame:
    return readers.bindings(_bindings(spark, d), "answer").nodes.select("id", F.col("props")["name"].alias("name"))


@query("select 'urn:x/c' || c_custkey as src, 'urn:x/n' || c_nationkey as dst, 'in' as type from customer")
def bindings_edges(spark: SparkSession, d: str) -> DataFrame:
    return readers.bindings(_bindings(spark, d), "answer").edges.select("src", "dst", "type")


def _transactions(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer")
    ref, to = F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")
    none = F.create_map().cast("map<string,string>")
    node = F.struct(ref.alias("id"), F.array(F.lit("Customer"), F.col("c_mktsegment")).alias("labels"), F.create_map(F.lit("name"), "c_name").alias("properties"))
    place = F.struct(to.alias("id"), F.array(F.lit("Nation")).alias("labels"), none.alias("properties"))
    rel = F.struct(F.concat(F.lit("r"), "c_custkey").alias("id"), F.lit("IN").alias("type"), ref.alias("startNode"), to.alias("endNode"), F.create_map(F.lit("confidence"), (F.col("c_custkey") % 10 / 10).cast("string")).alias("properties"))
    lost = F.struct(F.concat(F.lit("x"), "c_custkey").alias("id"), F.lit("IN").alias("type"), ref.alias("startNode"), F.lit("gone").alias("endNode"), none.alias("properties"))
    row = F.struct(F.struct(F.array(node, place).alias("nodes"), F.array(rel, lost).alias("relationships")).alias("graph"))
    per = c.groupBy("c_nationkey").agg(F.collect_list(row).alias("data"))
    return per.select(F.to_json(F.struct(F.array(F.struct("data")).alias("results"))).alias("answer"))


@query("select 'c' || c_custkey as id, 'Customer,' || c_mktsegment as types, c_name as name from customer union all select distinct 'n' || c_nationkey, 'Nation', null from customer")
def transaction_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = readers.transaction(_transactions(spark, d), "answer")
    return g.nodes.select("id", F.array_join("types", ",").alias("types"), F.col("props")["name"].alias("name"))


@query("select 'r' || c_custkey as id, 'c' || c_custkey as src, 'n' || c_nationkey as dst, c_custkey % 10 / 10.0 as confidence from customer")
def transaction_edges(spark: SparkSession, d: str) -> DataFrame:
    return readers.transaction(_transactions(spark, d), "answer").edges.select("id", "src", "dst", "confidence")


# encoding specs

_SPEC = """{"version": 1, "node": {"color": {"driver": "types", "scale": {"kind": "categorical", "palette": ["red", "green", "blue"], "overrides": {"Nation": "black"}, "unmapped": "grey"}},
"size": {"driver": "balance", "scale": {"kind": "sequential", "domain": [0, 10000], "range": [4, 32]}}, "shape": {"driver": "segment", "scale": {"kind": "fixed", "value": "star"}}, "label": {"driver": "name"}},
"edge": {"color": {"driver": "quantity", "scale": {"kind": "sequential", "domain": "auto"}}, "width": {"driver": "quantity", "scale": {"kind": "sequential", "domain": [0, 100], "range": [1, 5]}}, "label": {"driver": "type"}}}"""
_PALETTES = {"viridis-9": ["a", "b", "c"], "diverging-9": ["x", "y", "z"]}


def _patched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    spec = encoding_spec.with_icons(encoding_spec.parse(_SPEC), "status", {"F": "flag", "O": "open"})
    return encoding_spec.apply(encoding_spec.parse(encoding_spec.serialize(spec)), Graph(star_nodes(spark, d), star_edges(spark, d)), _PALETTES)


@query(_N + "select id, case type when 'Region' then 'red' when 'Nation' then 'black' when 'Customer' then 'blue' else 'grey' end as color, case when balance is not null then round(4 + 28 * greatest(0, least(1, balance / 10000)))::bigint end as size, case status when 'F' then 'flag' when 'O' then 'open' end as icon, 'star' as shape, coalesce(name, '') as label from n")
def spec_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _patched(spark, d)[0]


@query(
    _NE[:-1] + ", q as (select 'contains/' || l_orderkey || '-' || l_linenumber as id, l_quantity as q from lineitem), m as (select min(q) as lo, max(q) as hi from q) "
    "select id, ['a', 'b', 'c'][(floor((q - lo) / (hi - lo) * 2 + 0.5) + 1)::int] as color, round(1 + 4 * (q / 100), 1) as width, 'contains' as label from q, m union all select id, null, null, type from e where type != 'contains'"
)
def spec_edges(spark: SparkSession, d: str) -> DataFrame:
    return _patched(spark, d)[1]


# literals, colours, fields

_XSD = "http://www.w3.org/2001/XMLSchema#"


@query("select event_id as id, case event_id % 3 when 0 then user_id::double when 1 then value end as number from events")
def literal_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.col("value").cast("string")).otherwise(F.col("user_id").cast("string"))
    kind = F.when(k == 0, f"{_XSD}integer").when(k == 2, f"{_XSD}string")
    return _read(spark, d, "events").select(F.col("event_id").alias("id"), values.literal_number(text, kind).alias("number"))


@query("select event_id as id, case when event_id % 2 = 0 then epoch_us(ts) // 1000 end as ms from events")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).otherwise(F.lit("2024-02-30 or so"))
    return _read(spark, d, "events").select(F.col("event_id").alias("id"), F.unix_millis(values.to_time(text)).alias("ms"))


_LIGHT = "case when {0} / 255.0 <= 0.04045 then {0} / 255.0 / 12.92 else pow(({0} / 255.0 + 0.055) / 1.055, 2.4) end"


@query(
    "with c as (select p_partkey as k, (p_partkey * 7) % 256 as r, (p_partkey * 13) % 256 as g, (p_partkey * 29) % 256 as b from part), "
    f"l as (select k, 0.2126 * {_LIGHT.format('r')} + 0.7152 * {_LIGHT.format('g')} + 0.0722 * {_LIGHT.format('b')} as l from c) select 'part:' || k as id, round((greatest(l, 0) + 0.05) / 0.05, 6) as on_black, round(1.05 / (l + 0.05), 6) as on_white from l"
)
def colour_contrasts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    color = F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex((k * f % 256).cast("long"))), 2, "0") for f in (7, 13, 29)))
    return _read(spark, d, "part").select(F.concat(F.lit("part:"), k).alias("id"), F.round(values.contrast(color, F.lit("#000000")), 6).alias("on_black"), F.round(values.contrast(F.lit("#ffffff"), color), 6).alias("on_white"))


@query(
    "with c as (select p_partkey as k, (p_partkey * 7) % 256 as r, (p_partkey * 13) % 256 as g, (p_partkey * 29) % 256 as b from part), "
    f"l as (select k, 0.05 + 0.2126 * {_LIGHT.format('r')} + 0.7152 * {_LIGHT.format('g')} + 0.0722 * {_LIGHT.format('b')} as l from c) select 'part:' || k as id, case when k % 5 != 0 and l / 0.0617 > 1.05 / l then '#1a1a1a' else '#ffffff' end as stroke from l"
)
def glyph_strokes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    color = F.concat(F.lit("#"), *(F.lpad(F.upper(F.hex((k * f % 256).cast("long"))), 2, "0") for f in (7, 13, 29)))
    fill = F.when(k % 5 == 0, F.concat(color, F.lit("ff"))).otherwise(color)
    return _read(spark, d, "part").select(F.concat(F.lit("part:"), k).alias("id"), values.glyph_stroke(fill).alias("stroke"))


@query("select event_id as id, case when event_id % 2 = 0 then user_id::double else 0 end as number, event_id % 3 != 0 as box, event_type as text from events")
def edited_values(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.col("user_id").cast("string"))).otherwise(F.col("event_type"))
    box = F.when(F.col("event_id") % 3 == 0, "").otherwise("on")
    return _read(spark, d, "events").select(F.col("event_id").alias("id"), views.coerced("number", raw).alias("number"), views.coerced("checkbox", box).alias("box"), views.coerced("text", F.col("event_type")).alias("text"))


# summaries that are registered, classes in use


_ALL = "select 'count-by-type' as summary, type as label, count(*) as n from n group by type union all select 'edge-types', type, count(*) from e group by type union all select 'segments', coalesce(segment, 'Unknown'), count(*) from n group by 2"


@query(_NE + _ALL)
def registered_summaries(spark: SparkSession, d: str) -> DataFrame:
    known = summaries.standard()
    known.register(summaries.of_key("segments", "Nodes by segment", lambda g: g.nodes, lambda: F.col("segment")))
    return known.run(Graph(star_nodes(spark, d), star_edges(spark, d)))


@query(_N + "select id from n where type in ('Region', 'Supplier')")
def selected_types(spark: SparkSession, d: str) -> DataFrame:
    return summaries.standard().get("count-by-type").selected(Graph(star_nodes(spark, d), star_edges(spark, d)), ["Region", "Supplier", "None"])


@query(_N + "select type as cls, count(*) as instances from n group by type")
def classes_in_use(spark: SparkSession, d: str) -> DataFrame:
    return rdf.observed_classes(_triples(spark, d))


# lookups


@query(f"with {_CHECKS} select id, path, severity from f where shape = 'customer' and id in (select 'customer:' || c_custkey from customer where c_acctbal < 0)")
def results_of_nodes(spark: SparkSession, d: str) -> DataFrame:
    found = shapes.of_nodes(shapes.of_shape(shapes.findings(_validated(spark, d)), "customer"), star_nodes(spark, d, ("Customer",)).filter("balance < 0"))
    return found.select("id", "path", "severity")


@query("select 'nation:' || n_nationkey as id, n_nationkey::varchar as label from nation where ('nation:' || n_nationkey) like '%nation:1%' order by n_nationkey::varchar, id limit 25")
def ontology_search(spark: SparkSession, d: str) -> DataFrame:
    return ontology.search(_ontology(spark, d), "NATION:1")


@query("select unnest(['balance', 'type']) as key")
def colour_keys(spark: SparkSession, d: str) -> DataFrame:
    n = star_nodes(spark, d).select("id", F.map_filter(F.create_map(F.lit("name"), "name", F.lit("balance"), F.col("balance").cast("string"), F.lit("type"), F.get("types", 0), F.lit("http://x"), "id"), lambda k, v: v.isNotNull()).alias("props"))
    return ontology.color_keys(n)


@query("with t as (select distinct user_id, a, z from (select user_id, event_type as z, lag(event_type) over (partition by user_id order by ts, event_id) as a from events) where a is not null) select 'kind:' || a as kind, 'user:' || user_id as who from t where a = z")
def repeated_variable(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = _read(spark, d, "events").select("user_id", before.alias("a"), F.col("event_type").alias("z")).filter("a is not null").distinct()
    t = steps.select(F.concat(F.lit("kind:"), "a").alias("s"), F.concat(F.lit("user:"), "user_id").alias("p"), F.concat(F.lit("kind:"), "z").alias("o"), F.lit("uri").alias("otype"))
    return rdf.answers(rdf.match(t, [("?kind", "?who", "?kind")]), {"kind": "kind", "who": "who"})


@query(_N + "select id from n where type = 'Order' order by ord, id limit 1500")
def members_of_a_cluster(spark: SparkSession, d: str) -> DataFrame:
    orders = star_nodes(spark, d, ("Order",)).select("id")
    return groups.subgraph(Graph(star_nodes(spark, d), star_edges(spark, d)), orders)[0].nodes.select("id")


@query("with w as (select unnest(generate_series(date_trunc('hour', ts) - interval 30 minute, date_trunc('hour', ts) + interval 30 minute, interval 30 minute)) as start, ts, event_type, value from events) select start, event_type, count(*) as n, round(sum(value), 4) as total from w where ts >= start and ts < start + interval 1 hour group by all")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    w = changes.windowed(_read(spark, d, "events"), F.col("ts"), ["event_type"], "value", "1 hour", "30 minutes")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(_N + "select id, count(*) as n from (select id, type as t from n where type in ('Customer', 'Supplier') union all select id, 'Party' from n where type in ('Customer', 'Supplier') union all select id, 'Thing' from n where type in ('Customer', 'Supplier') union all select id, 'Named' from n where type in ('Customer', 'Supplier') and name is not null) group by id")
def instances_of_classes(spark: SparkSession, d: str) -> DataFrame:
    flagged = ontology.with_inferred(_ontology(spark, d), _inferred(spark, d))
    own = star_nodes(spark, d, ("Customer", "Supplier")).select("id")
    return ontology.types_of(flagged).join(own, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
