"""Registered queries: communities, neighbourhoods, geographic, temporal, tabular and schema views, notes, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import values
from graphloom.operators import communities, filters, groups, overlays, shapes, updates, views
from graphloom.plans.catalog import _CHECKS, _E, _N, _NE, _flat, _ids, _read, _triples, _validated, query
from graphloom.plans.graph import Graph, star_edges, star_nodes
from graphloom.sources import readers

# communities and the way from a large graph to one of its clusters


@query("select 'g' || g as \"group\", 200::bigint as members from (select unnest(range(40 + (select count(*) from supplier))) as g)")
def scale_graph(spark: SparkSession, d: str) -> DataFrame:
    # the standard graph of 40 groups of 200, and as large a group for each supplier
    g = communities.planted(spark, groups=40 + _read(spark, d, "supplier").count())
    return g.nodes.groupBy("group").agg(F.count(F.lit(1)).alias("members"))


@query("select segment as cluster, count(*) as members from (select coalesce(c_mktsegment, 'unclustered') as segment from customer) group by 1 having (select count(*) from customer) > 100")
def scale_path(spark: SparkSession, d: str) -> DataFrame:
    g, collapsed = groups.collapse_above(Graph(star_nodes(spark, d, ("Customer",)), star_edges(spark, d, ("locatedIn",))), "segment", threshold=100)
    return g.nodes.filter(F.lit(collapsed)).select("cluster", "members")


@query(
    "with l as (select 'customer:' || c_custkey as id, c_nationkey as k from customer union all select 'supplier:' || s_suppkey, s_nationkey from supplier union all select 'nation:' || n_nationkey, n_nationkey from nation), "
    "m as (select k, min(id) as community from l group by k) select id, community from l join m using (k) union all select 'region:' || r_regionkey, 'region:' || r_regionkey from region"
)
def communities_of_stars(spark: SparkSession, d: str) -> DataFrame:
    # each nation with all that lies in it hangs together and with nothing else, so these are the communities
    return communities.communities(star_nodes(spark, d, ("Region", "Nation", "Customer", "Supplier")), star_edges(spark, d, ("locatedIn",)))


@query()
def communities_of_all(spark: SparkSession, d: str) -> DataFrame:
    found = communities.communities(star_nodes(spark, d), star_edges(spark, d))
    return communities.numbered(found).groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))


@query()
def scale_path_by_modularity(spark: SparkSession, d: str) -> DataFrame:
    g, collapsed = groups.collapse_above(Graph(star_nodes(spark, d), star_edges(spark, d)), threshold=100)
    return g.edges.filter(F.lit(collapsed))


@query("select 'part:' || p_partkey as id from part where p_size = 7")
def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    labels = overlays.cluster_labels(star_nodes(spark, d, ("Part",)), "tier", tier="size")
    return labels.filter("label = 'Tier 7'").select("id")


# neighbourhoods


_FROM = "z as (select 'nation:3' as id union select src from e where dst = 'nation:3' union select dst from e where src = 'nation:3')"


@query(_E[:-1] + f", {_FROM} select id from z")
def neighborhood_nodes(spark: SparkSession, d: str) -> DataFrame:
    return views.neighborhood(Graph(star_nodes(spark, d), star_edges(spark, d)), _ids(spark, "nation:3", "nation:none"), 1).nodes.select("id")


@query(_E[:-1] + f", {_FROM} select e.id, e.type from e where src in (select id from z) and dst in (select id from z)")
def neighborhood_edges(spark: SparkSession, d: str) -> DataFrame:
    return views.neighborhood(Graph(star_nodes(spark, d), star_edges(spark, d)), _ids(spark, "nation:3"), 1).edges.select("id", "type")


@query(
    _E[:-1] + ", b as (select src as id, dst as other from e union select dst, src from e), h1 as (select distinct other as id from b where id = 'region:1'), "
    "h2 as (select distinct other as id from b where id in (select id from h1)) select id from h2 where id != 'region:1' and id not in (select id from h1)"
)
def hop_ring(spark: SparkSession, d: str) -> DataFrame:
    return views.ring(star_edges(spark, d), _ids(spark, "region:1"), 2)


@query(_N + "select id, type from n where type not in ('Order', 'Part')")
def hidden_types(spark: SparkSession, d: str) -> DataFrame:
    return _flat(filters.without_types(star_nodes(spark, d), ["Order", "Part"])).select("id", "type")


@query(_N + "select id from n where type != 'Nation' or id = 'nation:1'")
def hidden_but_pinned(spark: SparkSession, d: str) -> DataFrame:
    return filters.view_nodes(star_nodes(spark, d), hidden=star_nodes(spark, d, ("Nation",)).select("id"), pinned=_ids(spark, "nation:1")).select("id")


# places and times


def _placed(spark: SparkSession, d: str) -> DataFrame:
    s = star_nodes(spark, d, ("Nation", "Supplier"))
    n = F.pmod(F.col("ord"), F.lit(10**12))
    return s.withColumns({"lat": F.when(n % 7 != 0, n % 180 - 90).cast("double"), "lon": (n % 360 - 180).cast("string")})


_GEO = "g as (select id, name, type, (lon + 180) / 360.0 * 800 as x, (90 - lat) / 180.0 * 400 as y from (select id, name, type, ord % 1000000000000 % 180 - 90 as lat, ord % 1000000000000 % 360 - 180 as lon from n where type in ('Nation', 'Supplier') and ord % 1000000000000 % 7 != 0))"


@query(_N[:-1] + f", {_GEO} select id, coalesce(name, id) as name, type, round(x, 6) as x, round(y, 6) as y from g")
def geo_points(spark: SparkSession, d: str) -> DataFrame:
    return views.geo_points(_placed(spark, d)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query(_NE[:-1] + f", {_GEO} select e.id, e.type, round(a.x, 6) as x1, round(b.x, 6) as x2 from e join g a on a.id = src join g b on b.id = dst")
def geo_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = views.geo_lines(views.geo_points(_placed(spark, d)), star_edges(spark, d, ("partOf", "locatedIn")))
    return lines.select("id", "type", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


@query("select 'order:' || o_orderkey as id from orders where o_orderdate <= timestamp '1995-06-30' and o_orderdate + interval (o_orderkey % 90) day >= timestamp '1995-06-01'")
def timeline_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = star_nodes(spark, d, ("Order",)).withColumn("end", F.col("time") + F.make_interval(days=F.pmod(F.pmod("ord", F.lit(10**12)), F.lit(90)).cast("int")))
    return views.overlapping(views.timeline_items(o), F.to_timestamp(F.lit("1995-06-01")), F.to_timestamp(F.lit("1995-06-30"))).select("id")


# tables, schema, reports


@query("select place, key, widget, held from (select count(p_retailprice) as a, count(p_name) as b, count(p_brand) as c, count(p_type) as d, count(p_size) as e from part), lateral (values (0, 'price', 'number', a), (1, 'name', 'readonly', b), (2, 'brand', 'text', c), (3, 'kind', 'text', d), (4, 'size', 'number', e)) t(place, key, widget, held)")
def inspector_fields(spark: SparkSession, d: str) -> DataFrame:
    p = star_nodes(spark, d, ("Part",))
    shown = views.fields(p, {"price": "number", "name": "readonly", "none": "text"})
    keys = [c for c in p.columns if c not in ("id", "types", "ord")]
    held = p.agg(*(F.count(c).alias(c) for c in keys)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("held")) for c in keys))).alias("x")).select("x.*")
    return shown.join(held, "key").select("place", "key", "widget", "held")


@query("select 'Customer' as name, 'balance,name,segment' as properties, 3::bigint as constraints union all select 'Supplier', 'balance,name', 0 union all select 'Part', 'brand,kind,name,price,size', 0 union all select 'Order', 'price,priority,status,time', 0 union all select 'Nation', 'name', 0 union all select 'Region', 'name', 0")
def schema_view(spark: SparkSession, d: str) -> DataFrame:
    rules = (shapes.Rule("name", min_count=1), shapes.Rule("balance", datatype="number", least=0), shapes.Rule("segment", values=("BUILDING",)))
    return views.schema_view(star_nodes(spark, d), [shapes.Shape("customer", "Customer", rules)])


@query("select t.*, (select count(*) from customer) as nodes from (values ('customer::prop::name', 'customer', 'name [1..*]', true), ('customer::prop::balance', 'customer', 'balance : number [0..*] (+2)', true), ('customer::prop::segment', 'customer', 'segment [0..*] (+1)', true)) t(row, shape, text, closed)")
def shape_rows(spark: SparkSession, d: str) -> DataFrame:
    rules = (shapes.Rule("name", min_count=1), shapes.Rule("balance", datatype="number", least=0, most=9000), shapes.Rule("segment", values=("BUILDING",)))
    rows = views.shape_rows(spark, [shapes.Shape("customer", "Customer", rules, closed=True)])
    targets = star_nodes(spark, d).groupBy(F.lower(F.col("types")[0]).alias("shape")).agg(F.count(F.lit(1)).alias("nodes"))
    return rows.join(targets, "shape")


@query(
    "with c as (select 'customer:' || c_custkey as id, c_name, c_acctbal, c_mktsegment from customer) select id, 'balance' as path, 'maxInclusive' as message from c where c_acctbal > 5000 union all select id, 'segment', 'missing' from c where c_mktsegment is null or c_mktsegment = '' "
    "union all select id, 'segment', 'datatype' from c where c_mktsegment != '' union all select id, 'name', 'closed' from c where c_name is not null"
)
def closed_shapes(spark: SparkSession, d: str) -> DataFrame:
    rules = (shapes.Rule("balance", datatype="number", most=5000), shapes.Rule("segment", min_count=1, datatype="boolean"))
    found = shapes.validate(star_nodes(spark, d, ("Customer",)).select("id", "types", "ord", "name", "balance", "segment"), [shapes.Shape("c", "Customer", rules, closed=True)])
    return shapes.findings(found).select("id", "path", "message")


@query(f"with {_CHECKS} select f.id, p.name, f.path, case when severity = 'violation' then 'violations' else 'warnings' end as part from f join p on p.id = f.id")
def provenance_report(spark: SparkSession, d: str) -> DataFrame:
    found = shapes.findings(_validated(spark, d))
    names = star_nodes(spark, d, ("Customer", "Supplier")).select("id", F.coalesce("name", "id").alias("name"))
    return found.join(names, "id").select("id", "name", "path", F.when(F.col("severity") == "violation", "violations").otherwise("warnings").alias("part"))


@query("select v as view, n <= most as allowed, least(n, most + 1) as requested from (select 'canvas' as v, count(*) as n, 500 as most from customer union all select 'table', count(*), 10000 from lineitem union all select 'matrix', count(*), 200 from nation) t")
def view_limits(spark: SparkSession, d: str) -> DataFrame:
    return views.within_limits({"canvas": star_nodes(spark, d, ("Customer",)), "table": _read(spark, d, "lineitem"), "matrix": star_nodes(spark, d, ("Nation",))})


@query("with k as (select l_partkey as p, avg((l_returnflag = 'N')::int) as a, avg((l_linestatus = 'O')::int) as b from lineitem group by 1) select 'part:' || p as id, round(a, 6) as shown, round(greatest(a, b), 6) as claim, round(greatest(a, b) - a, 3) as gap from k")
def coverage_meter(spark: SparkSession, d: str) -> DataFrame:
    k = _read(spark, d, "lineitem").groupBy(F.concat(F.lit("part:"), "l_partkey").alias("id")).agg(F.avg((F.col("l_returnflag") == "N").cast("int")).alias("a"), F.avg((F.col("l_linestatus") == "O").cast("int")).alias("b"))
    shown, claim, gap = views.coverage(F.col("a"), F.col("b"))
    return k.select("id", F.round(shown, 6).alias("shown"), F.round(claim, 6).alias("claim"), gap.alias("gap"))


@query("select 'part:' || p_partkey as id, ceil(length(p_name) * 7)::bigint + 4 as width from part")
def label_sizes(spark: SparkSession, d: str) -> DataFrame:
    return star_nodes(spark, d, ("Part",)).select("id", views.label_size(F.col("name")).alias("width"))


@query("select page_id, page_id % 4 != 3 as image from pages")
def image_references(spark: SparkSession, d: str) -> DataFrame:
    file = F.concat(F.lit("/pictures/"), F.col("page_id").cast("string"))
    refs = F.array(F.col("url"), F.concat(file, F.lit(".PNG?size=2")), F.concat(F.lit("data:image/png;base64,"), file), F.concat(file, F.lit(".png.txt")))
    return _read(spark, d, "pages").select("page_id", views.is_image(F.element_at(refs, (F.col("page_id") % 4 + 1).cast("int"))).alias("image"))


@query("select 'customer:' || c_custkey as id, case when c_acctbal >= 0 then c_mktsegment end as note from customer")
def element_notes(spark: SparkSession, d: str) -> DataFrame:
    c = star_nodes(spark, d, ("Customer",))
    first = views.notes_set(spark.createDataFrame([], "id string, text string, at long"), c.select("id", F.col("segment").alias("text"), F.lit(1).cast("long").alias("at")))
    later = views.notes_set(first, c.filter("balance < 0").select("id", F.lit("").alias("text"), F.lit(2).cast("long").alias("at")))
    return views.with_notes(c, later).select("id", "note")


@query("select 'part:' || p_partkey as id, unnest(['Part', p_brand]) as type from part")
def several_types(spark: SparkSession, d: str) -> DataFrame:
    p = _read(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.array(F.lit("Part"), F.col("p_brand")).alias("types"))
    return p.select("id", F.explode("types").alias("type"))


@query(_N + "select count(*) + count(name) + count(balance) + (select count(*) from (select n_nationkey from nation union all select c_custkey from customer union all select s_suppkey from supplier union all select o_orderkey from orders union all select p from (select distinct l_orderkey, l_partkey as p from lineitem))) + (select count(*) from (select distinct l_suppkey, l_partkey from lineitem)) as n from n")
def triple_count(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query(_N + "select id, 'x:' || type as short, 'http://example.org/' || type as long from n")
def prefixed_names(spark: SparkSession, d: str) -> DataFrame:
    known = {"x": "http://example.org/"}
    long = values.expanded(F.concat(F.lit("x:"), "type"), known)
    return _flat(star_nodes(spark, d)).select("id", values.shortened(long, known).alias("short"), long.alias("long"))


@query("select event_id as id, event_id::double as number, null::boolean as flag, null::varchar as text from events where event_id % 3 = 0 union all select event_id, null, user_id % 2 = 0, null from events where event_id % 3 = 1 union all select event_id, null, null, event_type from events where event_id % 3 = 2")
def typed_literals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit("px"))).when(k == 1, F.when(F.col("user_id") % 2 == 0, "true").otherwise("1")).otherwise(F.col("event_type"))
    kind = F.when(k == 0, "http://www.w3.org/2001/XMLSchema#integer").when(k == 1, "http://www.w3.org/2001/XMLSchema#boolean")
    return _read(spark, d, "events").select(F.col("event_id").alias("id"), values.cast_literal(text, kind).alias("v")).select("id", "v.*")


# answers of traversal services, made from the tables


@query("select 'v' || n_nationkey as id, 'Nation' as type, n_name as name from nation union all select distinct 'r' || n_regionkey, 'Vertex', null from nation")
def traversal_answer(spark: SparkSession, d: str) -> DataFrame:
    n = _read(spark, d, "nation").withColumns({"v": F.concat(F.lit("v"), "n_nationkey"), "r": F.concat(F.lit("r"), "n_regionkey")})
    vertex = F.to_json(F.struct(F.col("v").alias("id"), F.lit("Nation").alias("label"), F.struct(F.array(F.struct(F.col("n_name").alias("value")), F.struct(F.lit("other").alias("value"))).alias("name")).alias("properties")))
    edge = F.to_json(F.struct(F.lit("partOf").alias("label"), F.col("v").alias("outV"), F.col("r").alias("inV"), F.lit("Nation").alias("outVLabel")))
    # one answer a nation
    g = readers.elements(n.select(F.concat(F.lit('{"result":{"data":['), vertex, F.lit(","), edge, F.lit("]}}")).alias("j")), "j")
    return g.nodes.select("id", F.get("types", 0).alias("type"), F.col("props")["name"].alias("name"))


def _holons(spark: SparkSession, d: str) -> DataFrame:
    """One holon a customer, holding its orders."""
    o = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.sort_array(F.collect_list(F.concat(F.lit("order:"), "o_orderkey"))).alias("orders"))
    c = _read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("c"))
    inner = F.transform("orders", lambda x: F.struct(x.alias("id"), F.array(F.lit("Order")).alias("types")))
    outer = F.transform("orders", lambda x: F.struct(F.element_at("orders", 1).alias("src"), x.alias("dst"), F.lit("before").alias("type")))
    stray = F.array(F.struct(F.element_at("orders", 1).alias("src"), F.lit("order:none").alias("dst"), F.lit("before").alias("type")))
    portals = F.array(F.struct(F.lit("p").alias("id"), F.lit("nowhere").alias("target"), F.col("c_mktsegment").alias("label")))
    return c.select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.array(F.lit("Account")).alias("types"), portals.alias("portals"), inner.alias("nodes"), F.concat(outer, stray).alias("edges"))


@query("select 'customer:' || o_custkey as holon, 'order:' || o_orderkey as dst from orders join customer on o_custkey = c_custkey")
def holon_interiors(spark: SparkSession, d: str) -> DataFrame:
    return readers.holon_interiors(_holons(spark, d)).edges.select("holon", "dst")


@query("select 'nodeType' as kind, 'Account' as name union all select distinct 'edgeType', c_mktsegment from customer where c_custkey in (select o_custkey from orders)")
def holon_schema(spark: SparkSession, d: str) -> DataFrame:
    return readers.holon_schema(_holons(spark, d))


@query("select 'customer:' || c_custkey as id, c_name as name, true as is_holon, 1 as portals from customer where c_custkey in (select o_custkey from orders)")
def holon_nodes(spark: SparkSession, d: str) -> DataFrame:
    return readers.holons(_holons(spark, d)).nodes.select("id", "name", "is_holon", F.col("portal_count").alias("portals"))


# changes


@query("select 'incremental' as kind, count(*) as changed from supplier where s_suppkey % 5 = 0")
def update_kind(spark: SparkSession, d: str) -> DataFrame:
    s = star_nodes(spark, d, ("Supplier",))
    changes = updates.diff(s, s.filter("ord % 5 != 0"), ["name"])
    return changes.agg(F.count(F.lit(1)).alias("changed")).select(F.lit(updates.change_ratio(changes, s.count())).alias("kind"), "changed")


@query("select min(p_size)::double as least, max(p_size)::double as most, count(*) filter (where p_size is null) as missing from part")
def property_range(spark: SparkSession, d: str) -> DataFrame:
    return views.property_range(star_nodes(spark, d, ("Part",)), "size")
