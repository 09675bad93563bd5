"""Further registered queries: provenance, supply, ontology, edges, groups, encodings and reports, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import edges, encodings, groups, ontology, overlays, provenance, rdf, supply, traversal, updates, views
from graphloom.plans.catalog import _CHECKS, _E, _MONTHLY, _N, _NE, _SUPPLIES, _even, _flat, _ids, _inferred, _monthly, _ontology, _read, _supplies, _triples, _validated, query
from graphloom.operators import shapes
from graphloom.plans.graph import Graph, star_edges, star_nodes

# provenance: customers are agents, orders activities, order lines entities; returned lines name no supplier


def _prov(spark: SparkSession, d: str) -> Graph:
    c, o, line = (_read(spark, d, t) for t in ("customer", "orders", "lineitem"))
    none = F.lit(None).cast("string")
    agents = c.select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    suppliers = _read(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    acts = o.select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), none.alias("name"), F.concat(F.lit("customer:"), "o_custkey").alias("agent"), F.col("o_orderdate").alias("started"), F.lit(None).cast("timestamp_ntz").alias("ended"))
    n = F.concat(F.lit("line:"), "l_orderkey", F.lit("-"), "l_linenumber")
    back = F.col("l_returnflag") == "R"
    ents = line.select(n.alias("id"), none.alias("name"), F.when(~back, F.concat(F.lit("supplier:"), "l_suppkey")).alias("attributed_to"), F.when(~back, F.concat(F.lit("order:"), "l_orderkey")).alias("generated_by"), F.col("l_shipdate").alias("generated"))
    return provenance.build(agents.unionAll(suppliers), acts, ents)


@query("select 'line:' || l_orderkey || '-' || l_linenumber as id, l_returnflag != 'R' as attributed from lineitem")
def prov_attributed(spark: SparkSession, d: str) -> DataFrame:
    return _prov(spark, d).nodes.filter(F.array_contains("types", "Entity")).select("id", "attributed")


@query(
    "with l as (select distinct 'line:' || l_orderkey || '-' || l_linenumber as root, 'order:' || l_orderkey as o, 'supplier:' || l_suppkey as s, l_returnflag, l_orderkey from lineitem), ok as (select * from l where l_returnflag != 'R'), "
    "w as (select distinct root, root as id, 0 as depth, null as parent, null as via, false as absence, []::varchar[] as ways from l union select root, s, 1, root, 'wasAttributedTo', false, ['wasAttributedTo/' || root || '/' || s] from ok "
    "union select root, o, 1, root, 'wasGeneratedBy', false, ['wasGeneratedBy/' || root || '/' || o] from ok union select root, 'customer:' || o_custkey, 2, o, 'wasAssociatedWith', false, ['wasGeneratedBy/' || root || '/' || o, 'wasAssociatedWith/' || o || '/customer:' || o_custkey] from ok join orders on o_orderkey = l_orderkey "
    "union select root, root || '::absence', 1, root, null, true, [''] from l where root not in (select root from ok)) select root, id, depth, parent, via, absence, row_number() over (partition by root order by ways) - 1 as place from w"
)
def prov_chains(spark: SparkSession, d: str) -> DataFrame:
    g = _prov(spark, d)
    return provenance.chains(g, g.nodes.filter(F.array_contains("types", "Entity")))


_TIMES = "t as (select l_shipdate as time, 'generated' as kind, 'line:' || l_orderkey || '-' || l_linenumber as id from lineitem union all select o_orderdate, 'started', 'order:' || o_orderkey from orders)"


@query(f"with {_TIMES} select date_trunc('month', time) as month, kind, count(*) as n from t group by all")
def prov_events(spark: SparkSession, d: str) -> DataFrame:
    e = provenance.events(_prov(spark, d).nodes)
    return e.groupBy(F.date_trunc("month", "time").cast("timestamp_ntz").alias("month"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_TIMES} select epoch_ms(min(time)) as least, epoch_ms(max(time)) as most from t")
def prov_time_bounds(spark: SparkSession, d: str) -> DataFrame:
    return provenance.time_bounds(provenance.events(_prov(spark, d).nodes))


@query(f"with {_TIMES} select id, kind from t where time between timestamp '1995-01-01' and timestamp '1996-12-31'")
def prov_events_in_range(spark: SparkSession, d: str) -> DataFrame:
    found = provenance.events(_prov(spark, d).nodes)
    return provenance.in_range(found, F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz")).select("id", "kind")


@query(
    f"with {_TIMES}, h as (select id, bool_or(time between timestamp '1995-01-01' and timestamp '1996-12-31') as seen from t group by id), "
    "r as (select 'customer:' || o_custkey as id, 'order:' || o_orderkey as by from orders union all select 'supplier:' || l_suppkey, 'line:' || l_orderkey || '-' || l_linenumber from lineitem where l_returnflag != 'R') "
    "select id from h where not seen union all select r.id from r join h on r.by = h.id group by r.id having not bool_or(seen)"
)
def prov_hidden(spark: SparkSession, d: str) -> DataFrame:
    return provenance.hidden(_prov(spark, d), F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))


@query("select event_id as id, ts::varchar as start, event_type as kind from events")
def prov_properties(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").select("event_id", F.create_map(F.lit("kind"), "event_type", F.lit("prov:startedAtTime"), F.col("ts").cast("string")).alias("props"))
    p = provenance.copied_properties(F.col("props"))
    return e.select(F.col("event_id").alias("id"), p["temporal_start"].alias("start"), p["kind"].alias("kind"))


# supply


@query(f"with {_SUPPLIES}, k as (select p, count(*) as n from s group by p), c as (select l_partkey as p, list_sort(list_distinct(list(l_linestatus))) as held from lineitem group by 1) select 'part:' || p_partkey as id, coalesce(n, 0) as supplier_count, array_to_string(held, ',') as held, case when held is null then 'n/a' when list_contains(held, 'F') then 'covered' else 'missing' end as status from part left join k on p = p_partkey left join c on c.p = p_partkey")
def digital_thread(spark: SparkSession, d: str) -> DataFrame:
    # line states stand for certificates
    held = _read(spark, d, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("id"), F.col("l_linestatus").alias("certificate"))
    return supply.thread(star_nodes(spark, d, ("Part",)), _supplies(spark, d), held, "F").withColumn("held", F.array_join("held", ","))


@query("select 'customer:' || c_custkey as id, c_mktsegment as label from customer where c_mktsegment is not null and c_mktsegment != ''")
def cluster_by_region(spark: SparkSession, d: str) -> DataFrame:
    return overlays.cluster_labels(star_nodes(spark, d, ("Customer",)), "region", region="segment")


@query("select 'Tier ' || p_size as label, count(*) as members from part where p_size is not null group by p_size")
def cluster_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return overlays.cluster_sizes(overlays.cluster_labels(star_nodes(spark, d, ("Part",)), "tier", tier="size"))


@query("select 'Component ' || row_number() over (order by k desc, low) as label, k as members from (select count(*) + 1 as k, min('nation:' || n_nationkey) as low from nation group by n_regionkey)")
def cluster_by_component(spark: SparkSession, d: str) -> DataFrame:
    c = traversal.numbered_components(star_nodes(spark, d, ("Region", "Nation")), star_edges(spark, d, ("partOf",)))
    return overlays.cluster_sizes(overlays.component_labels(c))


@query("select p_brand as source, count(*) as n from part where p_brand is not null group by p_brand")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlays.source_counts(star_nodes(spark, d, ("Part",)), "brand")


_FOUND = f"with {_MONTHLY}, o as (select p, min(k) as k, min(s) as s from s group by p having count(*) = 1), g as (select p as id, case when k % 2 = 0 then 'violation' else 'warning' end as severity from o union all select 'supplier:' || s, 'warning' from o)"


@query(_FOUND + " select 'gap-' || case when bool_or(severity = 'violation') then 'violation' else 'warning' end as overlay, 'node' as element, id from g group by id")
def gap_overlays(spark: SparkSession, d: str) -> DataFrame:
    return overlays.by_worst(supply.gaps(_monthly(spark, d), _even()).select("id", "severity"))


@query(
    "with c as (select 'customer:' || c_custkey as c, 'nation:' || n_nationkey as n, 'region:' || n_regionkey as r from customer join nation on c_nationkey = n_nationkey) "
    "select distinct 'path' as overlay, 'node' as element, unnest([c, n, r]) as id from c union all select distinct 'path', 'edge', unnest(['locatedIn/' || c || '/' || n, 'partOf/' || n || '/' || r]) from c"
)
def trace_overlay(spark: SparkSession, d: str) -> DataFrame:
    e = star_edges(spark, d, ("partOf", "locatedIn"))
    return overlays.of_paths(traversal.simple_paths(e, star_nodes(spark, d, ("Customer",)), 3, ends=star_nodes(spark, d, ("Region",))), e)


# reports


@query(f"with {_CHECKS} select distinct 'shacl-' || severity as overlay, 'node' as element, id from f")
def severity_overlays(spark: SparkSession, d: str) -> DataFrame:
    return overlays.by_severity(shapes.findings(_validated(spark, d)))


@query(f"with {_CHECKS} select distinct id from f where severity = 'violation'")
def active_overlay(spark: SparkSession, d: str) -> DataFrame:
    return overlays.active_members(overlays.by_severity(shapes.findings(_validated(spark, d))), ["shacl-violation"])


@query(f"with {_CHECKS} select shape || '::prop::' || path as row, case when bool_or(severity = 'violation') then 'violation' else 'warning' end as severity from f group by shape, path")
def row_severities(spark: SparkSession, d: str) -> DataFrame:
    return overlays.row_severities(shapes.findings(_validated(spark, d)))


@query(f"with {_CHECKS} select id, shape || '::prop::' || path as row, shape, path || ': ' || message || ' (' || severity || ')' as detail from f")
def result_targets(spark: SparkSession, d: str) -> DataFrame:
    return overlays.result_targets(shapes.findings(_validated(spark, d)))


_BOTH = "b as (select src as id, dst as other from e union select dst, src from e)"


@query(_NE[:-1] + f", {_BOTH}, k as (select b.id, n.type, count(*) as k from b join n on n.id = b.other where b.id != b.other group by all), s as (select id, sum(k)::bigint as neighbours, string_agg(k || ' ' || type, ', ' order by type) as breakdown from k group by id) select n.id, coalesce(neighbours, 0) as neighbours, coalesce(breakdown, '') as breakdown from n left join s using (id)")
def node_summaries(spark: SparkSession, d: str) -> DataFrame:
    return overlays.node_summaries(star_nodes(spark, d), star_edges(spark, d))


# ontology


@query(_N + "select 'Individual' as kind, count(*) + 2 as n from n union all select 'Individual', 0 where false")
def ontology_stats(spark: SparkSession, d: str) -> DataFrame:
    # two properties have only types that aren't kinds of entities
    return ontology.stats(_ontology(spark, d)).groupBy("kind").agg(F.sum("n").alias("n"))


@query("select * from (values ('Party', 'Customer'), ('Party', 'Supplier'), ('Thing', 'Party'), ('Thing', 'Product')) t(cls, child) union all select distinct 'Product', p_brand from part")
def ontology_children(spark: SparkSession, d: str) -> DataFrame:
    return ontology.children(_ontology(spark, d))


@query("select 'customer:' || c_custkey as id, t as type, t != 'Customer' as inferred from customer, (values ('Customer'), ('Party'), ('Thing'), ('Named')) v(t)")
def ontology_types(spark: SparkSession, d: str) -> DataFrame:
    flagged = ontology.with_inferred(_ontology(spark, d), _inferred(spark, d))
    return ontology.types_of(flagged).filter(F.col("id").startswith("customer:"))


@query("select * from (values ('Customer', 'SubClassOf Party'), ('Supplier', 'SubClassOf Party'), ('Party', 'SubClassOf Thing'), ('locatedIn', 'SubPropertyOf partOf'), ('locatedIn', 'Range Place'), ('holds', 'InverseOf locatedIn'), ('name', 'Domain Named'), ('partOf', 'TransitiveProperty'), ('near', 'SymmetricProperty'), ('Product', 'SubClassOf Thing')) t(id, axiom) union all select distinct p_brand, 'SubClassOf Product' from part")
def ontology_axioms(spark: SparkSession, d: str) -> DataFrame:
    return ontology.axioms(_ontology(spark, d))


@query("select * from (values ('Customer', 'Party', true), ('Supplier', 'Party', true), ('Party', 'Thing', true), ('Customer', 'Thing', false), ('Supplier', 'Thing', false), ('Product', 'Thing', true)) t(src, dst, asserted) union all select distinct p_brand, unnest(['Product', 'Thing']), unnest([true, false]) from part")
def class_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return ontology.class_hierarchy(ontology.with_inferred(_ontology(spark, d), _inferred(spark, d))).edges.select("src", "dst", "asserted")


@query(_NE + "select 'Resource' as kind, count(*) as n from n union all select 'Literal', (select count(name) + count(balance) from n)")
def raw_triple_nodes(spark: SparkSession, d: str) -> DataFrame:
    return ontology.raw_graph(_triples(spark, d).filter(F.col("p") != rdf.TYPE)).nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_N + "select id, 'type' as key, type as value from n union all select id, 'name', name from n where name is not null")
def node_properties(spark: SparkSession, d: str) -> DataFrame:
    return ontology.node_properties(_triples(spark, d), star_nodes(spark, d)).filter("key in ('type', 'name')")


@query(_NE + "select type as type from n group by type")
def distinct_types(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).filter(F.col("p") == rdf.TYPE).select(F.col("o").alias("type")).distinct()


# edges


@query(_E + "select 'nation:' || n_nationkey as node, count(*) as n from nation join e on src = 'nation:' || n_nationkey or dst = 'nation:' || n_nationkey group by 1")
def node_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.incident(star_edges(spark, d), star_nodes(spark, d, ("Nation",))).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query(_E + "select id, type from e where src = 'order:1' and dst in (select dst from e where src = 'order:1' order by dst limit 1)")
def edges_between(spark: SparkSession, d: str) -> DataFrame:
    e = star_edges(spark, d)
    first = e.filter("src = 'order:1'").agg(F.min("dst")).first()[0]
    return edges.between(e, "order:1", first or "").select("id", "type")


def _two(spark: SparkSession, d: str) -> tuple[Graph, Graph]:
    n, e = star_nodes(spark, d).select("id", "types", "ord", "name", "balance"), star_edges(spark, d)
    after = Graph(n.filter("id != 'nation:1'").withColumn("balance", F.when(F.col("balance") < 0, 0.0).otherwise(F.col("balance"))), e.filter("src != 'nation:1' and dst != 'nation:1'").withColumn("quantity", F.when(F.col("quantity") == 7, 8.0).otherwise(F.col("quantity"))))
    new = spark.createDataFrame([("nation:new", ["Nation"], 0, "New", None)], n.schema)
    after = edges.add_nodes(after, new)
    return Graph(n, e), edges.add_edges(after, spark.createDataFrame([("nation:new", "region:1", "partOf"), ("nation:new", "region:none", "partOf")], "src string, dst string, type string"))


@query(
    _NE + "select 'node' as kind, 'added' as status, 1 as n union all select 'node', 'removed', 1 union all select 'node', 'changed', (select count(*) from n where balance < 0) union all select 'edge', 'added', 1 "
    "union all select 'edge', 'removed', (select count(*) from e where src = 'nation:1' or dst = 'nation:1') union all select 'edge', 'changed', (select count(*) from (select max(l_quantity) as q from lineitem group by l_orderkey, l_linenumber) where q = 7)"
)
def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    before, after = _two(spark, d)
    return edges.diff_counts(edges.graph_diff(before, after, ["name", "balance"], ["quantity"]))


@query("select 'contains/' || l_orderkey || '-' || l_linenumber as id, max(l_extendedprice) over (partition by l_orderkey, l_linenumber) as price from lineitem union all select 'placedBy/order:' || o_orderkey || '/customer:' || o_custkey, null from orders")
def edge_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "lineitem").select(F.concat(F.lit("contains/"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), F.col("l_extendedprice").alias("price"))
    return updates.update_join(star_edges(spark, d, ("contains", "placedBy")), rows, "id").select("id", "price")


# groups


@query(_N + "select 'all ' || type as \"group\", count(*) as members, type || ' (' || count(*) || ')' as types, type || ' cluster (' || count(*) || ')' as label from n group by type")
def type_breakdown(spark: SparkSession, d: str) -> DataFrame:
    n = star_nodes(spark, d)
    return groups.breakdown(n, _flat(n).select(F.concat(F.lit("all "), "type").alias("group"), "id"))


@query("select 'customers' as id, 'Customer (' || count(*) || ')' as summary from customer union all select 'nation:' || n_nationkey, null from nation union all select 'region:' || r_regionkey, null from region")
def collapsed_groups(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(star_nodes(spark, d, ("Region", "Nation", "Customer")), star_edges(spark, d, ("partOf", "locatedIn")))
    own = groups.created(spark.createDataFrame([], "group string, id string"), "customers", star_nodes(spark, d, ("Customer",)))
    return groups.collapsed_groups(g, own).nodes.select("id", "summary")


@query("select 'region:' || n_regionkey as \"group\", 'nation:' || n_nationkey as id from nation union all select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer union all select 'region:' || n_regionkey, 'customer:' || c_custkey from customer join nation on c_nationkey = n_nationkey")
def nested_groups(spark: SparkSession, d: str) -> DataFrame:
    e = star_edges(spark, d, ("partOf", "locatedIn")).filter(~F.col("src").startswith("supplier:"))
    return groups.nested(e.select(F.col("dst").alias("group"), F.col("src").alias("id")))


@query("select 'nation:' || n_nationkey as id, 'region:' || n_regionkey as parent from nation union all select 'region:' || r_regionkey, null from region")
def grouped_parents(spark: SparkSession, d: str) -> DataFrame:
    own = star_edges(spark, d, ("partOf",)).select(F.col("dst").alias("group"), F.col("src").alias("id"))
    return groups.with_parents(star_nodes(spark, d, ("Region", "Nation")), own).select("id", "parent")


@query("select c_mktsegment as tag, count(*) as n from customer where c_acctbal >= 0 group by 1")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    c = star_nodes(spark, d, ("Customer",))
    tagged = updates.tags_added(c, c.select("id", F.col("segment").alias("tag")).filter("tag is not null"))
    return groups.tag_counts(groups.tags_removed(tagged, c.filter("balance < 0").select("id", F.col("segment").alias("tag"))))


@query("select 'nation:' || n_nationkey as id, case when rk <= 3 then rk end as nth from (select n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey desc) as rk from nation) where rk <= 3")
def ranked_members(spark: SparkSession, d: str) -> DataFrame:
    own = star_nodes(spark, d, ("Nation",)).join(star_edges(spark, d, ("partOf",)).select(F.col("src").alias("id"), "dst"), "id")
    return groups.ranked_members(own, "dst", "ord", 3).select("id", F.col("nth").cast("long").alias("nth"))


# encodings


@query("with t as (select type, row_number() over (order by type) - 1 as k from (values ('Region'), ('Nation'), ('Customer'), ('Supplier'), ('Part'), ('Order')) v(type)) select type, ['red', 'green', 'blue', 'gold'][(k % 4 + 1)::int] as color, ['ellipse', 'rectangle', 'diamond', 'hexagon', 'triangle', 'star'][(k + 1)::int] as shape from t")
def type_map(spark: SparkSession, d: str) -> DataFrame:
    return encodings.type_map(star_nodes(spark, d), ("red", "green", "blue", "gold"))


@query(
    "with v as (select p_brand as value, min(p_partkey) as o from part where p_brand is not null group by 1), s as (select value, row_number() over (order by o, value) - 1 as k from v), m as (select min(p_size) as lo, max(p_size) as hi from part) "
    "select 'part:' || p_partkey as id, ['red', 'green', 'blue'][(k % 3 + 1)::int] as color, 'ellipse' as shape, round(4 + 28 * (p_size - lo)::double / (hi - lo)) as size, p_name as label from part left join s on value = p_brand, m"
)
def encoding_patch(spark: SparkSession, d: str) -> DataFrame:
    return encodings.apply_spec(star_nodes(spark, d, ("Part",)), color="brand", palette=("red", "green", "blue"), size=encodings.Size("size"))


@query("select 'nation:' || n_nationkey as id, case when n_nationkey = 1 then 'own' else 'typed' end as style from nation union all select 'region:' || r_regionkey, null from region")
def style_overrides(spark: SparkSession, d: str) -> DataFrame:
    own = _ids(spark, "nation:1").withColumn("style", F.lit("own"))
    return encodings.with_overrides(star_nodes(spark, d, ("Region", "Nation")), {"Nation": "typed"}, own).select("id", "style")


@query("select 'part:' || p_partkey as id, round(p_retailprice / nullif(p_size, 0) * 100, 6) as rate, round(sqrt(p_retailprice / nullif(p_size, 0) * 100) + 1, 6) as root from part")
def derived_engine(spark: SparkSession, d: str) -> DataFrame:
    p = encodings.derived(star_nodes(spark, d, ("Part",)), {"rate": "price / size * 100", "bad": "price +* 2", "worse": "unknown + 1", "root": "sqrt(rate) + 2^0"})
    return p.select("id", F.round("rate", 6).alias("rate"), F.round("root", 6).alias("root"))


@query("select p_brand as label, count(*) as value from part group by p_brand having count(*) is not null")
def chart_data(spark: SparkSession, d: str) -> DataFrame:
    rows = star_nodes(spark, d, ("Part",)).groupBy("brand").agg(F.count(F.lit(1)).cast("string").alias("v"))
    return views.chart_rows(rows, "brand", "v").withColumn("value", F.col("value").cast("long"))
