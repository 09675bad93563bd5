"""The registered queries over the derived graph, with their counterparts in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import values
from graphloom.operators import aggregates, encodings, export, filters, rdf, shapes, supply, traversal, updates, views
from graphloom.plans.graph import EDGES_SQL, NODES_SQL, Graph, primary_type, star_edges, star_nodes
from graphloom.plans.session import released, stored
from graphloom.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_N, _E = f"with {NODES_SQL} ", f"with {EDGES_SQL} "
_NE = f"with {NODES_SQL}, {EDGES_SQL} "
_NER = f"with recursive {NODES_SQL}, {EDGES_SQL}, "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _flat(df: DataFrame) -> DataFrame:
    """Nodes with the primary type in place of the array."""
    return df.withColumn("type", primary_type()).drop("types")


# counts and summaries


@query(_N + "select type as label, count(*) as n from n group by type")
def count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.count_by_type(star_nodes(spark, d))


@query(_N + "select coalesce(segment, 'Unknown') as label, count(*) as n from n group by 1")
def count_by_property(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.count_by(star_nodes(spark, d), F.col("segment"))


@query(_N + "select id, type from n")
def reverse_map(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.members(star_nodes(spark, d), primary_type()).select("id", F.col("label").alias("type"))


@query(_E + "select type as label, count(*) as n from e group by type")
def edge_type_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.count_by(star_edges(spark, d), F.col("type"))


_ENDS = "b as (select src as id, dst as other from e union all select dst, src from e)"


@query(_NE[:-1] + f", {_ENDS} select k as degree, count(*) as n from (select n.id, count(distinct other) as k from n left join b on n.id = b.id group by n.id) group by k")
def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.degree_distribution(star_nodes(spark, d), star_edges(spark, d))


@query(_NE[:-1] + f", {_ENDS} select n.id, count(other) as degree from n left join b on n.id = b.id group by n.id")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.degree_centrality(star_nodes(spark, d), star_edges(spark, d))


@query("select p_partkey as id, p_size::double as x, p_retailprice as y from part where p_size is not null and p_retailprice is not null")
def property_correlation(spark: SparkSession, d: str) -> DataFrame:
    p = star_nodes(spark, d, ("Part",)).filter("size is not null and price is not null")
    return p.select(F.substring_index("id", ":", -1).cast("long").alias("id"), F.col("size").cast("double").alias("x"), F.col("price").alias("y"))


@query("select count(*) as n, round(regr_slope(p_retailprice, p_size), 6) as slope, round(regr_intercept(p_retailprice, p_size), 6) as intercept, round(regr_r2(p_retailprice, p_size), 6) as r2 from part")
def property_trend(spark: SparkSession, d: str) -> DataFrame:
    t = aggregates.trend(star_nodes(spark, d, ("Part",)), "size", "price")
    return t.select("n", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")))


@query(
    "with t as (select epoch_ms(ts)::double as v from events), s as (select min(v) as lo, max(v) as hi, least(10, count(*)) as k from t) "
    "select least(floor((v - lo) / (case when hi > lo then hi - lo else 1 end / k)), k - 1)::bigint as bucket, count(*) as n from t, s group by 1"
)
def activity_timeline(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.timeline(_read(spark, d, "events"), F.col("ts")).select("bucket", "n")


@query(
    "with s as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer), c as (select least(floor((c_acctbal - lo) / ((hi - lo) / 20)), 19)::bigint as bucket, count(*) as n from customer, s group by 1) "
    "select r.range as bucket, coalesce(n, 0) as n from range(20) r left join c on r.range = c.bucket"
)
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram(star_nodes(spark, d, ("Customer",)), F.col("balance"))


@query(_NE + "select a.type as src_type, b.type as dst_type, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from e join n a on a.id = src join n b on b.id = dst group by 1, 2")
def type_matrix(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.type_matrix(star_edges(spark, d), star_nodes(spark, d))


@query(_NE + "select a.type as src_type, b.type as dst_type, count(*) as n from e join n a on a.id = src join n b on b.id = dst where a.type != b.type group by 1, 2")
def type_flow(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.type_matrix(star_edges(spark, d), star_nodes(spark, d)).filter("src_type != dst_type").select("src_type", "dst_type", "n")


@query(_N + "select type, count(*) as n from n group by type")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return filters.facet_counts(star_nodes(spark, d))


@query(
    _NE + "select 'nodeType' as kind, type as name from n group by type union all select 'edgeType', type from e group by type "
    "union all select 'nodeProperty', unnest(['name', 'balance', 'segment', 'brand', 'kind', 'size', 'price', 'status', 'time', 'priority']) union all select 'edgeProperty', 'quantity'"
)
def registry(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.registry(star_nodes(spark, d), star_edges(spark, d))


_SUPPLIES = "s as (select distinct l_partkey as p, l_suppkey as s from lineitem)"


def _supplies(spark: SparkSession, d: str) -> DataFrame:
    return star_edges(spark, d, ("supplies",))


_MONTHLY = "s as (select distinct 'part:' || l_partkey || '@' || month(l_shipdate) as p, l_partkey as k, l_suppkey as s from lineitem)"


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    """Who supplies a part in a month of the year: here some have one supplier alone."""
    line = _read(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.month("l_shipdate").alias("m")).distinct()
    return line.select(F.concat(F.lit("supplier:"), "l_suppkey").alias("src"), F.concat(F.lit("part:"), "l_partkey", F.lit("@"), "m").alias("dst"))


@query(f"with {_MONTHLY} select p as part, 'supplier:' || min(s) as supplier from s group by p having count(*) = 1")
def sole_source(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.sole_sources(_monthly(spark, d))


@query(f"with {_MONTHLY}, o as (select p, min(s) as s from s group by p having count(*) = 1) select 'supplier:' || s as supplier, count(*) as parts from o group by s")
def single_points_of_failure(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.sole_sources(_monthly(spark, d)).groupBy("supplier").agg(F.count(F.lit(1)).alias("parts"))


@query(f"with {_SUPPLIES} select 'part:' || p as part, 'supplier:' || s as supplier, count(*) over (partition by p) as n from s")
def suppliers_by_part(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.with_group_size(_supplies(spark, d).select(F.col("dst").alias("part"), F.col("src").alias("supplier")), "part")


@query("select p_brand as label, count(*) as n, round(avg(case when q.l_partkey is not null then 1.0 else 0.0 end), 6) as share from part left join (select distinct l_partkey from lineitem where l_returnflag = 'R') q on p_partkey = q.l_partkey group by p_brand")
def supply_coverage(spark: SparkSession, d: str) -> DataFrame:
    hit = _read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(1))
    c = aggregates.coverage(_read(spark, d, "part").join(hit, "p_partkey", "left"), F.col("p_brand"), "hit")
    return c.withColumn("share", F.round("share", 6))


# filters


@query(_N + "select id from n where (type = 'Part' and size >= 40 and (brand = 'Brand#11' or price < 1000)) or (balance > 9000 and coalesce(segment, '') != 'BUILDING')")
def filter_tree(spark: SparkSession, d: str) -> DataFrame:
    def c(prop: str, op: str, value: object = None) -> dict:
        return {"prop": prop, "op": op, "value": value}

    spec = {"or": [{"and": [c("type", "eq", "Part"), c("size", "gte", 40), {"or": [c("brand", "eq", "Brand#11"), c("price", "lt", 1000)]}]}, {"and": [c("balance", "gt", 9000), c("segment", "neq", "BUILDING")]}]}
    return _flat(star_nodes(spark, d)).filter(filters.tree(spec)).select("id")


@query(_N + "select id from n where lower(brand) like '%brand#1%' and name is not null")
def filter_contains(spark: SparkSession, d: str) -> DataFrame:
    return star_nodes(spark, d).filter(filters.condition("brand", "contains", "BRAND#1") & filters.condition("name", "exists")).select("id")


@query(_N + "select id from n where segment is null or segment != 'BUILDING'")
def filter_neq_missing(spark: SparkSession, d: str) -> DataFrame:
    return star_nodes(spark, d).filter(filters.condition("segment", "neq", "BUILDING")).select("id")


_VIEW = "v as (select id from n where (type in ('Nation', 'Customer', 'Supplier') and id not in ('nation:3', 'supplier:1')) or id in ('region:1', 'nation:3'))"


def _view(spark: SparkSession, d: str) -> DataFrame:
    nodes = star_nodes(spark, d)
    visible = _flat(nodes).filter(F.col("type").isin("Nation", "Customer", "Supplier"))
    return filters.view_nodes(nodes, visible, _ids(spark, "nation:3", "supplier:1"), _ids(spark, "region:1", "nation:3"))


@query(_N[:-1] + f", {_VIEW} select id from v")
def view_filter_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d).select("id")


@query(_NE[:-1] + f", {_VIEW} select e.id from e where src in (select id from v) and dst in (select id from v)")
def view_filter_edges(spark: SparkSession, d: str) -> DataFrame:
    return filters.induced(Graph(star_nodes(spark, d), star_edges(spark, d)), _view(spark, d)).edges.select("id")


@query(_NE[:-1] + ", k as (select id from n where type in ('Region', 'Nation')) select e.id, e.type from e where src in (select id from k) and dst in (select id from k)")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return filters.induced(Graph(star_nodes(spark, d), star_edges(spark, d)), star_nodes(spark, d, ("Region", "Nation"))).edges.select("id", "type")


@query("with r as (select min(epoch_ms(o_orderdate)) as lo, max(epoch_ms(o_orderdate)) as hi from orders) select 'order:' || o_orderkey as id from orders, r where epoch_ms(o_orderdate) between lo + 0.5 * greatest(0, hi - lo - 604800000) and lo + 0.5 * greatest(0, hi - lo - 604800000) + 604800000")
def temporal_window(spark: SparkSession, d: str) -> DataFrame:
    return filters.in_window(star_nodes(spark, d, ("Order",)), "time", 0.5, 7).select("id")


@query("select event_id from events where ts < timestamp '2024-01-05' or ts > timestamp '2024-01-20'")
def temporal_hidden(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").withColumns({"s": F.col("ts"), "e": F.lit(None).cast("timestamp_ntz")})
    return filters.hidden_by_range(e, "s", "e", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query(_N + "select id from n where lower(name) like '%asia%' or levenshtein(lower(name), 'asia') <= 2")
def search(spark: SparkSession, d: str) -> DataFrame:
    return filters.search(star_nodes(spark, d), "Asia", ["name"], 20).select("id")


@query(_N + "select id, type, name, price from n where type in ('Part', 'Order') and price is not null order by price desc, id limit 50")
def table_page(spark: SparkSession, d: str) -> DataFrame:
    rows = _flat(star_nodes(spark, d)).filter("type in ('Part', 'Order') and price is not null")
    return views.page(rows, [F.desc("price"), "id"]).select("id", "type", "name", "price")


# traversal


@query(_NER + "b as (select src as a, dst as z from e where type != 'contains' union all select dst, src from e where type != 'contains'), h as (select 'region:1' as id, 0 as depth union select z, depth + 1 from h join b on h.id = a where depth < 2) select id, min(depth) as depth from h group by id")
def khop(spark: SparkSession, d: str) -> DataFrame:
    return traversal.hops(star_edges(spark, d), _ids(spark, "region:1"), 2, types=["partOf", "locatedIn", "placedBy", "supplies"])


@query(_E + "select distinct 'part:1' as id, case when src = 'part:1' then dst else src end as neighbor from e where src = 'part:1' or dst = 'part:1'")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return traversal.neighbors(star_edges(spark, d), _ids(spark, "part:1"))


@query("select 0 as step, 'customer:1' as id union all select 1, 'nation:' || c_nationkey from customer where c_custkey = 1 union all select 2, 'region:' || n_regionkey from customer join nation on c_nationkey = n_nationkey where c_custkey = 1")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    region = _read(spark, d, "customer").filter("c_custkey = 1").join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return traversal.shortest_path(star_edges(spark, d, ("partOf", "locatedIn")), "customer:1", f"region:{region}")


@query("select 'customer:' || c_custkey as id from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2 union all select 'supplier:' || s_suppkey from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 2 union all select 'nation:' || n_nationkey from nation where n_regionkey = 2")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    e = star_edges(spark, d, ("partOf", "locatedIn")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return traversal.hops(e, _ids(spark, "region:2"), directed=True).filter("depth > 0").select("id")


@query("select 'customer:' || c_custkey || '>nation:' || n_nationkey || '>region:' || n_regionkey as path, 2 as hops from customer join nation on c_nationkey = n_nationkey")
def simple_paths(spark: SparkSession, d: str) -> DataFrame:
    p = traversal.simple_paths(star_edges(spark, d, ("partOf", "locatedIn")), star_nodes(spark, d, ("Customer",)), 3, ends=star_nodes(spark, d, ("Region",)))
    return p.select(F.array_join("path", ">").alias("path"), "hops")


@query(_NER + f"{_ENDS}, r(id) as (select min(id) from b union select other from b join r using (id)), m as (select min(id) as low from r) select n.id, case when r.id is null then n.id else low end as component from m, n left join r using (id)")
def components(spark: SparkSession, d: str) -> DataFrame:
    # the SQL knows that all nodes with an edge hang together here
    return traversal.components(star_nodes(spark, d), star_edges(spark, d))


@query("with p as (select r_regionkey as r, 1 + (select count(*) from nation where n_regionkey = r_regionkey) + (select count(*) from customer join nation on c_nationkey = n_nationkey where n_regionkey = r_regionkey) + (select count(*) from supplier join nation on s_nationkey = n_nationkey where n_regionkey = r_regionkey) as size, coalesce((select min('customer:' || c_custkey) from customer join nation on c_nationkey = n_nationkey where n_regionkey = r_regionkey), (select min('nation:' || n_nationkey) from nation where n_regionkey = r_regionkey), 'region:' || r_regionkey) as low from region), q as (select r, row_number() over (order by size desc, low) - 1 as component from p) "
       "select 'region:' || r as id, component from q union all select 'nation:' || n_nationkey, component from nation join q on n_regionkey = r union all select 'customer:' || c_custkey, component from customer join nation on c_nationkey = n_nationkey join q on n_regionkey = r union all select 'supplier:' || s_suppkey, component from supplier join nation on s_nationkey = n_nationkey join q on n_regionkey = r")
def numbered_components(spark: SparkSession, d: str) -> DataFrame:
    return traversal.numbered_components(star_nodes(spark, d, ("Region", "Nation", "Customer", "Supplier")), star_edges(spark, d, ("partOf", "locatedIn")))


@query("select 'region:' || r_regionkey as id, 0 as depth from region union all select 'nation:' || n_nationkey, 1 from nation union all select 'customer:' || c_custkey, 2 from customer union all select 'supplier:' || s_suppkey, 2 from supplier")
def tree_depth(spark: SparkSession, d: str) -> DataFrame:
    down = star_edges(spark, d, ("partOf", "locatedIn")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = traversal.roots(star_nodes(spark, d, ("Region", "Nation", "Customer", "Supplier")), down)
    return traversal.tree_depths(down, found).select("id", "depth")


@query("select 'nation:' || n_nationkey as id, 0 as depth, 'nation:' || n_nationkey as ancestor from nation union all select 'nation:' || n_nationkey, 1, 'region:' || n_regionkey from nation")
def breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    down = star_edges(spark, d, ("partOf",)).select("id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return traversal.breadcrumbs(down, star_nodes(spark, d, ("Nation",)))


@query(_E + "select id, same_way, either_way from (select *, count(*) over (partition by src, dst) as same_way, count(*) over (partition by least(src, dst), greatest(src, dst)) as either_way from e) where same_way > 1")
def parallel_edges(spark: SparkSession, d: str) -> DataFrame:
    return traversal.parallel_edges(star_edges(spark, d)).filter("same_way > 1").select("id", "same_way", "either_way")


# updates


@query("select 'supplier:' || s_suppkey as id, s_acctbal as balance, count(l_suppkey) as line_count from supplier left join lineitem on s_suppkey = l_suppkey group by all having count(l_suppkey) > 0 union all select 'supplier:' || s_suppkey, s_acctbal, null from supplier where s_suppkey not in (select l_suppkey from lineitem)")
def virtualize(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("line_count"))
    rows = rows.select(F.concat(F.lit("supplier:"), "l_suppkey").alias("key"), "line_count")
    return updates.update_join(star_nodes(spark, d, ("Supplier",)), rows, "key").select("id", "balance", "line_count")


@query(_NE[:-1] + f", {_ENDS}, g as (select id, count(*) as degree from b group by id) select n.id, degree from n join g on n.id = g.id where type = 'Nation'")
def ingest_results(spark: SparkSession, d: str) -> DataFrame:
    result = aggregates.degree_centrality(star_nodes(spark, d), star_edges(spark, d))
    return updates.update_join(star_nodes(spark, d, ("Nation",)), result, "id").select("id", "degree")


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    before = star_nodes(spark, d, ("Supplier",)).select("id", "name", "balance")
    after = before.filter("id not in ('supplier:2', 'supplier:3')").withColumn("balance", F.when(F.col("balance") < 0, 0.0).otherwise(F.col("balance")))
    return before, after.unionAll(spark.createDataFrame([("supplier:new", "New", 1.0)], after.schema))


@query("select 'supplier:' || s_suppkey as id, case when s_suppkey in (2, 3) then 'removed' else 'changed' end as status, case when s_suppkey in (2, 3) then '' else 'balance' end as changed from supplier where s_suppkey in (2, 3) or s_acctbal < 0 union all select 'supplier:new', 'added', ''")
def diff_nodes(spark: SparkSession, d: str) -> DataFrame:
    return updates.diff(*_versions(spark, d), ["name", "balance"]).withColumn("changed", F.array_join("changed", ","))


@query("select status, count(*) as n from (select case when s_suppkey in (2, 3) then 'removed' else 'changed' end as status from supplier where s_suppkey in (2, 3) or s_acctbal < 0 union all select 'added') group by status")
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return updates.diff(*_versions(spark, d), ["name", "balance"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select 'locatedIn' as type, 'customers' as src, 'nation:' || c_nationkey as dst, count(*) as n from customer group by c_nationkey union all select 'locatedIn', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 1 from supplier")
def combo_edges(spark: SparkSession, d: str) -> DataFrame:
    groups = star_nodes(spark, d, ("Customer",)).select("id", F.lit("customers").alias("group"))
    return updates.regroup_edges(star_edges(spark, d, ("locatedIn",)), groups).groupBy("type", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _collapsed(spark: SparkSession, d: str) -> Graph:
    g = Graph(star_nodes(spark, d), star_edges(spark, d))
    return updates.collapse(g, F.coalesce("segment", "brand", F.substring("status", 1, 1)), ceiling=10)


_CLUSTERS = (
    "k as (select id, type, coalesce(segment, brand, status, 'unclustered') as c from n), z as (select c, count(*) as size from k group by c), "
    "r as (select c, row_number() over (order by size desc, c) as rk, count(*) over () as total from z), m as (select k.*, case when rk < 10 or total <= 10 then k.c else 'other' end as cluster from k join r using (c)) "
)


@query(_N[:-1] + f", {_CLUSTERS} select cluster, count(*) as members from m group by cluster")
def cluster_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d).nodes.select("cluster", "members")


@query(_NE[:-1] + f", {_CLUSTERS} select x.cluster as a, y.cluster as b, count(*) as weight from e join m x on x.id = src join m y on y.id = dst where x.cluster != y.cluster group by all")
def cluster_links(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d).edges


def _round(k: int) -> str:
    return (
        f"v{k} as (select x.id, label, sum(w) as w from x join l{k - 1} on l{k - 1}.id = other group by all), "
        f"b{k} as (select id, label, row_number() over (partition by id order by w desc, label) as rk from v{k}), l{k} as (select l{k - 1}.id, coalesce(b{k}.label, l{k - 1}.label) as label from l{k - 1} left join b{k} on b{k}.id = l{k - 1}.id and rk = 1)"
    )


@query(
    _NE[:-1] + ", y as (select * from e where type in ('partOf', 'locatedIn')), x as (select id, other, count(*) as w from (select src as id, dst as other from y union all select dst, src from y) group by all), "
    "l0 as (select id, id as label from n where type in ('Region', 'Nation', 'Customer', 'Supplier')), " + ", ".join(map(_round, (1, 2, 3))) + " select label, count(*) as members from l3 group by label"
)
def label_clusters(spark: SparkSession, d: str) -> DataFrame:
    labels = updates.propagate_labels(star_nodes(spark, d, ("Region", "Nation", "Customer", "Supplier")), star_edges(spark, d, ("partOf", "locatedIn")), 3)
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))


@query("select 'customer:' || c_custkey as id, case when c_acctbal < 0 then 'debtor' else 'plain' end as tag from customer where c_acctbal < 0")
def tag_index(spark: SparkSession, d: str) -> DataFrame:
    nodes = star_nodes(spark, d, ("Customer",))
    tagged = updates.tags_added(nodes, nodes.filter("balance < 0").select("id", F.lit("debtor").alias("tag")))
    return tagged.select("id", F.explode("tags").alias("tag"))


@query(_NE + "select e.id from e where src != 'nation:1' and dst != 'nation:1'")
def remove_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(star_nodes(spark, d), star_edges(spark, d))
    return updates.remove_nodes(g, _ids(spark, "nation:1")).edges.select("id")


# triples


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Types, names and balances as triples, then the edges."""
    n = star_nodes(spark, d)
    e = star_edges(spark, d).select("src", "type", "dst").distinct()
    none = F.lit(None).cast("string")

    def t(df: DataFrame, p: str, o: str, otype: str, datatype: str | None = None) -> DataFrame:
        dt = F.lit(datatype) if datatype else none
        return df.filter(F.col(o).isNotNull()).select(F.col("id").alias("s"), F.lit(p).alias("p"), F.col(o).cast("string").alias("o"), F.lit(otype).alias("otype"), dt.alias("datatype"), none.alias("lang"), "ord")

    flat = _flat(n)
    parts = t(flat, rdf.TYPE, "type", "uri").unionAll(t(flat, "name", "name", "literal")).unionAll(t(flat, "balance", "balance", "literal", "http://www.w3.org/2001/XMLSchema#double"))
    return parts.unionAll(e.select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o"), F.lit("uri").alias("otype"), none.alias("datatype"), none.alias("lang"), F.lit(0).cast("long").alias("ord")))


@query("select c_name as customer, n_name as nation, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def pattern_join(spark: SparkSession, d: str) -> DataFrame:
    m = rdf.match(_triples(spark, d), [("?c", rdf.TYPE, "Customer"), ("?c", "name", "?customer"), ("?c", "locatedIn", "?n"), ("?n", "partOf", "?r"), ("?n", "name", "?nation"), ("?r", "name", "?region")])
    return m.select("customer", "nation", "region")


@query("select s_name as name, s_acctbal as balance from supplier where s_acctbal <= 1000 and regexp_matches(lower(s_name), 'supplier#0*[0-9]*[13]$')")
def pattern_filter(spark: SparkSession, d: str) -> DataFrame:
    m = rdf.match(_triples(spark, d), [("?s", rdf.TYPE, "Supplier"), ("?s", "name", "?name"), ("?s", "balance", "?b")])
    number = F.col("b").try_cast("double")
    return rdf.answers(m, {"name": "name", "balance": number}, where=(number <= 1000) & F.col("name").rlike("(?i)supplier#0*[0-9]*[13]$"))


@query("select c_name as name from customer order by c_acctbal desc, c_name limit 10")
def pattern_order_limit(spark: SparkSession, d: str) -> DataFrame:
    m = rdf.match(_triples(spark, d), [("?c", rdf.TYPE, "Customer"), ("?c", "name", "?name"), ("?c", "balance", "?b")])
    return rdf.answers(m, {"name": "name"}, order=[F.col("b").try_cast("double").desc(), F.col("name")], limit=10)


@query("select distinct n_name as nation from supplier join nation on s_nationkey = n_nationkey")
def pattern_distinct(spark: SparkSession, d: str) -> DataFrame:
    m = rdf.match(_triples(spark, d), [("?s", rdf.TYPE, "Supplier"), ("?s", "locatedIn", "?n"), ("?n", "name", "?nation")])
    return rdf.answers(m, {"nation": "nation"}, distinct=True)


def _projected(spark: SparkSession, d: str) -> Graph:
    return rdf.project(_triples(spark, d), rdf.PRESETS["standard"])


@query(_N + "select id, type, name from n")
def rdf_project_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d).nodes.select("id", F.get("types", 0).alias("type"), F.col("props")["name"].alias("name"))


@query(_E + "select distinct src, dst, type from e")
def rdf_project_edges(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d).edges.select("src", "dst", "type")


_S = "s string, p string, o string, otype string, datatype string, lang string, ord long"


def _rows(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame([(*r, None, None, k) for k, r in enumerate(rows)], _S)


def _terms(df: DataFrame, *rows: tuple[Column, Column, Column, str], order: Column) -> DataFrame:
    """Triples made of each row of a table, in the given order."""
    none = F.lit(None).cast("string")
    made = F.array(*(F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(t).alias("otype"), (order * 10 + k).alias("ord")) for k, (s, p, o, t) in enumerate(rows)))
    return df.select(F.explode(made).alias("x")).select("x.s", "x.p", "x.o", "x.otype", none.alias("datatype"), none.alias("lang"), "x.ord")


@query("select 'order:' || o_orderkey as s, unnest(['state', 'state/priority', 'state/status']) as p, unnest(['{\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}', o_orderpriority, o_orderstatus]) as o from orders")
def bnode_collapse(spark: SparkSession, d: str) -> DataFrame:
    order, blank = F.concat(F.lit("order:"), "o_orderkey"), F.concat(F.lit("_:o"), "o_orderkey")
    rows = (order, F.lit("state"), blank, "bnode"), (blank, F.lit("status"), F.col("o_orderstatus"), "literal"), (blank, F.lit("priority"), F.col("o_orderpriority"), "literal")
    return rdf.fold_blank_nodes(_terms(_read(spark, d, "orders"), *rows, order=F.col("o_orderkey"))).select("s", "p", "o")


_LINES = "l as (select l_orderkey as o, l_linenumber as k, min(l_partkey) as p, min(l_quantity) as q from lineitem group by all)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """One row a line of an order (o, k): its least part and quantity, and the next line's number."""
    n = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k")).agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    # an order has a handful of lines
    return n.withColumns({"next": F.lead("k").over(Window.partitionBy("o").orderBy("k")), "first": F.row_number().over(Window.partitionBy("o").orderBy("k")) == 1})


@query(f"with {_LINES} select 'order:' || o as s, 'items' as p, to_json(list('part:' || p order by k))::varchar as o from l group by o")
def list_collapse(spark: SparkSession, d: str) -> DataFrame:
    # folding reads its triples several times, so the lines are grouped once
    lines = stored(_lines(spark, d))
    cell = F.concat(F.lit("cell:"), "o", F.lit("/"), "k")
    after = F.coalesce(F.concat(F.lit("cell:"), "o", F.lit("/"), "next"), F.lit(rdf.NIL))
    order = F.col("o") * 10 + F.col("k")
    cells = _terms(lines, (cell, F.lit(rdf.FIRST), F.concat(F.lit("part:"), "p"), "literal"), (cell, F.lit(rdf.REST), after, "uri"), order=order)
    heads = _terms(lines.filter("first"), (F.concat(F.lit("order:"), "o"), F.lit("items"), cell, "uri"), order=order)
    triples = heads.unionAll(cells)
    folded = rdf.fold_lists(triples)
    if folded is not triples:
        released(lines)
    return folded.select("s", "p", "o")


@query(f"with {_LINES} select 'order:' || o as s, 'contains' as p, 'part:' || p as o from l union all select 'order:' || o, 'edge-meta:contains:quantity', q::varchar from l")
def reification(spark: SparkSession, d: str) -> DataFrame:
    r, subject, part = rdf.RDF, F.concat(F.lit("order:"), "o"), F.concat(F.lit("part:"), "p")
    own = F.concat(F.lit("line:"), "o", F.lit("/"), "k")
    rows = (
        (subject, F.lit("contains"), part, "uri"), (own, F.lit(rdf.TYPE), F.lit(f"{r}Statement"), "uri"), (own, F.lit(f"{r}subject"), subject, "uri"), (own, F.lit(f"{r}predicate"), F.lit("contains"), "uri"),
        (own, F.lit(f"{r}object"), part, "uri"), (own, F.lit("quantity"), F.col("q"), "literal"),
    )
    return rdf.fold_statements(_terms(_lines(spark, d), *rows, order=F.col("o") * 10 + F.col("k"))).select("s", "p", "o")


def _ontology(spark: SparkSession, d: str) -> DataFrame:
    """Class and property axioms over the graph; each brand is a class of products."""
    axioms = _rows(
        spark, ("Customer", f"{rdf.RDFS}subClassOf", "Party", "uri"), ("Supplier", f"{rdf.RDFS}subClassOf", "Party", "uri"), ("Party", f"{rdf.RDFS}subClassOf", "Thing", "uri"),
        ("partOf", rdf.TYPE, f"{rdf.OWL}TransitiveProperty", "uri"), ("locatedIn", f"{rdf.RDFS}subPropertyOf", "partOf", "uri"), ("locatedIn", f"{rdf.RDFS}range", "Place", "uri"),
        ("holds", f"{rdf.OWL}inverseOf", "locatedIn", "uri"), ("near", rdf.TYPE, f"{rdf.OWL}SymmetricProperty", "uri"), ("nation:1", "near", "nation:2", "uri"), ("name", f"{rdf.RDFS}domain", "Named", "uri"),
    )
    brands = _read(spark, d, "part").select("p_brand").distinct()
    kinds = _terms(brands, (F.col("p_brand"), F.lit(f"{rdf.RDFS}subClassOf"), F.lit("Product"), "uri"), order=F.lit(10**6).cast("long"))
    product = _rows(spark, ("Product", f"{rdf.RDFS}subClassOf", "Thing", "uri"))
    return _triples(spark, d).unionAll(axioms).unionAll(kinds).unionAll(product)


#: Inferred triples by application and folder, so that the queries over them share one evaluation.
_KNOWN: dict[tuple[str, str], DataFrame] = {}


def _inferred(spark: SparkSession, d: str) -> DataFrame:
    key = spark.sparkContext.applicationId, d
    if key not in _KNOWN:
        _KNOWN[key] = rdf.infer(_ontology(spark, d))
    return _KNOWN[key]


@query("select * from (values ('Customer', 'Thing'), ('Supplier', 'Thing')) t(s, o) union all select distinct p_brand, 'Thing' from part")
def subclass_closure(spark: SparkSession, d: str) -> DataFrame:
    return _inferred(spark, d).filter(F.col("p") == f"{rdf.RDFS}subClassOf").select("s", "o")


@query("select 'customer:' || c_custkey as s, t as o from customer, (values ('Party'), ('Thing')) v(t) union all select 'supplier:' || s_suppkey, t from supplier, (values ('Party'), ('Thing')) v(t)")
def type_inheritance(spark: SparkSession, d: str) -> DataFrame:
    return _inferred(spark, d).filter((F.col("p") == rdf.TYPE) & F.col("o").isin("Party", "Thing")).select("s", "o")


@query("select distinct 'nation:' || k as s, 'Place' as o from (select c_nationkey as k from customer union select s_nationkey from supplier) union all select 'region:' || r_regionkey, 'Named' from region union all select 'nation:' || n_nationkey, 'Named' from nation union all select 'customer:' || c_custkey, 'Named' from customer union all select 'supplier:' || s_suppkey, 'Named' from supplier union all select 'part:' || p_partkey, 'Named' from part")
def domain_range(spark: SparkSession, d: str) -> DataFrame:
    return _inferred(spark, d).filter((F.col("p") == rdf.TYPE) & F.col("o").isin("Place", "Named")).select("s", "o")


@query("select 'nation:' || c_nationkey as s, 'holds' as p, 'customer:' || c_custkey as o from customer union all select 'nation:' || s_nationkey, 'holds', 'supplier:' || s_suppkey from supplier union all select 'nation:2', 'near', 'nation:1'")
def inverse_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return _inferred(spark, d).filter(F.col("p").isin("holds", "near"))


@query("select 'customer:' || c_custkey as s, 'region:' || n_regionkey as o from customer join nation on c_nationkey = n_nationkey union all select 'supplier:' || s_suppkey, 'region:' || n_regionkey from supplier join nation on s_nationkey = n_nationkey")
def transitive(spark: SparkSession, d: str) -> DataFrame:
    return _inferred(spark, d).filter((F.col("p") == "partOf") & F.col("o").startswith("region:")).select("s", "o")


@query(_NE + "select e.type as predicate, a.type as domain, b.type as range, count(*) as n from (select distinct src, dst, type from e) e join n a on a.id = src join n b on b.id = dst group by all")
def ontology_summary(spark: SparkSession, d: str) -> DataFrame:
    return rdf.ontology_summary(_triples(spark, d))


# shapes


def _validated(spark: SparkSession, d: str) -> DataFrame:
    party = (shapes.Rule("balance", 1, "number", least=0.0), shapes.Rule("name", 1, "string", pattern="1$"), shapes.Rule("segment", 1, values=("BUILDING", "MACHINERY")))
    return shapes.validate(star_nodes(spark, d, ("Customer", "Supplier")), [shapes.Shape("customer", "Customer", party), shapes.Shape("supplier", "Supplier", party[:2], closed=True, ignored=("segment",))])


_CHECKS = (
    "p as (select 'customer:' || c_custkey as id, 'customer' as shape, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select 'supplier:' || s_suppkey, 'supplier', s_name, s_acctbal, null from supplier), "
    "f as (select id, shape, 'balance' as path, 'minInclusive' as message, 'violation' as severity from p where balance < 0 union all select id, shape, 'name', 'pattern', 'warning' from p where name not like '%1' "
    "union all select id, shape, 'segment', 'in', 'violation' from p where shape = 'customer' and segment not in ('BUILDING', 'MACHINERY'))"
)


@query(f"with {_CHECKS} select * from f")
def shape_results(spark: SparkSession, d: str) -> DataFrame:
    return shapes.findings(_validated(spark, d))


@query(f"with {_CHECKS}, k as (select id, shape, count(*) as c from f group by all) select p.shape, count(*) as total, count(*) filter (where c is null) as passing, count(c) as failing, coalesce(sum(c), 0)::bigint as violations from p left join k on p.id = k.id group by p.shape")
def shape_summary(spark: SparkSession, d: str) -> DataFrame:
    return shapes.summary(_validated(spark, d))


@query(f"with {_CHECKS} select id, count(*) as n, case when bool_or(severity = 'violation') then 'violation' else 'warning' end as worst from f group by id")
def shape_drivers(spark: SparkSession, d: str) -> DataFrame:
    return shapes.drivers(_validated(spark, d))


def _even() -> Column:
    """Whether the number of a part by month is even."""
    return F.substring_index(F.substring_index("id", "@", 1), ":", -1).cast("long") % 2 == 0


@query(
    f"with {_CHECKS}, {_MONTHLY}, o as (select p, min(k) as k, min(s) as s from s group by p having count(*) = 1) select p as id, 'sole-source' as gap, case when k % 2 = 0 then 'violation' else 'warning' end as severity from o "
    "union all select 'supplier:' || s, 'single-point', 'warning' from o group by s union all select distinct id, 'shape:' || path, severity from f"
)
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    return supply.gaps(_monthly(spark, d), _even(), shapes.findings(_validated(spark, d)))


# encodings and derived values


@query("select 'part:' || p_partkey as id, round(4 + 28 * greatest(0, least(1, (p_retailprice - lo) / (hi - lo))), 6) as size from part, (select min(p_retailprice) as lo, max(p_retailprice) as hi from part)")
def encode_size(spark: SparkSession, d: str) -> DataFrame:
    p = star_nodes(spark, d, ("Part",))
    domain = p.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    return p.join(F.broadcast(domain)).select("id", F.round(values.scaled(F.col("price"), F.col("lo"), F.col("hi"), 4, 32), 6).alias("size"))


@query("with v as (select c_mktsegment as value, min(c_custkey) as o from customer where c_mktsegment is not null group by 1) select value, row_number() over (order by o, value) - 1 as slot from v")
def encode_color(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.first_seen_slots(star_nodes(spark, d, ("Customer",)), "segment").withColumn("slot", F.col("slot").cast("long"))


@query("select 'part:' || p_partkey as id, ['#eff3ff', '#bdd7e7', '#6baed6', '#2171b5'][floor((p_size - lo)::double / (hi - lo) * 3 + 0.5)::int + 1] as color from part, (select min(p_size) as lo, max(p_size) as hi from part)")
def encode_ramp(spark: SparkSession, d: str) -> DataFrame:
    p = star_nodes(spark, d, ("Part",))
    domain = p.agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    share = values.scaled(F.col("size"), F.col("lo"), F.col("hi"), 0, 1)
    return p.join(F.broadcast(domain)).select("id", values.palette_step(share, ["#eff3ff", "#bdd7e7", "#6baed6", "#2171b5"]).alias("color"))


@query("select 'part:' || p_partkey as id, round(p_retailprice / p_size * 100, 6) as rate, round(sqrt(p_retailprice / p_size * 100), 6) as root from part where p_size > 0")
def derived_property(spark: SparkSession, d: str) -> DataFrame:
    p = encodings.derived(star_nodes(spark, d, ("Part",)).filter("size > 0"), {"rate": "price / size * 100", "root": "sqrt(rate)"})
    return p.select("id", F.round("rate", 6).alias("rate"), F.round("root", 6).alias("root"))


@query(
    "select event_id as id, case event_id % 7 when 0 then 0.0 when 1 then user_id when 2 then 16 + user_id % 10 when 4 then user_id * 1000.0 when 6 then -0.5 end::double as number from events"
)
def text_numbers(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    forms = [F.lit(""), F.concat(F.lit(" "), user, F.lit(" ")), F.concat(F.lit("0x1"), (F.col("user_id") % 10).cast("string")), F.concat(user, F.lit("d")), F.concat(user, F.lit("e3")), F.col("event_type"), F.lit("-.5")]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 7 + 1).cast("int"))
    return _read(spark, d, "events").select(F.col("event_id").alias("id"), values.to_number(text).alias("number"))


# sinks and streams


_IRI = "'<urn:node:' || replace({0}, ':', '%3A') || '>'"


@query(
    _NE + f"select {_IRI.format('src')} || ' <urn:edge:' || type || '> ' || {_IRI.format('dst')} || ' .' as line from e union all select {_IRI.format('id')} || ' a <urn:node:' || type || '> .' from n "
    f"union all select {_IRI.format('id')} || ' <http://www.w3.org/2000/01/rdf-schema#label> \"' || name || '\" .' from n where name is not null union all select {_IRI.format('id')} || ' <urn:prop:segment> \"' || segment || '\" .' from n where segment is not null"
)
def turtle_lines(spark: SparkSession, d: str) -> DataFrame:
    return export.turtle(Graph(star_nodes(spark, d).select("id", "types", "ord", "name", "segment"), star_edges(spark, d)))


@query(_N + "select '{\"id\":\"' || id || '\"' || coalesce(',\"name\":\"' || name || '\"', '') || coalesce(',\"brand\":\"' || brand || '\"', '') || coalesce(',\"size\":' || size, '') || '}' as line from n")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    return export.json_lines(star_nodes(spark, d).select("id", "name", "brand", "size"))


@query(_N + "select id, type as types, name, ord::varchar as ord, segment, size::varchar as size from n")
def csv_nodes(spark: SparkSession, d: str) -> DataFrame:
    return export.csv_ready(star_nodes(spark, d).select("id", "types", "ord", "name", "segment", "size"))


@query(_E + "select id, src, dst, type from e")
def csv_edges(spark: SparkSession, d: str) -> DataFrame:
    return export.csv_ready(star_edges(spark, d).select("id", "src", "dst", "type"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = changes.windowed(_read(spark, d, "events"), F.col("ts"), ["event_type"], "value", "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hour then 1 when lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events), k as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, max(ts) + interval 6 hour as \"end\", count(*) as n from k group by user_id, s")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = changes.sessions(_read(spark, d, "events"), F.col("ts"), "user_id", "6 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("select user_id as id, max(event_id) as seq from events group by user_id having arg_max(event_type, event_id) != 'error'")
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    feed = _read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"))
    return changes.apply_changes(feed.limit(0).select("id", "seq"), feed)


@query("select event_id as id from events where event_id in (1, 2) or event_id in (select event_id from events where event_id not in (1, 2) order by ts desc, event_id desc limit 500)")
def recent_window(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.struct("ts", "event_id").alias("seq"))
    return changes.recent(e, 500, pinned=_ids(spark, "1", "2")).select(F.col("id").cast("long").alias("id"))
