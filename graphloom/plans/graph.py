"""Property graphs as two DataFrames, and the graph derived from the star-schema tables.

``nodes``: id, types (ordered; the first is primary), ord, then one typed column a property.
``edges``: id, src, dst, type, ord, then properties. Columns stay typed and wide, so scans are
pruned and filters reach parquet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def primary_type(types: str = "types") -> Column:
    """The first type, or Unknown."""
    return F.coalesce(F.get(types, 0), F.lit("Unknown"))


def least_of_each(df: DataFrame, *key: str) -> DataFrame:
    """One row of each key: the one that is least as JSON."""
    row = F.struct(*df.columns)
    return df.groupBy(*key).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


#: kind -> (table, key column, {property: column})
KINDS = {
    "Region": ("region", "r_regionkey", {"name": "r_name"}),
    "Nation": ("nation", "n_nationkey", {"name": "n_name"}),
    "Customer": ("customer", "c_custkey", {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}),
    "Supplier": ("supplier", "s_suppkey", {"name": "s_name", "balance": "s_acctbal"}),
    "Part": ("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "p_size", "price": "p_retailprice"}),
    "Order": ("orders", "o_orderkey", {"price": "o_totalprice", "status": "o_orderstatus", "time": "o_orderdate", "priority": "o_orderpriority"}),
}


def star_nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Nodes of the derived graph; ord is the kind's place and the key."""
    parts = []
    for rank, (kind, (table, key, props)) in enumerate(KINDS.items()):
        if kind in kinds:
            d = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            order = F.lit(rank * 10**12) + F.col(key).cast("long")
            parts.append(d.select(_id(kind.lower(), key).alias("id"), F.array(F.lit(kind)).alias("types"), order.alias("ord"), *(F.col(c).alias(p) for p, c in props.items())))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def star_edges(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = ("partOf", "locatedIn", "placedBy", "contains", "supplies")) -> DataFrame:
    """Edges of the derived graph; contains is a multi-edge, supplies is distinct."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def edge(d: DataFrame, kind: str, src: Column, dst: Column, eid: Column | None = None, **props: Column) -> DataFrame:
        made = F.concat(F.lit(f"{kind}/"), src, F.lit("/"), dst) if eid is None else eid
        return d.select(made.alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), *(c.alias(n) for n, c in props.items()))

    parts = []
    if "partOf" in types:
        parts.append(edge(read("nation"), "partOf", _id("nation", "n_nationkey"), _id("region", "n_regionkey")))
    if "locatedIn" in types:
        parts.append(edge(read("supplier"), "locatedIn", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey")))
        parts.append(edge(read("customer"), "locatedIn", _id("customer", "c_custkey"), _id("nation", "c_nationkey")))
    if "placedBy" in types:
        parts.append(edge(read("orders"), "placedBy", _id("order", "o_orderkey"), _id("customer", "o_custkey")))
    if "contains" in types:
        line = F.concat(F.lit("contains/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
        parts.append(edge(read("lineitem"), "contains", _id("order", "l_orderkey"), _id("part", "l_partkey"), line, quantity=F.col("l_quantity")))
    if "supplies" in types:
        parts.append(edge(read("lineitem").select("l_suppkey", "l_partkey").distinct(), "supplies", _id("supplier", "l_suppkey"), _id("part", "l_partkey")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: The same graph in DuckDB SQL, as two leading common table expressions.
NODES_SQL = """n as (
select 'region:' || r_regionkey as id, 'Region' as type, 0 * 1000000000000 + r_regionkey as ord, r_name as name, null::double as balance, null::varchar as segment, null::varchar as brand, null::varchar as kind, null::int as size, null::double as price, null::varchar as status, null::timestamp as time, null::varchar as priority from region
union all select 'nation:' || n_nationkey, 'Nation', 1 * 1000000000000 + n_nationkey, n_name, null, null, null, null, null, null, null, null, null from nation
union all select 'customer:' || c_custkey, 'Customer', 2 * 1000000000000 + c_custkey, c_name, c_acctbal, c_mktsegment, null, null, null, null, null, null, null from customer
union all select 'supplier:' || s_suppkey, 'Supplier', 3 * 1000000000000 + s_suppkey, s_name, s_acctbal, null, null, null, null, null, null, null, null from supplier
union all select 'part:' || p_partkey, 'Part', 4 * 1000000000000 + p_partkey, p_name, null, null, p_brand, p_type, p_size, p_retailprice, null, null, null from part
union all select 'order:' || o_orderkey, 'Order', 5 * 1000000000000 + o_orderkey, null, null, null, null, null, null, o_totalprice, o_orderstatus, o_orderdate, o_orderpriority from orders)"""
EDGES_SQL = """e as (
select 'partOf/nation:' || n_nationkey || '/region:' || n_regionkey as id, 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst, 'partOf' as type from nation
union all select 'locatedIn/supplier:' || s_suppkey || '/nation:' || s_nationkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'locatedIn' from supplier
union all select 'locatedIn/customer:' || c_custkey || '/nation:' || c_nationkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'locatedIn' from customer
union all select 'placedBy/order:' || o_orderkey || '/customer:' || o_custkey, 'order:' || o_orderkey, 'customer:' || o_custkey, 'placedBy' from orders
union all select 'contains/' || l_orderkey || '-' || l_linenumber, 'order:' || l_orderkey, 'part:' || l_partkey, 'contains' from lineitem
union all select 'supplies/supplier:' || l_suppkey || '/part:' || l_partkey, 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies' from (select distinct l_suppkey, l_partkey from lineitem))"""
