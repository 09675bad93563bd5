"""Group-by, histogram, timeline, correlation and degree summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.values import to_number
from graphloom.plans.graph import primary_type
from graphloom.plans.session import number_rows


def count_by(df: DataFrame, key: Column) -> DataFrame:
    """(label, n): missing keys count as Unknown."""
    return df.groupBy(F.coalesce(key.cast("string"), F.lit("Unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def members(df: DataFrame, key: Column, ids: str = "id") -> DataFrame:
    """(label, id): the rows behind each label of ``count_by``, so that a selection leads back to ids."""
    return df.select(F.coalesce(key.cast("string"), F.lit("Unknown")).alias("label"), F.col(ids).alias("id"))


def count_by_type(nodes: DataFrame) -> DataFrame:
    return count_by(nodes, primary_type())


def both_ends(edges: DataFrame) -> DataFrame:
    """(id, other) for both directions of every edge, from one scan."""
    there, back = F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))
    return edges.select(F.explode(F.array(there, back)).alias("x")).select("x.*")


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): incident edge ends; parallel edges count, a self-loop counts twice."""
    n = both_ends(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_distribution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(degree, n) by numbers of different neighbours."""
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    ends = pairs.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    d = ends.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    return nodes.select("id").join(d, "id", "left").groupBy(F.coalesce("d", F.lit(0)).cast("long").alias("degree")).agg(F.count(F.lit(1)).alias("n"))


def number_of(df: DataFrame, name: str) -> Column:
    """A column as a number: text is read, flags are 0 and 1, anything else that isn't a number is missing."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return to_number(F.col(name))
    return F.col(name).cast("double") if kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else F.lit(None).cast("double")


def points(nodes: DataFrame, x: str, y: str) -> DataFrame:
    """(id, label, x, y) of the nodes that have a number in both columns; the label is the name, or the id."""
    label = F.coalesce(F.col("name").cast("string"), F.col("id")) if "name" in nodes.columns else F.col("id")
    p = nodes.select("id", label.alias("label"), number_of(nodes, x).alias("x"), number_of(nodes, y).alias("y"))
    return p.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")


def trend(points: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, intercept, r2) of the least-squares line through the points that have both values."""
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return p.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def bucketed(df: DataFrame, value: Column, bins: int | None, cap: int = 10) -> DataFrame:
    """``df`` with lo, width and bucket: equal widths over [min, max], the last one closed.

    Without ``bins`` there are as many as rows, at most ``cap``; a range of 0 counts as 1.
    """
    v = df.withColumn("__v", value.cast("double")).filter("__v is not null")
    stats = v.agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count(F.lit(1)).alias("rows"))
    k = F.lit(bins) if bins else F.least(F.lit(cap), F.col("rows"))
    stats = stats.select("lo", k.cast("long").alias("k"), (F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) / k).alias("width"))
    out = v.join(F.broadcast(stats))
    return out.withColumn("bucket", F.least(F.floor((F.col("__v") - F.col("lo")) / F.col("width")), F.col("k") - 1)).drop("__v")


def timeline(df: DataFrame, time: Column) -> DataFrame:
    """(bucket, start_ms, n): at most ten equal spans of time, empty ones left out."""
    b = bucketed(df, F.unix_millis(time.cast("timestamp")), None)
    return b.groupBy("bucket", (F.col("lo") + F.col("bucket") * F.col("width")).alias("start_ms")).agg(F.count(F.lit(1)).alias("n"))


def in_buckets(df: DataFrame, value: Column, first: int, last: int, bins: int | None = None, ids: str = "id") -> DataFrame:
    """(id): the rows behind the buckets ``first`` to ``last`` of a histogram or timeline, so that a selected range leads back to ids."""
    return bucketed(df, value, bins).filter(F.col("bucket").between(first, last)).select(F.col(ids).alias("id"))


def in_box(points: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    """(id): the points within a rectangle, its sides included."""
    return points.filter(F.col("x").between(*x) & F.col("y").between(*y)).select("id")


def histogram(df: DataFrame, value: Column, bins: int = 20) -> DataFrame:
    """(bucket, n) with empty bins kept."""
    counts = bucketed(df, value, bins).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def with_end_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with src_type and dst_type; a missing end is Unknown."""
    t = nodes.select("id", primary_type().alias("t"))
    out = edges.join(t.select(F.col("id").alias("src"), F.col("t").alias("src_type")), "src", "left")
    out = out.join(t.select(F.col("id").alias("dst"), F.col("t").alias("dst_type")), "dst", "left")
    return out.fillna("Unknown", ["src_type", "dst_type"])


def type_matrix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_type, dst_type, n, sources, targets): edges and different ends by pair of types."""
    # each edge once from either end; ends are counted by one grouping, not by two distinct counts
    ends = F.array(F.struct(F.lit(True).alias("out"), F.col("src").alias("id")), F.struct(F.lit(False).alias("out"), F.col("dst").alias("id")))
    per_end = with_end_types(edges.select("src", "dst"), nodes).select("src_type", "dst_type", F.explode(ends).alias("x")).groupBy("src_type", "dst_type", "x.out", "x.id").agg(F.count(F.lit(1)).alias("k"))
    return per_end.groupBy("src_type", "dst_type").agg(F.sum(F.when(F.col("out"), F.col("k"))).alias("n"), F.count_if("out").alias("sources"), F.count_if(~F.col("out")).alias("targets"))


def with_group_size(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the number n of rows that share their key, counted before it is joined, so no group is gathered."""
    return rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


def sole_sources(edges: DataFrame) -> DataFrame:
    """(part, supplier) for targets with exactly one edge."""
    return edges.groupBy(F.col("dst").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("supplier")).filter("n = 1").select("part", "supplier")


def coverage(df: DataFrame, group: Column, prop: str) -> DataFrame:
    """(label, n, share): how many rows of each group have the property."""
    share = F.avg(F.when(F.col(prop).isNotNull(), 1.0).otherwise(0.0))
    return df.groupBy(group.alias("label")).agg(F.count(F.lit(1)).alias("n"), share.alias("share"))


def first_seen_slots(df: DataFrame, value: str, order: str = "ord") -> DataFrame:
    """(value, slot): distinct values numbered by where they are first seen."""
    seen = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("string").alias("value")).agg(F.min(order).alias("__o"))
    return number_rows(seen, "__o", "value").select("value", (F.col("n") - 1).alias("slot"))


def registry(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name): observed node types, edge types and property columns in use."""
    def used(df: DataFrame, kind: str, fixed: set[str]) -> DataFrame:
        props = [c for c in df.columns if c not in fixed]
        names = F.array(*(F.when(F.max(F.col(c).isNotNull()), F.lit(c)) for c in props)) if props else F.array().cast("array<string>")
        return df.agg(F.array_compact(names).alias("p")).select(F.lit(kind).alias("kind"), F.explode("p").alias("name"))

    types = nodes.select(F.lit("nodeType").alias("kind"), F.explode("types").alias("name")).distinct()
    edge_types = edges.select(F.lit("edgeType").alias("kind"), F.col("type").alias("name")).distinct()
    fixed = {"id", "types", "ord", "src", "dst", "type"}
    return types.unionAll(edge_types).unionAll(used(nodes, "nodeProperty", fixed)).unionAll(used(edges, "edgeProperty", fixed))
