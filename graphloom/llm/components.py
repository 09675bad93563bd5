"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import released, stored


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges(src, dst)``; component is the least node reachable.

    Large-star hangs each larger neighbour on the least one, small-star each smaller one;
    both are a grouped minimum (combined before the shuffle) and an equi-join, so a hub is
    never gathered in one place. Each round is written to the shared folder, which cuts the
    lineage. Nulls and self-links are ignored; an empty table gives an empty result.
    """
    e = (
        edges.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("u"))
        .filter("u is not null and v is not null and u != v")
        .distinct()
    )
    e = stored(spark, e, "cc")
    before = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .filter("u != v")
            .distinct()
        )
        e, old = stored(spark, small, "cc"), e
        released(spark, old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now[0] == now[2] and now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
