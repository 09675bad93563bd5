"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Each source's documents are put into a fixed pseudo-random order (md5 of the id). A document's
virtual finish time is the words of its source up to and with it, over the source's target;
a source whose target is larger than its size runs through its documents up to ``passes``
times. All documents of all sources are taken in order of virtual time until the total budget
(the words of all documents) is reached; a document is taken whole or not at all.

No step gathers a source in one task: running sums are taken within (source, slice of the
order) and across slices from their sums, and the cut is found from sums by slice of virtual
time, after which only the one slice that holds the cut is sorted. The slices decide where
work runs, never what is taken.

Defined cases: null text has size 0; a null source is a source of its own, after all others;
repeated rows are documents of their own; documents of size 0 are never taken; an empty
table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stored

#: White space is a space or \x09 to \x0D, as the contract has it.
WORD = r"[^\x20\x09-\x0D]+"
_ORDER_SLICES, _TIME_SLICES = 4096, 4096


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), passes: int = 3) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``, one row a source.

    Weights repeat over the sources by code point, null last. A target stops at ``passes``
    times its source's size and the excess is shared again by weight: with the sources in order
    of cap over weight, the first one whose fair share is no more than its cap sets the level.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("w", w.cast("long")).withColumn("cap", passes * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    order = every.orderBy("r", "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    found = capped.withColumn("level", level).withColumn("at", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("r"), F.struct("at", "level"))).over(every)
    return found.withColumn("first", first["level"]).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("first")).alias("target")
    )


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", source: str = "source", size: Column, weights: tuple[int, ...] = (5, 2, 1), passes: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, copies): how often the mix takes each row of ``docs``."""
    spark = docs.sparkSession
    rows = stored(
        spark,
        docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
        .withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .withColumn("slice", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")),
        "mix",
    )
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    sums = stored(spark, rows.groupBy("key", "source", "slice").agg(F.sum("size").alias("words")), "mix")
    targets = stored(spark, source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, passes), "mix")
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    upto = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("base", F.coalesce(F.sum("words").over(upto), F.lit(0))).select("key", "slice", "base")
    keyed = targets.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source")
    within = Window.partitionBy("key", "slice").orderBy("h", "doc_id", "size")
    timed = (
        rows.withColumn("nth", F.row_number().over(within))
        .withColumn("own", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, ["key", "slice"])
        .join(keyed, "key")
        .withColumn("upto", F.col("base") + F.col("own"))
        .drop("base", "own")
    )
    timed = stored(spark, timed, "mix")

    def finish(k: int) -> Column:
        return F.when((F.col("size") > 0) & (F.col("target") > 0), (k * F.col("source_size") + F.col("upto")) / F.col("target"))

    def time_slice(k: int) -> Column:
        return F.least(F.floor(finish(k) * _TIME_SLICES), F.lit(2 * _TIME_SLICES)).cast("int")

    slices = timed.select("size", F.explode(F.array(*map(time_slice, range(passes)))).alias("t")).filter("t is not null").groupBy("t").agg(F.sum("size").alias("n"))
    running = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("t"))
    cut = slices.withColumn("end", running).filter(F.col("end") > budget).orderBy("t").select("t", (F.lit(budget) - F.col("end") + F.col("n")).alias("left")).first()
    at, left = (cut["t"], cut["left"]) if cut else (2 * _TIME_SLICES + 1, 0)
    whole = sum((F.coalesce((time_slice(k) < at).cast("int"), F.lit(0)) for k in range(passes)), F.lit(0))
    edge = (
        timed.select("key", "slice", "nth", "h", "doc_id", "size", F.explode(F.array(*(F.struct(time_slice(k).alias("t"), finish(k).alias("f"), F.lit(k).alias("k")) for k in range(passes)))).alias("x"))
        .filter(F.col("x.t") == at)
        .withColumn("sum", F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("x.f", "key", "h", "doc_id", "x.k", "nth").rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("sum") <= left)
        .groupBy("key", "slice", "nth")
        .agg(F.count(F.lit(1)).cast("int").alias("more"))
    )
    return timed.withColumn("whole", whole).join(edge, ["key", "slice", "nth"], "left").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("int").alias("copies")
    )


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), passes: int = 3) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as the plan takes it.

    The plan is joined back by id, source and size; rows that agree in all three but differ in
    text are interchangeable for the mix and share their copies in order of text.
    """
    size = word_count(F.col("text"))
    names = docs.columns
    alike = ["__mix_id", "__mix_source", "__mix_size"]
    plan = plan_mix(docs, size=size, weights=weights, passes=passes).select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), "copies").filter("copies > 0")
    plan = plan.withColumn("__mix_n", F.row_number().over(Window.partitionBy(*alike).orderBy(F.desc("copies"))))
    rows = docs.withColumns({"__mix_id": F.col("doc_id"), "__mix_source": F.col("source"), "__mix_size": size})
    rows = rows.withColumn("__mix_n", F.row_number().over(Window.partitionBy(*alike).orderBy("text")))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*alike, "__mix_n"]]
    out = rows.alias("d").join(plan.alias("p"), on)
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("p.copies")))).select(*(F.col(f"d.{c}").alias(c) for c in names))
