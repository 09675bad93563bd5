"""Streams: change feeds applied by the last operation of an id, event windows, and their batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each id by ``seq``; out-of-order and repeated numbers don't matter."""
    cols = [c for c in changes.columns if c != "id"]
    return changes.groupBy("id").agg(F.max_by(F.struct(*cols), "seq").alias("c")).select("id", "c.*")


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State rows (id, seq, ...) after a batch of changes with op ``upsert`` or ``remove``; older changes lose."""
    cols = state.columns
    both = state.withColumn("op", F.lit("upsert")).unionByName(last_changes(changes).select(*cols, "op"))
    return last_changes(both).filter("op != 'remove'").select(*cols)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _places(spark: SparkSession, base: str, number: int) -> dict[int, int]:
    """The version that each bucket was last written in, as of a batch; one row a bucket."""
    if number < 0:
        return {}
    return dict(map(tuple, spark.read.schema("bucket int, version int").parquet(f"{base}/places/v={number}").collect()))


def _rows(spark: SparkSession, base: str, schema: StructType, places: dict[int, int]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    paths = [f"{base}/v={v}/bucket={b}" for b, v in sorted(places.items())]
    return spark.read.schema(schema).parquet(*paths)


def state_at(spark: SparkSession, base: str, schema: StructType, number: int) -> DataFrame:
    """The state that ``apply_stream`` left after a batch, the last or the one before it."""
    return _rows(spark, base, schema, _places(spark, base, number))


def apply_stream(changes: DataFrame, base: str, checkpoint: str, *, buckets: int = 64) -> StreamingQuery:
    """Apply a change stream to state rows in ``base``, dealt over buckets by id: a batch reads and writes only the buckets of its ids.

    ``places/v=<batch>`` says which version of each bucket counts. A repeated batch overwrites its
    own files, so a retry after a failure changes nothing; files that neither the last batch nor
    the one before it counts on are deleted.
    """
    schema = changes.drop("op").schema

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        changed = last_changes(df)
        before, older = _places(spark, base, number - 1), _places(spark, base, number - 2)
        # at most as many as there are buckets
        touched = {r["b"] for r in changed.select(_bucket(buckets).alias("b")).distinct().collect()}
        now = apply_changes(_rows(spark, base, schema, {b: v for b, v in before.items() if b in touched}), changed)
        now.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{base}/v={number}")
        dealt = StructType([*schema.fields, StructField("bucket", IntegerType())])
        written = {r["bucket"] for r in spark.read.schema(dealt).parquet(f"{base}/v={number}").select("bucket").distinct().collect()}
        places = {**{b: v for b, v in before.items() if b not in touched}, **dict.fromkeys(written, number)}
        spark.createDataFrame(sorted(places.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{base}/places/v={number}")
        gone = [f"{base}/v={v}/bucket={b}" for b, v in older.items() if before.get(b) != v]
        for path in [*gone, *([f"{base}/places/v={number - 2}"] if number > 1 else [])]:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: Column, keys: list[str], value: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, keys..., n, total) by tumbling or sliding windows; ``late`` sets the watermark of a stream."""
    e = events.withColumn("__t", time.cast("timestamp"))
    e = e.withWatermark("__t", late) if late else e
    g = e.groupBy(F.window("__t", size, slide), *keys) if slide else e.groupBy(F.window("__t", size), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: Column, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, n) by gaps of inactivity."""
    e = events.withColumn("__t", time.cast("timestamp"))
    e = e.withWatermark("__t", late) if late else e
    return e.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def recent(arrivals: DataFrame, limit: int, order: str = "seq", pinned: DataFrame | None = None) -> DataFrame:
    """The last ``limit`` arrivals that aren't pinned, and all pinned ones."""
    pins = pinned.select("id", F.lit(True).alias("pin")) if pinned is not None else None
    a = arrivals.join(pins, "id", "left") if pins is not None else arrivals.withColumn("pin", F.lit(None).cast("boolean"))
    free = a.filter("pin is null").orderBy(F.desc(order)).limit(limit)
    return free.unionAll(a.filter("pin")).drop("pin")
