"""Session settings, stored steps of iterative operators, and dense row numbers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whether a query's shuffle files go when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on: UTC, adaptive execution, later keys win in maps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share; a temporary one in local mode."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


#: Lets a task that holds one bucket write it without sorting its rows by bucket first.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

#: Steps that are still there, with their session.
_STEPS: dict[str, SparkSession] = {}


def _table(path: str) -> str:
    return path.rsplit("/", 1)[-1].replace("-", "_")


def _remove(path: str) -> None:
    spark = _STEPS.pop(path, None)
    if spark is None:
        return
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        spark.sql(f"drop table if exists {_table(path)}")
    except Exception:  # the session may have ended before the interpreter
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_STEPS):
        _remove(path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a loop's plan stays short, and lost executors lose nothing.

    The files go with ``released``, or else when the interpreter ends.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    with _set(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def stored_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``stored`` with one bucket of keys a file, so that later joins and groupings by ``key`` don't shuffle it.

    ``df`` comes dealt into as many partitions by that key, as by ``repartition``.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    with _set(spark, _CLEANUP, "true"), _set(spark, _WRITERS, "2"):
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(_table(path))
    back = spark.table(_table(path))
    back._stored_at = path
    return back


def _new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    _STEPS[path] = spark
    return path


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def released(*steps: DataFrame) -> None:
    """Delete the files of stored steps that nothing reads any more."""
    for df in steps:
        _remove(df._stored_at)


def joined(parts: list[DataFrame]) -> DataFrame:
    """Several stored steps of one schema as one, in their place."""
    if len(parts) == 1:
        return parts[0]
    out = stored(reduce(DataFrame.unionByName, parts))
    released(*parts)
    return out


def number_rows(t: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """Rows with a dense number from 1 in the given order (``ord`` if none): a range sort, then the partitions' sizes added up."""
    here = stored(t.orderBy(*(order or ("ord",))).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")))
    # one row a partition
    sizes = here.groupBy("__part").agg(F.count(F.lit(1)).alias("k")).withColumn("__before", F.sum("k").over(Window.orderBy("__part")) - F.col("k")).drop("k")
    low = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return here.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + low + 1).drop("__part", "__row", "__before")
