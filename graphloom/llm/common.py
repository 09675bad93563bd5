"""Helpers that several corpus operators share: table access, the shared folder, keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a query's shuffle files go when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing in local mode (tests) a temporary folder is used and set
    as the checkpoint folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = sc.getCheckpointDir()
    if base is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if base is None:
        base = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(base)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the interpreter ends, if not before."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes the shuffle files of each query at the query's end."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, no executor holds state.

    Nothing needs the write's shuffles once it is done, so Spark removes their files at its end.
    """
    path = new_path(spark, tag)
    with freed_shuffles(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def released(spark: SparkSession, *steps: DataFrame) -> None:
    """Delete the files of ``stored`` steps whose readers are all stored themselves."""
    for df in steps:
        remove_path(spark, df._stored_at)


def workers_path(spark: SparkSession, path: str) -> str:
    """What ``local_path`` finds a folder of the shared folder by in every worker: itself if it is a local path, or a copy that Spark fetches."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return url.path
    spark.sparkContext.addFile(path, recursive=True)
    return "files:" + path.rsplit("/", 1)[1]


def local_path(path: str) -> str:
    return SparkFiles.get(path[6:]) if path.startswith("files:") else path


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text, the hash that the held-out splits use."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Hold Arrow batches of whole texts to ``rows`` records and about ``size`` bytes, so that a worker's memory stays bounded.

    Both are session settings that Spark reads when the plan runs, after the operator has
    returned, so they stay set; smaller ones of the session are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def by_size(texts: list[str | None], chars: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts in lists of about ``chars`` characters, a longer one alone."""
    part, n = [], 0
    for t in texts:
        if part and n + len(t or "") > chars:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t or "")
    if part:
        yield part
