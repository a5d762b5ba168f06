"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables settled within the settle_last that runs, if one does.
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def new_path(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir). Where it is unset a folder of
    our own will do in local mode alone: on a cluster executors don't share one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-curvecast-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/c-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back; its shuffle files go once it is written, the
    table itself with the settle_last around it or when the application ends."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    where, files = _place(spark, path)
    files.deleteOnExit(where)
    if (made := _on_the_way.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def settle_last(make: Callable[[], DataFrame]) -> DataFrame:
    """settle(make()), then delete every table that make settled on the way."""
    made: list[str] = []
    token = _on_the_way.set(made)
    try:
        out = make()
    finally:
        _on_the_way.reset(token)
    kept = settle(out)
    for path in made:
        where, files = _place(kept.sparkSession, path)
        files.delete(where, True)
    return kept
