"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows and bytes in an Arrow batch: whole texts are long, so batches stay short.
_BATCH_ROWS, _BATCH_BYTES = "1000", str(16 << 20)
#: Bits of the filter that spares texts a shuffle (4 MB; used up to one hash in 16 bits).
FILTER_BITS = 1 << 25
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables settled within the settle_last that runs, if one does.
_on_the_way: ContextVar[list[DataFrame] | None] = ContextVar("on_the_way", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; Arrow batches of this session are kept short because its texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where it is unset one of our own, in local
    mode alone: on a cluster executors don't share one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    The shuffle files behind it are removed once it is written: nothing reads them again. The table
    itself goes by release or settle_last, at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    where, files = _place(out)
    files.deleteOnExit(where)
    if (made := _on_the_way.get()) is not None:
        made.append(out)
    return out


def _place(df: DataFrame) -> tuple:
    """The path of a settled table and its file system."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Delete settled tables whose readers have all been settled themselves."""
    for df in tables:
        path, files = _place(df)
        files.delete(path, True)


def settle_last(make: Callable[[], DataFrame], *spent: DataFrame) -> DataFrame:
    """settle(make()); then every table that make settled on the way is released, and those in spent."""
    made: list[DataFrame] = []
    token = _on_the_way.set(made)
    try:
        out = make()
    finally:
        _on_the_way.reset(token)
    kept = settle(out)
    release(*made, *spent)
    return kept


def bitmap_of(hashes: DataFrame, column: str) -> np.ndarray | None:
    """A bitmap of FILTER_BITS bits with one set for each hash; None where there are too many."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = hashes.groupBy(F.shiftright(bit, 5).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod({column}, 32) AS INT))")).alias("b"))
    if hashes.count() > FILTER_BITS // 16:
        return None
    out = np.zeros(FILTER_BITS // 32, dtype=np.int64)
    for w, b in words.toLocalIterator():
        out[w] = b
    return out


def unsent(hashes: list[int], sent: set[int]) -> list[bool]:
    """Which of these a task hasn't sent before; what it remembers is bounded."""
    if len(sent) > 1_000_000:
        sent.clear()
    return [not (h in sent or sent.add(h)) for h in hashes]


def likely(texts: DataFrame, bitmap: np.ndarray | None, column: str, keep: bool = True, once: bool = False) -> DataFrame:
    """Rows of texts whose column's bit is set (keep) or isn't. Without a bitmap all may be set.

    once: of rows with one hash a task passes the first alone, so that very many copies don't meet
    in one task; tasks may still send the same.
    """
    if bitmap is None and not once:
        return texts if keep else texts.where("false")
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    at = texts.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            if shared.value is not None:
                h = b.column(at).to_numpy(zero_copy_only=False)
                bit = h & (FILTER_BITS - 1)
                b = b.filter(pa.array(((shared.value[bit >> 5] >> (bit & 31)) & 1 == 1) == keep))
            yield b.filter(pa.array(unsent(b.column(at).to_pylist(), sent), pa.bool_())) if once else b

    return texts.mapInArrow(run, texts.schema)


def without_texts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows of docs, as they are, whose text's hash isn't among hashes (th, each once). Most rows
    that stay are told by a filter of fixed size and aren't shuffled."""
    name = fresh("th", *docs.columns)
    marked, bitmap = docs.withColumn(name, F.xxhash64("text")), bitmap_of(hashes, "th")
    own = [F.col(f"`{c}`") for c in docs.columns]
    maybe = likely(marked, bitmap, name).join(hashes.select(F.col("th").alias(name)), name, "left_anti").select(*own)
    return likely(marked, bitmap, name, keep=False).select(*own).union(maybe)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, *taken: str) -> str:
    """name, with underscores before it until it is none of those taken (letter case aside)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def ensure(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; a missing one is all null."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (public domain), element by element."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x += U64(0x9E3779B97F4A7C15)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
        return x
