"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Law ``rows``: shard counts are at most one apart. A row's number is its rank in a fixed total order
(a bucket of the hash of its identity, then the identity); equal rows share one run of numbers and
are interchangeable, so the placement does not depend on how the input was partitioned. The
permuted number n gives shard n mod k and slot n div k, and :func:`row_number_at` inverts it.
A null text counts as empty (size 1, CRC 0) and a null key sorts first; an empty table gives an
empty result. Texts of any length are only measured and hashed. Further columns are not read, but
for those to carry, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, fresh, mix64, partitions, settle

ROUNDS = 6
#: Copies of one identity that are numbered in one task.
COPIES = 1 << 16


def _half_bits(n: int) -> int:
    """Bits of each half of the smallest even-width domain that holds n numbers."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask, h = U64((1 << half) - 1), U64(half)
    left, right = x >> h, x & mask
    for key in keys:
        left, right = right, left ^ (mix64(right ^ U64(key)) & mask)
    return (right << h) | left


def _walk(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """Apply the network until every number is below n again (cycle walking)."""
    out = _network(x, _half_bits(n), keys)
    while (out_of := out >= U64(n)).any():
        out[out_of] = _network(out[out_of], _half_bits(n), keys)
    return out


def _keys(seed: int) -> list[int]:
    return [int(k) for k in mix64(np.arange(ROUNDS, dtype=U64) + U64((seed * 0x9E3779B1) & 0xFFFFFFFF))]


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permuted place of each row number below n."""
    return _walk(np.asarray(x, dtype=U64), n, _keys(seed))


def unpermute(y: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The inverse of permute: a swapped Feistel network undoes itself with the keys reversed."""
    return _walk(np.asarray(y, dtype=U64), n, _keys(seed)[::-1])


def row_number_at(shard: int, slot: int, n: int, n_shards: int, seed: int) -> int:
    """Which global row number lies in this shard and slot."""
    return int(unpermute(np.array([slot * n_shards + shard]), n, seed)[0])


def number_rows(df: DataFrame, identity: list[str], carry: list[str] = ()) -> DataFrame:
    """identity (and carry, equal for equal identities) plus row_no, gapless from 0 over all rows.

    Equal identities are counted before the shuffle and expanded after it, COPIES at a time: an
    identity with more of them is dealt out in runs of numbers first, so no task has all.
    """
    spark = df.sparkSession
    buckets = 8 * partitions(spark)
    n, b, start, size, begin, run = (fresh(x, *identity, *carry, "row_no") for x in ("_n", "_b", "_start", "_size", "_from", "_run"))
    counted = (
        df.groupBy(*identity)
        .agg(F.count(F.lit(1)).alias(n), *[F.first(c).alias(c) for c in carry])
        .withColumn(b, F.pmod(F.xxhash64(*identity), F.lit(buckets)))
    )
    counted = settle(counted)
    # One row a bucket, a number of rows fixed by the partition count: these offsets are small.
    sizes = counted.groupBy(b).agg(F.sum(n).alias(size))
    offsets = sizes.withColumn(begin, F.coalesce(F.sum(size).over(Window.partitionBy(F.lit(0)).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(b).orderBy(*[F.col(c).asc_nulls_first() for c in identity]).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col(begin) + F.coalesce(F.sum(n).over(inside), F.lit(0))
    begun = counted.join(F.broadcast(offsets), b).withColumn(start, first).select(*identity, *carry, start, n)
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES))).alias(run)
    many = begun.where(F.col(n) > COPIES).select(*identity, *carry, start, n, runs)
    many = many.repartition(*identity, run).select(*identity, *carry, (F.col(start) + F.col(run) * COPIES).alias(start), F.least(F.lit(COPIES), F.col(n) - F.col(run) * COPIES).alias(n))
    number = F.explode(F.sequence(start, F.col(start) + F.col(n) - 1)).alias("row_no")
    return begun.where(F.col(n) <= COPIES).unionByName(many).select(*identity, *carry, number)


def place(numbered: DataFrame, n: int, n_shards: int, seed: int = 17) -> DataFrame:
    """Add shard and slot to rows that have row_no."""

    @F.pandas_udf("long")
    def moved(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(permute(s.to_numpy(), n, seed).astype(np.int64))

    return numbered.withColumn("_at", moved("row_no")).withColumns({"shard": (F.col("_at") % n_shards).cast("int"), "slot": F.floor(F.col("_at") / n_shards).cast("long")}).drop("_at")


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 17, carry: list[str] = ()) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, carry, row_no, shard, slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_h"),
        *carry,
    )
    numbered = number_rows(named, ["doc_id", "size", "text_crc32", "_h"], list(carry))
    return place(numbered, docs.count(), n_shards, seed).drop("_h")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 17) -> None:
    """Write the texts as Parquet, one folder per shard, each file sorted by slot."""
    placed = shard_documents(docs, n_shards, seed, carry=["text"])
    placed.repartition(F.col("shard"), F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
