"""Ranks and exact quantiles of groups of any size: no group is ever whole in a task or a buffer.

Rows are dealt out by ranges of (group, order), so that a large group spreads over several tasks and
rows that tie lie in one; what comes before a range is known from the ranges' totals (one row a
group and range), and windows run inside a range alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvecast.plans.workdir import settle


def cumulated(rows: DataFrame, by: list[str], order: Column, weight: Column | None = None, parts: int | None = None) -> DataFrame:
    """rows (settled) plus `_upto`, the weight (or number) of its group's rows up to and with those that
    tie with it, `_own`, that of the ties, and `_all`, the group's. Groups by null keys count as one."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_w", F.lit(1) if weight is None else weight).repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id())
    dealt = settle(dealt)  # ranges come from a sample: they must not be drawn twice
    ranges = dealt.groupBy(*by, "_part").agg(F.sum("_w").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_in"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(*by)).alias("_all"))
    inside = Window.partitionBy(*by, "_part").orderBy(order)
    counted = dealt.withColumns({"_upto": F.sum("_w").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "_own": F.sum("_w").over(inside.rangeBetween(Window.currentRow, Window.currentRow))})
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    at = counted.join(ranges, [F.col("_part") == F.col("_in"), *same])
    return at.select(*[F.col(c) for c in rows.columns], (F.col("_upto") + F.col("_before")).alias("_upto"), "_own", "_all")


def quantiles(rows: DataFrame, by: list[str], value: str, probs: list[float], discrete: bool = False, parts: int | None = None) -> DataFrame:
    """by and q: the exact quantiles of each group's values, nulls aside: linear between neighbours or
    (discrete) the least value whose empirical distribution reaches the level.

    Equal values are counted before they are dealt out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    at = cumulated(counts, by, F.col(value), F.col("_c"), parts)
    holds = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_own") <= rank), F.col(value)))
    if discrete:
        reaches = lambda p: F.min(F.when(F.col("_upto") / F.col("_all") >= p, F.col(value)))
        return at.groupBy(*by).agg(F.array(*[reaches(p) for p in probs]).alias("q"))
    place = [F.lit(p) * (F.col("_all") - 1) for p in probs]
    found = at.groupBy(*by).agg(*[holds(F.floor(p)).alias(f"_lo{i}") for i, p in enumerate(place)], *[holds(F.ceil(p)).alias(f"_hi{i}") for i, p in enumerate(place)], F.max("_all").alias("_all"))
    between = [F.when(F.floor(p) == F.ceil(p), F.col(f"_lo{i}")).otherwise((F.ceil(p) - p) * F.col(f"_lo{i}") + (p - F.floor(p)) * F.col(f"_hi{i}")) for i, p in enumerate(place)]
    return found.select(*by, F.array(*between).alias("q"))
