"""Histograms and count tables (the data behind figures)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """1 to bins; the last bin is closed; null outside."""
    place = F.least(F.floor((x - low) / (high - low) * bins) + 1, F.lit(bins)).cast("int")
    return F.when((x >= low) & (x <= high), place)


def density(rows: DataFrame, x: Column, low: float, high: float, bins: int, by: list[str]) -> DataFrame:
    """by, bin, n and density of each bin that isn't empty."""
    counts = rows.select(*by, bin_of(x, low, high, bins).alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("density", F.col("n") / total / ((high - low) / bins))


def gaussian_kde(rows: DataFrame, x: str, width: DataFrame, low: float, high: float, points: int, by: list[str]) -> DataFrame:
    """Gaussian kernel density at grid points; width: by, h."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * ((high - low) / (points - 1))))
    k = F.exp(-0.5 * F.pow((F.col("g") - F.col(x)) / F.col("h"), 2)) / (F.col("h") * 2.5066282746310002)
    return rows.join(width, by).where("h > 0").withColumn("g", grid).groupBy(*by, "g").agg(F.avg(k).alias("density"))


def rank_bucket(rows: DataFrame, thresholds: DataFrame, distance: str) -> DataFrame:
    """bucket: how many of its event's ascending thresholds lie below the distance."""
    return rows.join(thresholds, "event_id").withColumn("bucket", F.size(F.filter("thresholds", lambda t: t < F.col(distance)))).drop("thresholds")
