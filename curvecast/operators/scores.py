"""Forecast scores over bands, normal forecasts and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvecast.functions import curves as C

KEYS = ["event_id", "param_id"]
#: The (z, alpha) pairs of the normal bands.
NORMAL_LEVELS = ((2.3, 0.05), (1.96, 0.1), (1.65, 0.2), (1.28, 0.4), (0.84, 0.8))


def with_truth(band: DataFrame, truth: DataFrame) -> DataFrame:
    return band.join(truth.select("event_id", "s", "y"), ["event_id", "s"])


def interval(lower: Column, upper: Column, y: Column, alpha: Column) -> Column:
    """Interval score of one point."""
    return (upper - lower) + (2 / alpha) * (F.greatest(lower - y, F.lit(0.0)) + F.greatest(y - upper, F.lit(0.0)))


def _is(lower: str = "lower", upper: str = "upper") -> Column:
    return interval(F.col(lower), F.col(upper), F.col("y"), F.col("alpha"))


def interval_score(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS, "alpha").agg(F.avg(_is()).alias("score"))


def weighted_interval_score(rows: DataFrame) -> DataFrame:
    """Per lead (|y - centre| / 2 + sum of alpha / 2 times the score) / (K + 1/2), averaged."""
    lead = rows.groupBy(*KEYS, "s").agg(((0.5 * F.max(F.abs(F.col("y") - F.col("center"))) + F.sum(F.col("alpha") / 2 * _is())) / (F.count(F.lit(1)) + 0.5)).alias("w"))
    return lead.groupBy(*KEYS).agg(F.avg("w").alias("wis"))


def coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    inside = (F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))
    return rows.groupBy(*by).agg(F.avg(inside.cast("double")).alias("coverage"))


def coverage_levels(rows: DataFrame, alphas: list[float]) -> DataFrame:
    """One column per level, named for its nominal coverage."""
    wide = coverage(rows, [*KEYS, "alpha"]).groupBy(*KEYS).pivot("alpha", alphas).agg(F.first("coverage"))
    return wide.select(*KEYS, *[F.col(f"`{a}`").alias(f"cs{round(100 * (1 - a))}") for a in alphas])


def normal_bands(rows: DataFrame) -> DataFrame:
    """Rows (mu, sigma, y) to one per level with lower, centre, upper."""
    pairs = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(a).alias("alpha")) for z, a in NORMAL_LEVELS]))
    wide = rows.withColumn("_p", pairs).withColumns({"alpha": F.col("_p.alpha"), "lower": F.col("mu") - F.col("_p.z") * F.col("sigma"), "upper": F.col("mu") + F.col("_p.z") * F.col("sigma"), "center": F.col("mu")})
    return wide.drop("_p")


def log_score(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.avg(-C.normal_log_density(F.col("y"), F.col("mu"), F.col("sigma"))).alias("logs"))


def crps_normal(rows: DataFrame) -> DataFrame:
    z = (F.col("y") - F.col("mu")) / F.col("sigma")
    return rows.groupBy(*KEYS).agg(F.avg(F.col("sigma") * (z * (2 * C.normal_cdf(z) - 1) + 2 * C.normal_density(z) - 0.5641895835477563)).alias("crps"))


def crps_ensemble(members: DataFrame) -> DataFrame:
    """E|X - y| - E|X - X'| / 2 from sorted members (m, y): no pairs are formed."""
    at = Window.partitionBy(*KEYS, "s")
    x = members.withColumns({"_i": F.row_number().over(at.orderBy("m", "curve_id")), "_n": F.count(F.lit(1)).over(at)})
    lead = x.groupBy(*KEYS, "s").agg((F.avg(F.abs(F.col("m") - F.col("y"))) - F.sum(F.col("m") * (2 * F.col("_i") - F.col("_n") - 1)) / F.max(F.col("_n") * F.col("_n"))).alias("c"))
    return lead.groupBy(*KEYS).agg(F.avg("c").alias("crps"))


def pit_normal(rows: DataFrame) -> DataFrame:
    p = normal_pit()
    return rows.groupBy("param_id").agg(F.avg(p).alias("pit_mean"), F.stddev_pop(p).alias("pit_std"))


def normal_pit() -> Column:
    """The truth's place in its normal forecast."""
    return C.normal_cdf((F.col("y") - F.col("mu")) / F.col("sigma"))


def pit_ecdf(members: DataFrame) -> DataFrame:
    """Share of members at or below the truth per event and lead; values of exactly 1 are dropped."""
    return members.groupBy(*KEYS, "s").agg(F.avg((F.col("m") <= F.col("y")).cast("double")).alias("pit")).where("pit < 1")


def ks_gap(values: DataFrame, column: str, by: list[str], bins: int = 100) -> DataFrame:
    """rms (over bins) and sup gap between the cumulated density histogram and that of a density of 1.

    The bins divide the values' own range (half a unit either side where they are all equal); the
    density is count / n / width, and its sum runs against 1, 2, ..., bins.
    """
    span = values.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    flat = F.col("_hi") == F.col("_lo")
    span = span.select(*by, "_n", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")).alias("_w"))
    place = F.least(F.floor((F.col(column) - F.col("_lo")) / F.col("_w") * bins), F.lit(bins - 1))
    counts = values.join(span, by).groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = span.select(*by, "_n", "_w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counts, [*by, "bin"], "left").withColumn("density", F.coalesce("c", F.lit(0)) / F.col("_n") / (F.col("_w") / bins))
    cum = full.withColumn("gap", F.sum("density").over(Window.partitionBy(*by).orderBy("bin")) - (F.col("bin") + 1))
    return cum.groupBy(*by).agg((F.sqrt(F.avg(F.col("gap") * F.col("gap"))) / bins).alias("ks_rms"), F.max(F.abs("gap")).alias("ks_sup"))


def errors(rows: DataFrame, actual: str = "y", forecast: str = "mu", by: list[str] = KEYS) -> DataFrame:
    d = F.col(actual) - F.col(forecast)
    return rows.groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("mbe"))
