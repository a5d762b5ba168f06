"""Confidence bands from scenario sets (event_id, param_id, curve_id, s, m)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvecast.functions import curves as C
from curvecast.operators import depth as D

KEYS = ["event_id", "param_id"]


def rank_quantile(column: str, q: float):
    """Aggregate: the smallest sample whose empirical distribution reaches q (exact rank)."""
    return F.expr(f"percentile_disc({q!r}) WITHIN GROUP (ORDER BY {column})")


def ecdf_band(scen: DataFrame, alphas: list[float]) -> DataFrame:
    """Marginal bands by exact ranks; centre is the pointwise median."""
    cols = [f for i, a in enumerate(alphas) for f in (rank_quantile("m", a / 2).alias(f"l{i}"), rank_quantile("m", 1 - a / 2).alias(f"u{i}"))]
    wide = scen.groupBy(*KEYS, "s").agg(F.median("m").alias("center"), *cols)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"l{i}").alias("lower"), F.col(f"u{i}").alias("upper")) for i, a in enumerate(alphas)]))
    return wide.select(*KEYS, "s", "center", rows.alias("b")).select(*KEYS, F.col("b.alpha").alias("alpha"), "s", F.col("b.lower").alias("lower"), "center", F.col("b.upper").alias("upper"))


def as_sets(scen: DataFrame) -> DataFrame:
    """Scenario sets in the form the depths take; set_id is the (event, parameter) pair."""
    return scen.select(F.struct(*KEYS).alias("set_id"), "curve_id", F.col("s").alias("tau"), F.col("m").alias("v"))


def trimmed_band(scen: DataFrame, depths: DataFrame, alpha: float, zeta: float = 1.0) -> DataFrame:
    """Drop the floor(n zeta alpha) least deep curves; pointwise range of the rest, mean as centre."""
    whole = Window.partitionBy("set_id")
    marked = depths.withColumns({"_r": F.row_number().over(whole.orderBy("depth", "curve_id")), "_n": F.count(F.lit(1)).over(whole)})
    kept = marked.where(F.col("_r") > F.floor(F.col("_n") * zeta * alpha)).select(F.col("set_id.event_id").alias("event_id"), F.col("set_id.param_id").alias("param_id"), "curve_id")
    return scen.join(kept, [*KEYS, "curve_id"]).groupBy(*KEYS, "s").agg(F.min("m").alias("lower"), F.avg("m").alias("center"), F.max("m").alias("upper")).withColumn("alpha", F.lit(alpha))


def depth_band(scen: DataFrame, name: str | Callable[[DataFrame], DataFrame], alpha: float, zeta: float = 1.0) -> DataFrame:
    """trimmed_band by a depth from the registry, or any function of sets."""
    fn = D.REGISTRY[name] if isinstance(name, str) else name
    return trimmed_band(scen, fn(as_sets(scen)), alpha, zeta)


def dq_band(scen: DataFrame, alpha: float, zeta: float = 1.0) -> DataFrame:
    return depth_band(scen, lambda x: D.directional_quantile(x, alpha / 2, bounded=True).withColumn("depth", -F.col("depth")), alpha, zeta)


def dq_threshold_band(scen: DataFrame, alpha: float) -> DataFrame:
    """Range of the curves whose outlyingness at alpha / 2 is at most 1."""
    inside = D.directional_quantile(as_sets(scen), alpha / 2, bounded=True).where("depth <= 1").select(F.col("set_id.event_id").alias("event_id"), F.col("set_id.param_id").alias("param_id"), "curve_id")
    return scen.join(inside, [*KEYS, "curve_id"]).groupBy(*KEYS, "s").agg(F.min("m").alias("lower"), F.max("m").alias("upper"))


def kde_band(scen: DataFrame, alpha: float, width: float | None = None, points: int = 1000) -> DataFrame:
    """Lower and upper alpha / 2 by a Gaussian kernel's distribution on a grid over [0, 1].

    width: of the kernel; else Silverman's of each lead's scenarios, and no less than a step of the grid
    (it is nought where half of them are equal). A lead's scenarios, few by selection, are put in a list
    once; the grid's points and their running sums stay where that list is, without another shuffle.
    """
    step, keys = 1 / (points - 1), [*KEYS, "s"]
    own = F.lit(float(width)) if width is not None else F.greatest(C.silverman(F.col("m")), F.lit(step))
    sets = scen.groupBy(*keys).agg(F.collect_list("m").alias("ms"), own.alias("width"))
    at = sets.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.col("i") / (points - 1))
    kernel = lambda total, m: total + F.exp(-0.5 * F.pow((F.col("x") - m) / F.col("width"), 2))
    dens = at.select(*keys, "i", "x", F.aggregate("ms", F.lit(0.0), kernel).alias("p"))
    order = Window.partitionBy(*keys).orderBy("i")
    cdf = dens.withColumn("c", F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("p").over(Window.partitionBy(*keys)))
    step = cdf.withColumns({"c0": F.lag("c").over(order), "x0": F.lag("x").over(order)})

    def inverse(q: float):
        cross = (F.col("c") >= q) & (F.coalesce("c0", F.lit(-1.0)) < q)
        at = F.when(F.col("c0").isNull(), F.col("x")).otherwise(F.col("x0") + (q - F.col("c0")) / (F.col("c") - F.col("c0")) * (F.col("x") - F.col("x0")))
        return F.min(F.when(cross, at))

    return step.groupBy(*keys).agg(inverse(alpha / 2).alias("lower"), inverse(1 - alpha / 2).alias("upper"))


def with_anchor(band: DataFrame, events: DataFrame) -> DataFrame:
    """Rows s = -1 that hold the last observed value on both sides."""
    last = events.select("event_id", F.element_at("f", -1).alias("v"))
    first = band.select(*KEYS, "alpha").distinct().join(last, "event_id").select(*KEYS, "alpha", F.lit(-1).alias("s"), F.col("v").alias("lower"), F.col("v").alias("center"), F.col("v").alias("upper"))
    return band.select(*KEYS, "alpha", "s", "lower", "center", "upper").unionByName(first)
