"""Forecast fusion: neighbours' remainders blended with their own day-ahead forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvecast.functions import curves as C

KEYS = ["event_id", "param_id"]


def scenarios(selected: DataFrame, history_long: DataFrame, params: DataFrame, t: int, trust: Column, own: DataFrame | None = None) -> DataFrame:
    """event_id, param_id, curve_id, s (lead), m (fused value), wn (weight in the set).

    Only selected ids join back to the values. trust: an expression of lead `s`, of parameters and of
    the columns of own, a table of one row an event (a nu of its own, or `active`, its mask: only
    active slots ahead are kept).
    """
    chosen = selected.where("in_final").select(*KEYS, "curve_id", (F.col("w") / F.sum("w").over(Window.partitionBy(*KEYS))).alias("wn"))
    ahead = history_long.where(F.col("tau") >= t).select("curve_id", (F.col("tau") - t).alias("s"), "f", "e")
    rows = chosen.join(ahead, "curve_id").join(F.broadcast(params), "param_id")
    rows = rows if own is None else rows.join(own, "event_id")
    rows = rows.where(F.element_at("active", F.col("s") + t + 1)) if "active" in rows.columns else rows
    rows = rows.withColumn("_eta", trust)
    return rows.select(*KEYS, "curve_id", "s", (F.col("f") * (1 - F.col("_eta")) + F.col("e") * F.col("_eta")).alias("m"), "wn")


def focal_curve(scen: DataFrame) -> DataFrame:
    return scen.groupBy(*KEYS, "s").agg(F.sum(F.col("wn") * F.col("m")).alias("focal"))


def median_curve(scen: DataFrame) -> DataFrame:
    return scen.groupBy(*KEYS, "s").agg(F.percentile("m", 0.5).alias("median"))


def anchors(selected: DataFrame, history_long: DataFrame, t: int) -> DataFrame:
    """Each neighbour's value at the last observed slot."""
    last = history_long.where(F.col("tau") == t - 1).select("curve_id", F.col("f").alias("m_0"))
    return selected.where("in_final").select(*KEYS, "curve_id").join(last, "curve_id")


def weighted_cov(scen: DataFrame) -> DataFrame:
    """Weighted covariance of scenarios by pair of leads (s1 <= s2), one product of matrices a set (of
    at most kappa_max curves and ties)."""

    def cov(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="curve_id", columns="s", values="m")
        w = pdf.groupby("curve_id")["wn"].first().reindex(wide.index).to_numpy()
        x = wide.to_numpy()
        d = x - w @ x
        c = (d * w[:, None]).T @ d
        i, j = np.triu_indices(len(c))
        s = wide.columns.to_numpy()
        return pd.DataFrame({"event_id": pdf["event_id"].iloc[0], "param_id": pdf["param_id"].iloc[0], "s1": s[i], "s2": s[j], "cov": c[i, j]})

    return scen.select(*KEYS, "curve_id", "s", "m", "wn").groupBy(*KEYS).applyInPandas(cov, "event_id long, param_id int, s1 int, s2 int, cov double")


def lie(minutes: float) -> Column:
    return C.lie_trust(F.col("s"), F.col("nu"), F.col("trust_rate"), minutes)
