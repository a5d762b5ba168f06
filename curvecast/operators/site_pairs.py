"""Sites near one another and days near one another, as tables to join on: both by equal cells, never all pairs.

A site's cell is a cube about the unit sphere, as wide as the chord of the radius, so poles and the
date line need no case of their own: two sites within the radius lie in the same cube or touching ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvecast.functions import curves as C

_AXES = ("x", "y", "z")
#: Widens cells a little, for rounding.
_SLACK = 1 + 1e-9


def _cells(places: DataFrame, width: float) -> DataFrame:
    return places.withColumns({f"_{k}": F.floor(v / width).cast("long") for k, v in C.unit_sphere(F.col("lon"), F.col("lat")).items()})


def within(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """lon, lat, lon_2, lat_2, d_h: every place of left and place of right at most km apart, each pair once.

    Both hold lon and lat in degrees; rows without one of them are near nothing. Equal places count
    once, so that a place with very many rows is one row here: join the rows back by lon and lat.
    A place meets those of 27 cells.
    """
    width = 2 * math.sin(min(km / (2 * C.EARTH_KM), math.pi / 2)) * _SLACK or 1e-9
    a, b = (df.select(F.col("lon").cast("double"), F.col("lat").cast("double")).dropna().distinct() for df in (left, right))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for k in _AXES:
        a = (_cells(a, width) if k == "x" else a).withColumn("_o", F.explode(near)).withColumn(f"_{k}", F.col(f"_{k}") + F.col("_o")).drop("_o")
    b = _cells(b.withColumnsRenamed({"lon": "lon_2", "lat": "lat_2"}).withColumns({"lon": F.col("lon_2"), "lat": F.col("lat_2")}), width).drop("lon", "lat")
    d = C.haversine(F.col("lon"), F.col("lat"), F.col("lon_2"), F.col("lat_2"))
    return a.join(b, [f"_{k}" for k in _AXES]).withColumn("d_h", d).where(F.col("d_h") <= km).select("lon", "lat", "lon_2", "lat_2", "d_h")


def days_within(left: DataFrame, right: DataFrame, days: int) -> DataFrame:
    """yday, yday_2, d_p: days of the year of left and right at most `days` (under half a year) apart round the year of 365 days.

    At most 366 (2 days + 1) rows, with day 366 as 1; rows without a day are near nothing.
    """
    a, b = (df.select(F.col("yday").cast("int").alias("yday")).dropna().distinct() for df in (left, right))
    on = lambda c: F.pmod(F.col(c), F.lit(365)).alias("_on")
    a = a.select("yday", F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_o")).select("yday", F.pmod(F.col("yday") + F.col("_o"), F.lit(365)).alias("_on"))
    b = b.select(F.col("yday").alias("yday_2"), on("yday"))
    return a.join(b, "_on").distinct().select("yday", "yday_2", C.periodic(F.col("yday"), F.col("yday_2")).alias("d_p"))


def candidates(events: DataFrame, history: DataFrame, km: float, days: int) -> DataFrame:
    """event_id, curve_id, d_h, d_p of every event and curve near in place and season.

    events: event_id, lon, lat, yday; history: curve_id and the same. Events go out once for each near
    place and each stretch of `days` days that holds a near one (at most four), never once a day, and
    meet the curves of that place and stretch; the table of near days, of fixed size, then picks the pairs.
    """
    ev = events.select("event_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col("yday").cast("int").alias("yday"))
    past = history.select("curve_id", F.col("lon").cast("double").alias("lon_2"), F.col("lat").cast("double").alias("lat_2"), F.col("yday").cast("int").alias("yday_2"))
    stretch = F.floor(F.col("yday_2") / max(days, 1)).alias("_stretch")
    near = days_within(events, history, days)
    at = ev.join(within(events, history, km), ["lon", "lat"]).join(F.broadcast(near.select("yday", stretch).distinct()), "yday")
    both = at.drop("lon", "lat").join(past.withColumn("_stretch", stretch), ["lon_2", "lat_2", "_stretch"])
    return both.join(F.broadcast(near), ["yday", "yday_2"]).select("event_id", "curve_id", "d_h", "d_p")
