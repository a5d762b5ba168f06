"""Curve preparation: long series to daily curves, capacities, masks, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvecast.functions import curves as C


def trim_edges(obs: DataFrame, lead: int, trail: int, by: str = "asset", order: str = "ts") -> DataFrame:
    """Drop the first `lead` and last `trail` rows of each series."""
    up = Window.partitionBy(by).orderBy(order)
    size = Window.partitionBy(by)
    marked = obs.withColumns({"_i": F.row_number().over(up), "_n": F.count(F.lit(1)).over(size)})
    return marked.where((F.col("_i") > lead) & (F.col("_i") <= F.col("_n") - trail)).drop("_i", "_n")


def dedup_sites(sites: DataFrame, position: str) -> DataFrame:
    """The first site (by position) of each coordinate pair."""
    first = Window.partitionBy("lon", "lat").orderBy(position)
    return sites.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def pack(long: DataFrame, keys: list[str], **values: str) -> DataFrame:
    """Long rows (keys, tau, ...) to one row per curve with arrays ordered by tau."""
    rows = F.sort_array(F.collect_list(F.struct(*dict.fromkeys(["tau", *values.values()]))))
    packed = long.groupBy(*keys).agg(rows.alias("_rows"))
    return packed.select(*keys, *[F.col(f"_rows.{v}").alias(k) for k, v in values.items()])


def unpack(curves: DataFrame, keys: list[str], **arrays: str) -> DataFrame:
    """The reverse of pack: one row per slot."""
    zipped = F.arrays_zip(*[F.col(a).alias(k) for k, a in arrays.items()])
    return curves.select(*keys, F.posexplode(zipped).alias("tau", "_v")).select(*keys, "tau", *[F.col(f"_v.{k}").alias(k) for k in arrays])


def daily(obs: DataFrame, slot: Column, value: str = "value") -> DataFrame:
    """asset, day, tau, v of a series; several rows in a slot add up."""
    return obs.groupBy("asset", F.to_date("ts").alias("day"), slot.alias("tau")).agg(F.sum(value).alias("v"))


def capacity(long: DataFrame, value: str = "f", by: str = "asset") -> DataFrame:
    return long.groupBy(by).agg(F.max(value).alias("capacity"))


def normalize(long: DataFrame, cap: DataFrame, *values: str, by: str = "asset") -> DataFrame:
    """Divide by each asset's capacity; an asset without a positive one gets nulls."""
    scale = F.when(F.col("capacity") > 0, F.col("capacity"))
    return long.join(cap, by).withColumns({v: F.col(v) / scale for v in values}).drop("capacity")


def clip(long: DataFrame, *values: str) -> DataFrame:
    return long.withColumns({v: C.clip01(F.col(v)) for v in values})


def upsample_step(hourly: DataFrame, factor: int) -> DataFrame:
    """Each slot's value held over `factor` finer slots."""
    return hourly.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("tau", F.col("tau") * factor + F.col("_j")).drop("_j")


def upsample_linear(hourly: DataFrame, factor: int, keys: list[str], value: str = "v") -> DataFrame:
    """Linear between slot starts; the last slot's value is held."""
    after = F.coalesce(F.lead(value).over(Window.partitionBy(*keys).orderBy("tau")), F.col(value))
    steps = hourly.withColumn("_n", after).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return steps.withColumn(value, F.col(value) + (F.col("_n") - F.col(value)) * F.col("_j") / factor).withColumn("tau", F.col("tau") * factor + F.col("_j")).drop("_n", "_j")


def active_slots(long: DataFrame, *values: str, over: float = 0.0) -> DataFrame:
    """tau and whether the slot's summed values exceed `over`."""
    return long.groupBy("tau").agg((F.sum(sum(F.col(v) for v in values)) > over).alias("active"))


def active_slots_window(history: DataFrame, events: DataFrame, days: int, over: float, value: str = "f") -> DataFrame:
    """Per event and slot: whether curves less than `days` from the event's day sum to over `over`."""
    # History is summed by day of the year first, and each event's days are keys: no range join.
    sums = history.groupBy(F.col("yday").alias("_d"), "tau").agg(F.sum(value).alias("_v"))
    around = F.explode(F.sequence(F.col("yday") - (days - 1), F.col("yday") + (days - 1))).alias("_d")
    near = events.select("event_id", "yday").distinct().select("event_id", around).join(sums, "_d")
    return near.groupBy("event_id", "tau").agg((F.sum("_v") > over).alias("active"))


def drop_inactive(long: DataFrame, active: DataFrame) -> DataFrame:
    """Only active slots, numbered anew from 0."""
    order = Window.orderBy("tau")  # one row per slot of the grid, a few hundred at most
    place = active.where("active").select("tau", (F.row_number().over(order) - 1).alias("_t"))
    return long.join(F.broadcast(place), "tau").withColumn("tau", F.col("_t")).drop("_t")


def make_event(curves: DataFrame, t: int) -> DataFrame:
    """Split whole-day curves at slot t: f (prefix), e (whole forecast), y (suffix, the truth)."""
    return curves.withColumns({"y": F.slice("f", t + 1, F.size("f") - t), "f": F.slice("f", 1, t), "t": F.lit(t)})


def anchor_last(events: DataFrame, arr: str) -> DataFrame:
    """Put the last observed value before an array of leads."""
    return events.withColumn(arr, F.concat(F.array(F.element_at("f", -1)), F.col(arr)))


def guard_range(truth: DataFrame, history: DataFrame, value: str = "f") -> DataFrame:
    """Events whose truth lies inside the history's range."""
    span = history.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    out = truth.crossJoin(F.broadcast(span)).where((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi"))).select("event_id").distinct()
    return truth.select("event_id").distinct().join(out, "event_id", "left_anti")


def low_days(long: DataFrame, below: float, value: str = "f") -> DataFrame:
    return long.groupBy("curve_id").agg(F.avg(value).alias("mean")).where(F.col("mean") < below)


def random_split(key: Column, one_in: int) -> Column:
    """test for one key in so many, else train: drawn by a digest of the key as text, so alike in every run."""
    return F.when(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % one_in == 0, "test").otherwise("train")


def mask_arrays(events: DataFrame, active: DataFrame, slots: int, key: str = "event_id") -> DataFrame:
    """events with `active`, an array of one flag a slot, from rows (key, tau, active); slots without a row are active."""
    flags = active.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("tau", "active"))).alias("_m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(True)))
    return events.join(flags, key, "left").withColumn("active", F.coalesce(at, F.array_repeat(F.lit(True), slots))).drop("_m")
