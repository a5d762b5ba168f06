"""Forecast updates as observations arrive: hourly slots of a stream, scored against static history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvecast.functions import curves as C
from curvecast.operators import neighbors as N
from curvecast.operators.bands import rank_quantile


#: The table of finished hours.
HOURS = "asset long, start timestamp, f double, batch long, day date"


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """asset, start, f per tumbling hour; rows later than the watermark allows are dropped by Spark."""
    return stream.withWatermark("ts", late).groupBy("asset", F.window("ts", "1 hour").alias("w")).agg(F.sum("value").alias("f")).select("asset", F.col("w.start").alias("start"), "f")


def forecast(events: DataFrame, history: DataFrame, history_long: DataFrame, params: DataFrame, slots: int, per_hour: float, minutes: float) -> DataFrame:
    """event_id, param_id, t, s, focal, lower, upper: each event's fused scenarios in summary, events
    at any number of observed slots t side by side."""
    chosen = N.select(N.near(N.with_weights(events, params, slots, per_hour), history)).where("in_final")
    return summaries(chosen.select(*N.KEYS, "curve_id", "w").join(events.select("event_id", "t"), "event_id"), history_long, params, minutes)


def summaries(chosen: DataFrame, history_long: DataFrame, params: DataFrame, minutes: float) -> DataFrame:
    """event_id, param_id, t, s, focal, lower, upper of the chosen curves (event_id, param_id, t, curve_id, w)."""
    weighted = chosen.select(*N.KEYS, "t", "curve_id", (F.col("w") / F.sum("w").over(Window.partitionBy(*N.KEYS))).alias("wn"))
    rows = weighted.join(history_long.select("curve_id", "tau", "f", "e"), "curve_id").where(F.col("tau") >= F.col("t"))
    rows = rows.join(F.broadcast(params), "param_id").withColumn("s", F.col("tau") - F.col("t"))
    eta = C.lie_trust(F.col("s"), F.col("nu"), F.col("trust_rate"), minutes)
    fused = rows.select(*N.KEYS, "t", "s", "wn", (F.col("f") * (1 - eta) + F.col("e") * eta).alias("m"))
    return fused.groupBy(*N.KEYS, "t", "s").agg(F.sum(F.col("wn") * F.col("m")).alias("focal"), rank_quantile("m", 0.1).alias("lower"), rank_quantile("m", 0.9).alias("upper"))


def run_updates(stream: DataFrame, path: str, checkpoint: str, update: Callable[[DataFrame, DataFrame], DataFrame] | None = None, late: str = "2 hours") -> None:
    """Append each micro-batch's finished hours to a Parquet table (`path`/hours), and, with
    `update`, what it makes of them and of all hours so far (`path`/updates).

    Hours lie by day and, in it, by batch: a batch lists and reads the days that it touches alone,
    however many batches there have been. Folders are keyed by the batch number, so a batch that is
    run again after a failure replaces its own rows and nothing is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumns({"day": F.to_date("start"), "batch": F.lit(number)}).persist()  # read twice
        try:
            batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/hours")
            touched = [r[0] for r in batch.select("day").distinct().collect()] if update else []  # as many as its watermark spans
        finally:
            batch.unpersist()
        if update:
            days = [f"{path}/hours/day={d}" for d in touched]
            hours = spark.read.schema(HOURS).option("basePath", f"{path}/hours").parquet(*days) if days else spark.createDataFrame([], HOURS)
            hours = hours.where(F.col("batch") <= number)
            update(hours.where(F.col("batch") == number), hours).write.mode("overwrite").parquet(f"{path}/updates/batch={number}")

    hourly(stream, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
