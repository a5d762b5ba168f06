"""Readers and writers of the curve inputs: explicit schemas, unpivoted to long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvecast.sources import xlsx


def read_sites_wind(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("`Facility.Name` string, longi double, lati double, Capacity double").csv(path, header=True)
    return raw.select(F.col("`Facility.Name`").alias("name"), F.col("longi").alias("lon"), F.col("lati").alias("lat"), F.col("Capacity").alias("capacity"))


def read_sites_wind_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The same from workbooks: a file, or all of a folder, a partition each."""
    xlsx.register(spark)
    raw = spark.read.format("xlsx").schema("`Facility.Name` string, longi double, lati double, Capacity double").load(path)
    return raw.select(F.col("`Facility.Name`").alias("name"), F.col("longi").alias("lon"), F.col("lati").alias("lat"), F.col("Capacity").alias("capacity"))


def read_sites_solar(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("site_ids string, longitude double, latitude double, AC_capacity_MW double").csv(path, header=True)
    return raw.withColumnsRenamed({"site_ids": "name", "longitude": "lon", "latitude": "lat", "AC_capacity_MW": "capacity"})


def read_wide(spark: SparkSession, path: str, time: str, assets: list[str], fmt: str | None = None) -> DataFrame:
    """A wide CSV (a time column, then a column per asset) as (asset, ts, value)."""
    schema = f"`{time}` string, " + ", ".join(f"`{a}` double" for a in assets)
    wide = spark.read.schema(schema).csv(path, header=True)
    ts = F.to_timestamp(F.col(f"`{time}`"), fmt) if fmt else F.to_timestamp(F.col(f"`{time}`"))
    named = wide.select(ts.alias("ts"), *[F.col(f"`{a}`").alias(a.replace(".", "_")) for a in assets])
    return named.unpivot(["ts"], [a.replace(".", "_") for a in assets], "asset", "value")


def read_bundle(spark: SparkSession, path: str, resource: str, year: int) -> DataFrame:
    """Curves of a Parquet bundle partitioned by (resource, year): only that partition is read."""
    return spark.read.parquet(path).where((F.col("resource") == resource) & (F.col("year") == year)).drop("resource", "year")


def read_param_table(spark: SparkSession, path: str, times: list[int], names: list[str]) -> DataFrame:
    """A CSV of parameters (rows) by time slot (columns) as one row per slot."""
    wide = spark.read.schema("name string, " + ", ".join(f"`{x}` double" for x in times)).csv(path, header=True)
    long = wide.unpivot(["name"], [F.col(f"`{x}`") for x in times], "t", "value")
    return long.groupBy(F.col("t").cast("int").alias("t")).pivot("name", names).agg(F.first("value"))


def read_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All result CSVs that a glob matches."""
    return spark.read.schema(schema).csv(pattern, header=True)


def read_scenario_dir(spark: SparkSession, path: str, hours: int) -> DataFrame:
    """A folder of per-asset files as (asset, role, number, tau, v). By the row's place in its file:
    the second is the actual one, the third the forecast, all after it scenarios (numbered from 1);
    two index columns come before the hourly values. A file is one asset's, so it is read whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("asset").cast("string").alias("asset"), F.posexplode(F.split("value", "\n")).alias("row", "line"))
    cells = F.transform(F.slice(F.split("line", ","), 3, hours), lambda v: v.cast("double"))
    rows = files.where("row > 0 and line <> ''").select("asset", "row", cells.alias("v"))
    role = F.when(F.col("row") == 1, "actual").when(F.col("row") == 2, "forecast").otherwise("scenario")
    return rows.select("asset", role.alias("role"), F.when(F.col("row") > 2, F.col("row") - 2).cast("int").alias("number"), F.posexplode("v").alias("tau", "v"))


def read_curve_matrix(spark: SparkSession, path: str, slots: int) -> DataFrame:
    """A headerless CSV of (id, slot values) as an array per curve."""
    raw = spark.read.schema("curve_id long, " + ", ".join(f"c{i} double" for i in range(slots))).csv(path)
    return raw.select("curve_id", F.array(*[f"c{i}" for i in range(slots)]).alias("v"))


def append_results(df: DataFrame, path: str, run: str) -> None:
    """Append results by run; rows of a run that is there already replace it, so a retry adds nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def read_years(spark: SparkSession, path: str, key: str, assets: list[str]) -> DataFrame:
    """Wide CSVs of several years (folders y=...) as one table: y, the key column, a column per asset."""
    schema = f"{key}, " + ", ".join(f"`{a}` double" for a in assets) + ", y int"
    wide = spark.read.schema(schema).csv(path, header=True)
    return wide.select("y", key.split()[0], *[F.col(f"`{a}`").alias(a.replace(".", "_")) for a in assets])


def write_band_cube(band: DataFrame, path: str) -> None:
    """Bands partitioned by (asset, t), for reading one asset and time alone."""
    band.write.partitionBy("asset", "t").parquet(path)
