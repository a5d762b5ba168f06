"""Queries: sources and sinks, curve preparation, weights and scalar expressions, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvecast.functions import curves as C
from curvecast.operators import prep, ranks
from curvecast.plans import fixtures as X
from curvecast.plans.registry import query, rounded, sql_rounded
from curvecast.plans.workdir import new_path, settle
from curvecast.sources import readers as R
from curvecast.sources import xlsx

# Sources: each table is first written in the reader's own format by Spark, then read back ---------

_SITES_OUT = "WITH " + X.SITES_SQL + "\nSELECT n_name AS name, lon, lat, CAST(asset + 1 AS DOUBLE) AS capacity FROM sites"


@query("src_sites_wind", _SITES_OUT)
def src_sites_wind(spark, sf):
    path = new_path(spark)
    X.sites(spark, sf).select(F.col("n_name").alias("Facility.Name"), F.col("lon").alias("longi"), F.col("lat").alias("lati"), (F.col("asset") + 1.0).alias("Capacity")).write.csv(path, header=True)
    return R.read_sites_wind(spark, path)


@query("src_sites_wind_xlsx", _SITES_OUT)
def src_sites_wind_xlsx(spark, sf):
    """Sites from workbooks, several in a folder."""
    xlsx.register(spark)
    path = new_path(spark)
    X.sites(spark, sf).select(F.col("n_name").alias("Facility.Name"), F.col("lon").alias("longi"), F.col("lat").alias("lati"), (F.col("asset") + 1.0).alias("Capacity")).repartition(3).write.format("xlsx").mode("append").save(path)
    return R.read_sites_wind_xlsx(spark, path)


@query("src_sites_solar", _SITES_OUT)
def src_sites_solar(spark, sf):
    path = new_path(spark)
    X.sites(spark, sf).select(F.col("n_name").alias("site_ids"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), (F.col("asset") + 1.0).alias("AC_capacity_MW")).write.csv(path, header=True)
    return R.read_sites_solar(spark, path)


_ASSETS = [f"a.{i}" for i in range(10)]
_HOURS_SQL = "WITH h AS (SELECT user_id % 10 AS a, date_trunc('hour', ts) AS ts, sum(value) AS v FROM events GROUP BY ALL), g AS (SELECT DISTINCT ts FROM h)\nSELECT 'a_' || x AS asset, g.ts, coalesce(v, 0) AS value FROM g CROSS JOIN range(0, 10) AS r(x) LEFT JOIN h ON h.a = x AND h.ts = g.ts"


def _wide(spark, sf, fmt, time):
    ev = X.t(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("ts"), (F.col("user_id") % 10).cast("string").alias("a"), "value")
    wide = ev.groupBy("ts").pivot("a", [str(i) for i in range(10)]).agg(F.sum("value")).fillna(0.0)
    path = new_path(spark)
    wide.select(F.date_format("ts", fmt).alias(time), *[F.col(str(i)).alias(f"a.{i}") for i in range(10)]).write.csv(path, header=True)
    return path


@query("src_actuals_wide", sql_rounded(_HOURS_SQL, "value", "asset ts"))
def src_actuals_wide(spark, sf):
    path = _wide(spark, sf, "yyyy-MM-dd HH:mm:ss", "Time")
    return rounded(R.read_wide(spark, path, "Time", _ASSETS).select("asset", F.col("ts").cast("timestamp_ntz").alias("ts"), "value"))


@query("src_dayahead_wide", sql_rounded(_HOURS_SQL, "value", "asset ts"))
def src_dayahead_wide(spark, sf):
    path = _wide(spark, sf, "MM/dd/yy HH:mm", "horizon_time")
    return rounded(R.read_wide(spark, path, "horizon_time", _ASSETS, "MM/dd/yy HH:mm").select("asset", F.col("ts").cast("timestamp_ntz").alias("ts"), "value"))


@query("src_curve_bundle", sql_rounded("WITH " + X.NY_SQL + "\nSELECT curve_id, tau, f, e FROM ny WHERE y = 1999", "f e", "curve_id tau"))
def src_curve_bundle(spark, sf):
    path = new_path(spark)
    X.nation_year(spark, sf).select("curve_id", "tau", "f", "e", F.lit("load").alias("resource"), F.col("y").alias("year")).write.partitionBy("resource", "year").parquet(path)
    return rounded(R.read_bundle(spark, path, "load", 1999))


#: The order priorities, which stand in for parameter names.
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("src_param_table", "WITH o AS (SELECT o_orderpriority AS p, month(o_orderdate) AS t, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY ALL)\nSELECT CAST(t AS INTEGER) AS t, " + ", ".join(f"max(CASE WHEN p = '{p}' THEN v END) AS \"{p}\"" for p in _PRIORITIES) + " FROM o GROUP BY t")
def src_param_table(spark, sf):
    wide = X.t(spark, sf, "orders").withColumn("m", F.month("o_orderdate")).groupBy(F.col("o_orderpriority").alias("name")).pivot("m", list(range(1, 13))).agg(F.round(F.avg("o_totalprice"), 2))
    path = new_path(spark)
    wide.write.csv(path, header=True)
    return R.read_param_table(spark, path, list(range(1, 13)), _PRIORITIES)


@query("src_results", "SELECT o_orderpriority AS param, CAST(month(o_orderdate) AS INTEGER) AS t, count(*) AS n FROM orders GROUP BY ALL")
def src_results(spark, sf):
    path = new_path(spark)
    X.t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("param"), F.month("o_orderdate").alias("t")).agg(F.count(F.lit(1)).alias("n")).write.csv(path, header=True)
    return R.read_results(spark, f"{path}/*.csv", "param string, t int, n long")


@query("src_scenario_dir", sql_rounded("WITH " + X.UD_SQL + "\nSELECT CAST(asset AS VARCHAR) AS asset, CASE WHEN day = 1 THEN 'actual' WHEN day = 2 THEN 'forecast' ELSE 'scenario' END AS role, CAST(CASE WHEN day > 2 THEN day - 2 END AS INTEGER) AS number, tau, f AS v FROM ud", "v", "asset role number tau"))
def src_scenario_dir(spark, sf):
    """A file per asset in the layout of the inputs: a header, the actual row, the forecast row, then
    scenarios; roles go by the row's place alone. Here days 1, 2 and the rest stand in for them."""
    packed = prep.pack(X.user_day(spark, sf), ["asset", "day"], f="f")
    line = F.concat_ws(",", F.lit("x"), "day", F.transform("f", lambda v: v.cast("string")))
    rows = packed.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct("day", line.alias("line")))).alias("rows"))  # a file's rows: about a thousand
    path = new_path(spark)
    header = F.lit(",".join(["type", "index", *[f"h{i}" for i in range(24)]]))
    rows.select("asset", F.concat_ws("\n", F.array(header), F.transform("rows", lambda r: r["line"])).alias("value")).write.partitionBy("asset").text(path)
    return rounded(R.read_scenario_dir(spark, path, 24))


_NATIONS = [f"NATION.{i}" for i in range(25)]


@query("src_multi_year", sql_rounded("WITH " + X.RAW_SQL + "\nSELECT y, tau, " + ", ".join(f"sum(CASE WHEN asset = {i} THEN f END) AS NATION_{i}" for i in range(25)) + " FROM raw GROUP BY ALL", " ".join(f"NATION_{i}" for i in range(25)), "y tau", 2))
def src_multi_year(spark, sf):
    """One file a year with a column per asset, as the inputs come; all years are read as one table."""
    path = new_path(spark)
    wide = X.nation_raw(spark, sf).groupBy("y", "tau").pivot("asset", list(range(25))).agg(F.sum("f"))
    wide.select("y", "tau", *[F.col(str(i)).alias(n) for i, n in enumerate(_NATIONS)]).repartition("y").write.partitionBy("y").csv(path, header=True)
    return rounded(R.read_years(spark, path, "tau int", _NATIONS), 2)


@query("src_curve_matrix", sql_rounded("WITH " + X.NY_SQL + "\nSELECT curve_id, tau, f AS v FROM ny", "v", "curve_id tau"))
def src_curve_matrix(spark, sf):
    path = new_path(spark)
    prep.pack(X.nation_year(spark, sf), ["curve_id"], f="f").select("curve_id", *[F.col("f")[i] for i in range(12)]).write.csv(path)
    return rounded(prep.unpack(R.read_curve_matrix(spark, path, 12), ["curve_id"], v="v"))


@query("sink_append_results", "SELECT year(o_orderdate) AS run, o_orderpriority AS param, count(*) AS n FROM orders GROUP BY ALL")
def sink_append_results(spark, sf):
    """A run's results (here: a year's) are appended under its key; a run that is tried again replaces its own."""
    counts = X.t(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("run"), F.col("o_orderpriority").alias("param")).agg(F.count(F.lit(1)).alias("n"))
    path = new_path(spark)
    for parity in (0, 1, 1):  # the second half is written twice
        R.append_results(counts.where(F.col("run") % 2 == parity), path, "run")
    return spark.read.parquet(path).select(F.col("run").cast("long").alias("run"), "param", "n")


@query("sink_band_cube", sql_rounded("WITH " + X.BAND_SQL + "\nSELECT CAST(event_id // 10000 AS INTEGER) AS asset, CAST(6 AS INTEGER) AS t, event_id, param_id, alpha, s, lower, upper FROM band", "lower upper", "asset t event_id param_id alpha s"))
def sink_band_cube(spark, sf):
    from curvecast.operators import bands

    _, scen = X.scenarios(spark, sf)
    path = new_path(spark)
    R.write_band_cube(bands.ecdf_band(scen, X.ALPHAS).select(F.floor(F.col("event_id") / 10_000).cast("int").alias("asset"), F.lit(X.T).alias("t"), "event_id", "param_id", "alpha", "s", "lower", "upper"), path)
    return rounded(spark.read.parquet(path).select("asset", "t", "event_id", "param_id", "alpha", "s", "lower", "upper"))


# Preparation --------------------------------------------------------------------------------------


@query("prep_trim_edges", "WITH o AS (SELECT user_id % 10 AS asset, event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id % 10) AS n FROM events)\nSELECT asset, event_id FROM o WHERE i > 15 AND i <= n - 9")
def prep_trim_edges(spark, sf):
    ev = X.t(spark, sf, "events").select((F.col("user_id") % 10).alias("asset"), "event_id", F.struct("ts", "event_id").alias("at"))
    return prep.trim_edges(ev, 15, 9, order="at").select("asset", "event_id")


@query("prep_dedup_sites", "WITH s AS (SELECT s_suppkey, s_nationkey % 7 AS lon, s_nationkey % 3 AS lat, row_number() OVER (PARTITION BY s_nationkey % 7, s_nationkey % 3 ORDER BY s_suppkey) AS r FROM supplier)\nSELECT s_suppkey, lon, lat FROM s WHERE r = 1")
def prep_dedup_sites(spark, sf):
    s = X.t(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 7).alias("lon"), (F.col("s_nationkey") % 3).alias("lat"))
    return prep.dedup_sites(s, "s_suppkey")


@query("prep_daily_curves", "WITH d AS (SELECT user_id % 10 AS asset, CAST(ts AS DATE) AS day, hour(ts) AS tau, sum(value) AS v FROM events GROUP BY ALL)\nSELECT asset, day, count(*) AS n, round(sum(v * (tau + 1)), 4) AS checksum FROM d GROUP BY ALL")
def prep_daily_curves(spark, sf):
    ev = X.t(spark, sf, "events").withColumn("asset", F.col("user_id") % 10)
    packed = prep.pack(prep.daily(ev, F.hour("ts")), ["asset", "day"], v="v", tau="tau")
    return packed.select("asset", "day", F.size("v").cast("long").alias("n"), F.round(F.aggregate(F.zip_with("v", "tau", lambda v, h: v * (h + 1)), F.lit(0.0), lambda a, b: a + b), 4).alias("checksum"))


@query("prep_flatten_asset_major", "WITH a AS (SELECT DISTINCT user_id % 10 AS asset, CAST(ts AS DATE) AS day FROM events)\nSELECT asset, day, (dense_rank() OVER (ORDER BY asset) - 1) * (SELECT count(DISTINCT day) FROM a) + dense_rank() OVER (ORDER BY day) - 1 AS curve_id FROM a")
def prep_flatten_asset_major(spark, sf):
    from pyspark.sql import Window

    cells = X.t(spark, sf, "events").select((F.col("user_id") % 10).alias("asset"), F.to_date("ts").alias("day")).distinct()
    # Assets and days are short lists (hundreds), numbered on their own and joined back.
    a = cells.select("asset").distinct().withColumn("i", F.row_number().over(Window.orderBy("asset")) - 1)
    d = cells.select("day").distinct().withColumns({"j": F.row_number().over(Window.orderBy("day")) - 1, "days": F.count(F.lit(1)).over(Window.partitionBy())})
    return cells.join(a, "asset").join(d, "day").select("asset", "day", (F.col("i") * F.col("days") + F.col("j")).cast("long").alias("curve_id"))


@query("prep_attach_location", sql_rounded("WITH " + X.SITES_SQL + "\nSELECT c_custkey, lon, lat FROM customer JOIN sites ON c_nationkey = asset", "lon lat", "c_custkey"))
def prep_attach_location(spark, sf):
    return rounded(X.t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("asset")).join(X.sites(spark, sf), "asset").select("c_custkey", "lon", "lat"))


@query("prep_capacity", sql_rounded("WITH " + X.RAW_SQL + "\nSELECT asset, max(f) AS capacity FROM raw WHERE y < 2000 GROUP BY asset", "capacity", "asset", 2))
def prep_capacity(spark, sf):
    return rounded(prep.capacity(X.nation_raw(spark, sf).where("y < 2000")), 2)


@query("prep_normalize", sql_rounded("WITH " + X.RAW_SQL + ", cap AS (SELECT asset, max(f) AS c FROM raw WHERE y < 2000 GROUP BY asset)\nSELECT asset, y, tau, f / nullif(c, 0) AS f, e / nullif(c, 0) AS e FROM raw JOIN cap USING (asset)", "f e", "asset y tau"))
def prep_normalize(spark, sf):
    raw = settle(X.nation_raw(spark, sf))
    return rounded(prep.normalize(raw, prep.capacity(raw.where("y < 2000")), "f", "e"))


@query("prep_clip01", sql_rounded("WITH " + X.NY_SQL + "\nSELECT curve_id, tau, f, e FROM ny", "f e", "curve_id tau"))
def prep_clip01(spark, sf):
    return rounded(X.nation_year(spark, sf).select("curve_id", "tau", "f", "e"))


@query("prep_tz_shift", "SELECT event_id, ts - INTERVAL 330 MINUTE AS shifted FROM events")
def prep_tz_shift(spark, sf):
    return X.t(spark, sf, "events").select("event_id", (F.col("ts").cast("timestamp_ntz") - F.expr("INTERVAL 330 MINUTES")).alias("shifted"))


@query("prep_upsample_step", sql_rounded("WITH " + X.UD_SQL + "\nSELECT curve_id, CAST(tau * 12 + j AS INTEGER) AS tau, f FROM ud CROSS JOIN range(0, 12) AS r(j)", "f", "curve_id tau"))
def prep_upsample_step(spark, sf):
    return rounded(prep.upsample_step(X.user_day(spark, sf), 12).select("curve_id", "tau", "f"))


@query("prep_upsample_linear", sql_rounded("WITH " + X.UD_SQL + ", n AS (SELECT *, coalesce(lead(f) OVER (PARTITION BY curve_id ORDER BY tau), f) AS g FROM ud)\nSELECT curve_id, CAST(tau * 12 + j AS INTEGER) AS tau, f + (g - f) * j / 12 AS f FROM n CROSS JOIN range(0, 12) AS r(j)", "f", "curve_id tau"))
def prep_upsample_linear(spark, sf):
    return rounded(prep.upsample_linear(X.user_day(spark, sf), 12, ["curve_id"], "f").select("curve_id", "tau", "f"))


@query("prep_day_key", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(dayofyear(ts) - 1 AS INTEGER) AS yday FROM events")
def prep_day_key(spark, sf):
    return X.t(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), (F.dayofyear("ts") - 1).alias("yday"))


@query("prep_month_key", "SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY ALL")
def prep_month_key(spark, sf):
    return X.t(spark, sf, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("prep_grid_labels", "WITH g AS (SELECT DISTINCT CAST(hour(ts) * 12 + minute(ts) // 5 AS INTEGER) AS tau FROM events)\nSELECT tau, tau * 5 AS minutes, lpad(CAST(tau * 5 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(tau * 5 % 60 AS VARCHAR), 2, '0') AS label FROM g")
def prep_grid_labels(spark, sf):
    g = X.t(spark, sf, "events").select((F.hour("ts") * 12 + F.floor(F.minute("ts") / 5)).cast("int").alias("tau")).distinct()
    return g.select("tau", (F.col("tau") * 5).alias("minutes"), F.format_string("%02d:%02d", (F.col("tau") * 5 / 60).cast("int"), F.col("tau") * 5 % 60).alias("label"))


@query("prep_align_assets", "WITH c AS (SELECT DISTINCT c_nationkey AS asset FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)), s AS (SELECT s_nationkey AS asset, min(s_suppkey) AS first FROM supplier GROUP BY ALL)\nSELECT asset, row_number() OVER (ORDER BY asset) AS place, row_number() OVER (ORDER BY first) AS was FROM c JOIN s USING (asset)")
def prep_align_assets(spark, sf):
    """Assets that both sources have, in one order (place), and where the second source has them (was)."""
    from pyspark.sql import Window

    c = X.t(spark, sf, "customer").select(F.col("c_nationkey").alias("asset")).distinct()
    s = X.t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("asset")).agg(F.min("s_suppkey").alias("first"))
    both = c.join(s, "asset")  # a list of assets: short
    return both.select("asset", F.row_number().over(Window.orderBy("asset")).cast("long").alias("place"), F.row_number().over(Window.orderBy("first")).cast("long").alias("was"))


_ACTIVE = "act AS (SELECT tau, sum(f + e) > 400 AS active FROM ud GROUP BY tau)"


@query("prep_active_slots", "WITH " + X.UD_SQL + ", " + _ACTIVE + "\nSELECT tau, active FROM act")
def prep_active_slots(spark, sf):
    return prep.active_slots(X.user_day(spark, sf), "f", "e", over=400.0)


@query("prep_active_slots_window", "WITH " + X.NY_SQL + "\nSELECT ev.event_id, h.tau, sum(h.f) > 1 AS active FROM hist h JOIN (SELECT DISTINCT curve_id AS event_id, yday FROM ev) ev ON abs(h.yday - ev.yday) < 7 GROUP BY ALL")
def prep_active_slots_window(spark, sf):
    ny = X.nation_year(spark, sf)
    return prep.active_slots_window(ny.where("y < 2000"), X.events(ny), 7, 1.0)


@query("prep_drop_inactive", sql_rounded("WITH " + X.UD_SQL + ", " + _ACTIVE + ", p AS (SELECT tau, row_number() OVER (ORDER BY tau) - 1 AS t2 FROM act WHERE active)\nSELECT curve_id, CAST(t2 AS INTEGER) AS tau, f FROM ud JOIN p USING (tau)", "f", "curve_id tau"))
def prep_drop_inactive(spark, sf):
    ud = X.user_day(spark, sf)
    return rounded(prep.drop_inactive(ud, prep.active_slots(ud, "f", "e", over=400.0)).select("curve_id", "tau", "f"))


@query("prep_event_grid", "WITH a AS (SELECT DISTINCT user_id % 10 AS asset FROM events), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)\nSELECT asset, day, CAST(t AS INTEGER) AS t FROM a CROSS JOIN d CROSS JOIN (VALUES (6), (12), (18)) AS v(t)")
def prep_event_grid(spark, sf):
    ev = X.t(spark, sf, "events")
    a, d = ev.select((F.col("user_id") % 10).alias("asset")).distinct(), ev.select(F.to_date("ts").alias("day")).distinct()
    return a.crossJoin(d).withColumn("t", F.explode(F.array(F.lit(6), F.lit(12), F.lit(18))))


@query("prep_make_event", "WITH " + X.NY_SQL + "\nSELECT curve_id AS event_id, CAST(6 AS INTEGER) AS t, round(sum(CASE WHEN tau < 6 THEN f * (tau + 1) END), 6) AS prefix, round(sum(e * (tau + 1)), 6) AS forecast, round(sum(CASE WHEN tau >= 6 THEN f * (tau - 5) END), 6) AS suffix FROM ev GROUP BY curve_id")
def prep_make_event(spark, sf):
    check = lambda c: F.round(F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b), 6)
    return X.events(X.nation_year(spark, sf)).select("event_id", "t", check("f").alias("prefix"), check("e").alias("forecast"), check("y").alias("suffix"))


@query("prep_anchor_last_obs", sql_rounded("WITH " + X.NY_SQL + "\nSELECT curve_id AS event_id, tau - 5 AS place, f AS v FROM ev WHERE tau >= 5", "v", "event_id place"))
def prep_anchor_last_obs(spark, sf):
    ev = prep.anchor_last(X.events(X.nation_year(spark, sf)), "y")
    return rounded(ev.select("event_id", F.posexplode("y").alias("place", "v")))


@query("prep_guard_range", "WITH " + X.NY_SQL + ", r AS (SELECT min(f) AS lo, max(f) AS hi FROM hist)\nSELECT event_id FROM truth GROUP BY event_id HAVING min(y) >= (SELECT lo FROM r) AND max(y) <= (SELECT hi FROM r)")
def prep_guard_range(spark, sf):
    ny = X.nation_year(spark, sf)
    return prep.guard_range(X.truth(ny).withColumnRenamed("y", "f"), ny.where("y < 2000"))


@query("prep_low_days", sql_rounded("WITH " + X.NY_SQL + "\nSELECT curve_id, avg(f) AS mean FROM ny GROUP BY curve_id HAVING avg(f) < 0.55", "mean", "curve_id"))
def prep_low_days(spark, sf):
    return rounded(prep.low_days(X.nation_year(spark, sf), 0.55))


@query("prep_point_lookup", sql_rounded("WITH " + X.NY_SQL + "\nSELECT curve_id, tau, f FROM ny WHERE round(lon, 4) = -102.5 AND y = 1998", "f", "curve_id tau"))
def prep_point_lookup(spark, sf):
    return rounded(X.nation_year(spark, sf).where((F.round("lon", 4) == -102.5) & (F.col("y") == 1998)).select("curve_id", "tau", "f"))


@query("prep_unit_sphere", sql_rounded("WITH " + X.SITES_SQL + "\nSELECT asset, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM sites", "x y z", "asset"))
def prep_unit_sphere(spark, sf):
    return rounded(X.sites(spark, sf).select("asset", *[v.alias(k) for k, v in C.unit_sphere(F.col("lon"), F.col("lat")).items()]))


@query("prep_wrap_yday", "SELECT o_orderkey, CAST(CASE WHEN dayofyear(o_orderdate) + 30 > 365 THEN dayofyear(o_orderdate) - 335 ELSE dayofyear(o_orderdate) + 30 END AS INTEGER) AS yday FROM orders")
def prep_wrap_yday(spark, sf):
    return X.t(spark, sf, "orders").select("o_orderkey", C.wrap_yday(F.dayofyear("o_orderdate") + 30).alias("yday"))


@query("prep_split_random", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CASE WHEN CAST('0x' || md5(CAST(CAST(o_orderdate AS DATE) AS VARCHAR))[1:8] AS BIGINT) % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM orders")
def prep_split_random(spark, sf):
    """A tenth of the days at random, the same days in every run."""
    day = X.t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return day.withColumn("split", prep.random_split(F.col("day"), 10))


@query("prep_split_loo", "WITH " + X.UD_SQL + ", d AS (SELECT DISTINCT day FROM ud)\nSELECT a.day AS fold, count(*) AS n, sum(b.day) AS days FROM d a JOIN d b ON a.day <> b.day GROUP BY a.day")
def prep_split_loo(spark, sf):
    """Each fold's training days, by the totals less the fold's own: no pairs of days are formed."""
    d = X.user_day(spark, sf).select("day").distinct()
    total = d.agg(F.count(F.lit(1)).alias("all"), F.sum("day").alias("sum"))  # one row
    return d.crossJoin(F.broadcast(total)).where("all > 1").select(F.col("day").alias("fold"), (F.col("all") - 1).alias("n"), (F.col("sum") - F.col("day")).alias("days"))


# Weights and scalar expressions, over all months of all curves ------------------------------------


def _weight(name, sql, expr, places=9):
    @query(name, sql_rounded("WITH " + X.NY_SQL + f"\nSELECT curve_id, tau, {sql} AS w FROM ny", "w", "curve_id tau", places))
    def run(spark, sf):
        return rounded(X.nation_year(spark, sf).select("curve_id", "tau", expr().alias("w")), places)


_weight("w_growth", "CASE WHEN tau < 6 THEN f * power(0.5::DOUBLE, (5 - tau) / (2.0::DOUBLE)) END", lambda: F.when(F.col("tau") < 6, F.col("f") * C.growth(F.col("tau"), 6, 2.0, 1.0)))
_weight("w_decay", "CASE WHEN tau >= 6 THEN f * power(0.5::DOUBLE, (tau - 6) / (3.0::DOUBLE)) END", lambda: F.when(F.col("tau") >= 6, F.col("f") * C.decay(F.col("tau") - 6, 3.0, 1.0)))
_weight("w_growth_rate", "CASE WHEN tau < 6 THEN f * exp(-0.3::DOUBLE * (5 - tau)) END", lambda: F.when(F.col("tau") < 6, F.col("f") * C.growth_rate(F.col("tau"), 6, 0.3)))
_weight("w_decay_rate", "CASE WHEN tau >= 6 THEN f * exp(-0.3::DOUBLE * (tau - 6)) END", lambda: F.when(F.col("tau") >= 6, F.col("f") * C.decay_rate(F.col("tau") - 6, 0.3)))
_weight("w_psi", "CASE WHEN tau = 3 THEN 0 WHEN tau < 6 THEN f * power(0.5::DOUBLE, (5 - tau) / 2.0::DOUBLE) ELSE f * power(0.5::DOUBLE, (tau - 6) / 3.0::DOUBLE) END", lambda: F.when(F.col("tau") == 3, F.lit(0.0)).otherwise(F.col("f") * C.psi(F.col("tau"), 6, 2.0, 3.0, 1.0)))
_weight("w_logistic", "1 - 1 / (1 + exp(6.906754778648554 * (f * 60 - 30) / 30.0::DOUBLE))", lambda: C.logistic(F.col("f") * 60 - 30, 1.0))
_weight("w_logistic_plain", "1 / (1 + exp(-(2.0::DOUBLE * (f - 0.5))))", lambda: C.logistic_plain(F.col("f") - 0.5, 2.0))
_weight("w_lie_trust", X.LIE_SQL.replace("trust_rate", "0.8::DOUBLE").replace("nu", "2.5::DOUBLE").replace("(s + 1)", "(tau + 1)") + " + f", lambda: C.lie_trust(F.col("tau"), 2.5, 0.8, 60.0) + F.col("f"))
_weight("k_rbf", "exp(-(f - e) * (f - e) / 0.1::DOUBLE)", lambda: C.rbf((F.col("f") - F.col("e")) * (F.col("f") - F.col("e")), 0.1))
_weight("k_inverse", "1 / ((f - e) * (f - e) + 0.1::DOUBLE)", lambda: C.inverse_kernel((F.col("f") - F.col("e")) * (F.col("f") - F.col("e")), 0.1))
_weight("g_haversine", X.hav_sql("lon", "lat", "lon + f", "lat + e"), lambda: C.haversine(F.col("lon"), F.col("lat"), F.col("lon") + F.col("f"), F.col("lat") + F.col("e")), 6)
_weight("g_periodic", X.per_sql("yday", "tau * 30"), lambda: C.periodic(F.col("yday"), F.col("tau") * 30))


def _cdf_sql(x: str) -> str:
    def horner(cs):
        out = repr(cs[0]) + "::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * abs({x}) + {c!r}::DOUBLE)"
        return out

    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2) * {horner(C.PHI_UP)} / {horner(C.PHI_DOWN)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))) / 2.506628274631::DOUBLE"
    tail = f"CASE WHEN {a} > 37 THEN 0 WHEN {a} < {C.PHI_EDGE}::DOUBLE THEN {near} ELSE {far} END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END"


_weight("m_normal_cdf", _cdf_sql("((f - e) * 20)"), lambda: C.normal_cdf((F.col("f") - F.col("e")) * 20))
_weight("m_normal_logpdf", "-0.5::DOUBLE * power((f - e) / 0.2::DOUBLE, 2) - ln(0.2::DOUBLE) - 0.9189385332046727::DOUBLE", lambda: C.normal_log_density(F.col("f"), F.col("e"), F.lit(0.2)))


@query("m_normal_pdf_cdf", sql_rounded("WITH " + X.NY_SQL + f"\nSELECT curve_id, tau, exp(-0.5::DOUBLE * power((f - e) / 0.2::DOUBLE, 2)) / 2.5066282746310002::DOUBLE AS pdf, {_cdf_sql('((f - e) / 0.2::DOUBLE)')} AS cdf FROM ny", "pdf cdf", "curve_id tau", 9))
def m_normal_pdf_cdf(spark, sf):
    z = (F.col("f") - F.col("e")) / 0.2
    return rounded(X.nation_year(spark, sf).select("curve_id", "tau", C.normal_density(z).alias("pdf"), C.normal_cdf(z).alias("cdf")), 9)


@query("w_adaptive_nu", sql_rounded("WITH " + X.NY_SQL + "\nSELECT curve_id AS event_id, greatest(875, 2750 * sqrt(sqrt(avg(CASE WHEN tau < 6 THEN power(f - e, 2) END)))) AS nu FROM ev GROUP BY curve_id", "nu", "event_id", 4))
def w_adaptive_nu(spark, sf):
    ev = X.nation_year(spark, sf).where((F.col("y") >= X.TEST_YEAR) & (F.col("tau") < 6))
    d = F.col("f") - F.col("e")
    return rounded(ev.groupBy(F.col("curve_id").alias("event_id")).agg(C.adaptive_nu(F.avg(d * d)).alias("nu")), 4)


@query("m_silverman", sql_rounded("WITH " + X.EMBED_SQL + "\nSELECT set_id, tau, 0.9::DOUBLE * least(stddev_pop(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34::DOUBLE) * power(count(*), -0.2::DOUBLE) AS h FROM emb GROUP BY ALL", "h", "set_id tau", 8))
def m_silverman(spark, sf):
    x, by = X.embed(spark, sf), ["set_id", "tau"]
    stats = x.groupBy(*by).agg(F.stddev_pop("v").alias("sd"), F.count("v").alias("n")).join(ranks.quantiles(x, by, "v", [0.25, 0.75]), by)
    return rounded(stats.select(*by, C.silverman_of(F.col("sd"), F.col("q")[0], F.col("q")[1], F.col("n")).alias("h")), 8)


# Set operations -----------------------------------------------------------------------------------


@query("set_union", "SELECT s_nationkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer")
def set_union(spark, sf):
    s = X.t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    return s.unionByName(X.t(spark, sf, "customer").select(F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("k")))


@query("set_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def set_intersect(spark, sf):
    return X.t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).intersect(X.t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")))


@query("set_distinct", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def set_distinct(spark, sf):
    return X.t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
