"""Curve sets over the given tables, as DataFrames and as the same thing in SQL.

nation_year: asset = customer nation, day = order year, slot = month; f = order totals, e = shipped
revenue as the companion forecast. user_day: asset = user_id % 10, slot = hour. embed: the vectors,
set = label. Sites have fixed formulas, as the tables hold no coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvecast.operators import prep
from curvecast.operators.tuning import PARAMS
from curvecast.plans.workdir import settle

#: Years from this one on are the events; those before it are the history.
TEST_YEAR, SLOTS, T = 2000, 12, 6
PER_HOUR, MINUTES = 1.0, 60.0
PARAM_ROWS = [
    (0, 2.0, 2.0, 0.05, 0.05, 3.0, 0.8, 2.5, 40.0, 0.05, 5, 20),
    (1, 3.0, 1.0, 0.05, 0.08, 2.0, 0.6, 3.5, 60.0, 0.50, 5, 20),
    (2, 1.0, 2.0, 0.02, 0.02, 3.0, 1.0, 2.5, 90.0, 0.97, 8, 30),
]
ALPHAS = [0.1, 0.2, 0.4]


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lon(k):
    return F.lit(-106.0) + 0.5 * F.pmod(7 * k, F.lit(25))


def lat(k):
    return F.lit(26.0) + 0.4 * F.pmod(11 * k, F.lit(25))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return t(spark, sf, "nation").select(k.cast("int").alias("asset"), "n_name", lon(k).alias("lon"), lat(k).alias("lat"))


def nation_raw(spark: SparkSession, sf: str) -> DataFrame:
    """asset, y, tau, f, e: zero-filled monthly sums."""
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    cust = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("asset"))
    items = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    owned = orders.join(cust, "o_custkey")
    month = lambda c: [F.year(c).alias("y"), (F.month(c) - 1).alias("tau")]
    f = owned.groupBy("asset", *month("o_orderdate")).agg(F.sum("o_totalprice").alias("f"))
    e = items.join(owned.select("o_orderkey", "asset"), "o_orderkey").groupBy("asset", *month("l_shipdate")).agg(F.sum("v").alias("e"))
    years = orders.select(F.year("o_orderdate").alias("y")).distinct()  # a handful of rows
    cells = t(spark, sf, "nation").select(F.col("n_nationkey").alias("asset")).crossJoin(F.broadcast(years)).withColumn("tau", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return cells.join(f, ["asset", "y", "tau"], "left").join(e, ["asset", "y", "tau"], "left").fillna(0.0, ["f", "e"])


def nation_year(spark: SparkSession, sf: str) -> DataFrame:
    """curve_id, asset, y, yday, lon, lat, tau, f, e: normalised by the training years' capacity."""
    raw = settle(nation_raw(spark, sf))  # summed anew for the capacity, floating sums differ and an asset's largest month is not quite 1
    scaled = prep.clip(prep.normalize(raw, prep.capacity(raw.where(F.col("y") < TEST_YEAR)), "f", "e"), "f", "e")
    a, y = F.col("asset"), F.col("y") - 1995
    return scaled.select((F.lit(10_000) * a + F.col("y")).cast("long").alias("curve_id"), "asset", "y", F.pmod(37 * a + 53 * y, F.lit(365)).alias("yday"), lon(a).alias("lon"), lat(a).alias("lat"), "tau", "f", "e")


CURVE_KEYS = ["curve_id", "asset", "y", "yday", "lon", "lat"]


def history(ny: DataFrame) -> DataFrame:
    return prep.pack(ny.where(F.col("y") < TEST_YEAR), CURVE_KEYS, f="f", e="e")


def events(ny: DataFrame, at: int = T) -> DataFrame:
    whole = prep.pack(ny.where(F.col("y") >= TEST_YEAR), CURVE_KEYS, f="f", e="e")
    return prep.make_event(whole, at).withColumnRenamed("curve_id", "event_id")


def truth(ny: DataFrame, at: int = T) -> DataFrame:
    """event_id, s, y (value), e of the slots ahead."""
    return ny.where((F.col("y") >= TEST_YEAR) & (F.col("tau") >= at)).select(F.col("curve_id").alias("event_id"), (F.col("tau") - at).alias("s"), F.col("f").alias("y"), "e")


def params(spark: SparkSession, param_rows: list[tuple] = PARAM_ROWS) -> DataFrame:
    return spark.createDataFrame(param_rows, PARAMS)


def user_day(spark: SparkSession, sf: str) -> DataFrame:
    """curve_id, asset, day (1 for the table's first), tau, f, e: hourly sums, zero-filled; e = the asset's mean of days 1 to 20."""
    ev = t(spark, sf, "events").select((F.col("user_id") % 10).cast("int").alias("asset"), F.to_date("ts").alias("d"), F.hour("ts").alias("tau"), "value")
    span = ev.agg(F.min("d").alias("d0"), (F.date_diff(F.max("d"), F.min("d")) + 1).alias("days"))  # one row
    number = (F.date_diff("d", "d0") + 1).alias("day")
    sums = ev.crossJoin(F.broadcast(span)).groupBy("asset", number, "tau").agg(F.sum("value").alias("f"))
    days = span.select("days", F.explode(F.sequence(F.lit(1), "days")).alias("day"))
    cells = spark.range(10).select(F.col("id").cast("int").alias("asset")).crossJoin(F.broadcast(days)).withColumn("tau", F.explode(F.sequence(F.lit(0), F.lit(23))))
    full = cells.join(sums, ["asset", "day", "tau"], "left").fillna(0.0, ["f"])
    e = full.where("day <= 20").groupBy("asset", "tau").agg(F.avg("f").alias("e"))
    return full.join(e, ["asset", "tau"]).select((F.col("asset") * F.col("days") + F.col("day") - 1).cast("long").alias("curve_id"), "asset", "day", "tau", "f", "e")


UC_KEYS = ["curve_id", "asset", "day", "yday", "lon", "lat"]


def user_curves(spark: SparkSession, sf: str) -> DataFrame:
    """UC_KEYS, tau, f, e: user_day as shares of the asset's largest hour, with a site and a day of the year."""
    ud, a = settle(user_day(spark, sf)), F.col("asset")  # as in nation_year
    capacity = ud.groupBy("asset").agg(F.max("f").alias("capacity")).where("capacity > 0")
    return ud.join(capacity, "asset").select("curve_id", "asset", "day", F.col("day").alias("yday"), lon(a).alias("lon"), lat(a).alias("lat"), "tau", (F.col("f") / F.col("capacity")).alias("f"), (F.col("e") / F.col("capacity")).alias("e"))


def day_span(spark: SparkSession, sf: str):
    """The events' first date and their number of days."""
    d = F.to_date("ts")
    row = t(spark, sf, "events").agg(F.min(d), F.date_diff(F.max(d), F.min(d)) + 1).first()
    return row[0], row[1]


def embed(spark: SparkSession, sf: str) -> DataFrame:
    """set_id (label), curve_id, tau, v."""
    return t(spark, sf, "embeddings").select(F.col("label").cast("long").alias("set_id"), F.col("vec_id").alias("curve_id"), F.posexplode("embedding").alias("tau", "v")).withColumn("v", F.col("v").cast("double"))


def supplier_year(spark: SparkSession, sf: str) -> DataFrame:
    """CURVE_KEYS, tau, f, e by supplier and year, so that curves grow with the tables: revenue and quantity
    by month as shares of the supplier's largest month before TEST_YEAR, with a place and a day of the year."""
    items = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("asset"), F.year("l_shipdate").alias("y"), (F.month("l_shipdate") - 1).alias("tau"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"), "l_quantity")
    sums = settle(items.groupBy("asset", "y", "tau").agg(F.sum("v").alias("f"), F.sum("l_quantity").alias("e")))  # as in nation_year
    largest = sums.where(F.col("y") < TEST_YEAR).groupBy("asset").agg(F.max("f").alias("cf"), F.max("e").alias("ce")).where("cf > 0 and ce > 0")
    filled = sums.groupBy("asset", "y").agg(F.map_from_entries(F.collect_list(F.struct("tau", F.struct("f", "e")))).alias("m"))  # at most SLOTS entries
    cells = filled.join(largest, "asset").select("*", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("tau")).withColumn("v", F.try_element_at("m", F.col("tau")))
    share = lambda c: F.least(F.coalesce(F.col(f"v.{c}"), F.lit(0.0)) / F.col(f"c{c}"), F.lit(1.0)).alias(c)
    a, y = F.col("asset"), F.col("y") - 1995
    place = [(F.lit(-120.0) + 0.05 * F.pmod(7919 * a, F.lit(1000))).alias("lon"), (F.lit(25.0) + 0.024 * F.pmod(104729 * a, F.lit(1000))).alias("lat")]
    return cells.select((10_000 * a + F.col("y")).cast("long").alias("curve_id"), "asset", "y", F.pmod(37 * a + 53 * y, F.lit(365)).alias("yday"), *place, "tau", share("f"), share("e"))


def year_sets(ny: DataFrame) -> DataFrame:
    """nation_year as one set per year."""
    return ny.select(F.col("y").cast("long").alias("set_id"), "curve_id", "tau", F.col("f").alias("v"))


# The same in SQL ----------------------------------------------------------------------------------

RAW_SQL = """
cells AS (SELECT n_nationkey AS asset, CAST(y AS INTEGER) AS y, CAST(tau AS INTEGER) AS tau FROM nation, (SELECT DISTINCT year(o_orderdate) AS y FROM orders) AS a, range(0, 12) AS b(tau)),
fsum AS (SELECT c_nationkey AS asset, year(o_orderdate) AS y, month(o_orderdate) - 1 AS tau, sum(o_totalprice) AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
esum AS (SELECT c_nationkey AS asset, year(l_shipdate) AS y, month(l_shipdate) - 1 AS tau, sum(l_extendedprice * (1 - l_discount)) AS e
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
raw AS (SELECT asset, y, tau, coalesce(f, 0) AS f, coalesce(e, 0) AS e FROM cells LEFT JOIN fsum USING (asset, y, tau) LEFT JOIN esum USING (asset, y, tau))"""

SITES_SQL = "sites AS (SELECT n_nationkey AS asset, n_name, -106 + 0.5::DOUBLE * ((7 * n_nationkey) % 25) AS lon, 26 + 0.4::DOUBLE * ((11 * n_nationkey) % 25) AS lat FROM nation)"

_CURVES_SQL = (
    RAW_SQL
    + ",\n"
    + SITES_SQL
    + """,
cap AS (SELECT asset, max(f) AS capacity FROM raw WHERE y < 2000 GROUP BY asset),
ny AS (SELECT CAST(asset * 10000 + y AS BIGINT) AS curve_id, asset, y, (37 * asset + 53 * (y - 1995)) % 365 AS yday, lon, lat, tau,
              CASE WHEN capacity > 0 THEN least(greatest(f / capacity, 0), 1) END AS f, CASE WHEN capacity > 0 THEN least(greatest(e / capacity, 0), 1) END AS e
       FROM raw JOIN cap USING (asset) JOIN sites USING (asset)),
hist AS (SELECT * FROM ny WHERE y < 2000), ev AS (SELECT * FROM ny WHERE y >= 2000)"""
)


def ny_sql(at: int = T) -> str:
    return _CURVES_SQL + f",\ntruth AS (SELECT curve_id AS event_id, tau - {at} AS s, f AS y, e FROM ev WHERE tau >= {at})"


def params_sql(param_rows: list[tuple]) -> str:
    values = ", ".join(f"({', '.join(str(v) if isinstance(v, int) else f'{v}::DOUBLE' for v in row)})" for row in param_rows)
    return f"params AS (SELECT * FROM (VALUES {values}) AS v(param_id, forget_rate_f, forget_rate_e, length_scale_f, length_scale_e, lookup_rate, trust_rate, nu, gamma, xi, kappa_min, kappa_max))"


NY_SQL, PARAMS_SQL = ny_sql(), params_sql(PARAM_ROWS)


SY_SQL = """
sraw AS (SELECT l_suppkey AS asset, year(l_shipdate) AS y, month(l_shipdate) - 1 AS tau, sum(l_extendedprice * (1 - l_discount)) AS f, sum(l_quantity) AS e FROM lineitem GROUP BY ALL),
scap AS (SELECT asset, max(f) AS cf, max(e) AS ce FROM sraw WHERE y < 2000 GROUP BY asset HAVING max(f) > 0 AND max(e) > 0),
scells AS (SELECT asset, y, CAST(k AS INTEGER) AS tau FROM (SELECT DISTINCT asset, y FROM sraw), range(0, 12) AS r(k)),
sy AS (SELECT CAST(asset * 10000 + y AS BIGINT) AS curve_id, asset, y, (37 * asset + 53 * (y - 1995)) % 365 AS yday, -120 + 0.05::DOUBLE * ((7919 * asset) % 1000) AS lon, 25 + 0.024::DOUBLE * ((104729 * asset) % 1000) AS lat,
              tau, least(coalesce(f, 0) / cf, 1) AS f, least(coalesce(e, 0) / ce, 1) AS e FROM scells JOIN scap USING (asset) LEFT JOIN sraw USING (asset, y, tau)),
hist AS (SELECT * FROM sy WHERE y < 2000), ev AS (SELECT * FROM sy WHERE y >= 2000)"""


def hav_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(power(sin((radians({lat1}) - radians({lat2})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin((radians({lon1}) - radians({lon2})) / 2), 2)))"


def per_sql(a: str, b: str) -> str:
    return f"power(sin(0.5::DOUBLE * (360.0::DOUBLE / 365.0::DOUBLE) * (({a}) - ({b})) * 3.141592653589793 / 180.0::DOUBLE), 2)"


def dist_sql(at: int = T, fold: str = "", masked: bool = False) -> str:
    """fold: a condition on h and ev that keeps an event from its own curves; masked: weights only where actf is active."""
    phi = f"power(0.5::DOUBLE, ({at} - 1 - h.tau) / forget_rate_f)"
    psi = f"CASE WHEN h.tau < {at} THEN power(0.5::DOUBLE, ({at} - 1 - h.tau) / forget_rate_e) ELSE power(0.5::DOUBLE, (h.tau - {at}) / lookup_rate) END"
    on, act = (" * CASE WHEN act.active THEN 1 ELSE 0 END", " JOIN actf AS act ON act.event_id = ev.curve_id AND act.tau = h.tau") if masked else ("", "")
    phi, psi, where = f"{phi}{on}", f"({psi}){on}", f" WHERE {fold}" if fold else ""
    return f"""
dist0 AS (SELECT ev.curve_id AS event_id, param_id, h.curve_id,
  sum(CASE WHEN h.tau < {at} THEN {phi} * power(h.f - ev.f, 2) END) / nullif(sum(CASE WHEN h.tau < {at} THEN {phi} END), 0) AS d_f,
  sum(({psi}) * power(h.e - ev.e, 2)) / nullif(sum({psi}), 0) AS d_e,
  min({hav_sql('h.lon', 'h.lat', 'ev.lon', 'ev.lat')}) AS d_h, min({per_sql('h.yday', 'ev.yday')}) AS d_p, min({per_sql('ev.yday', 'ev.yday + gamma')}) AS big_gamma
  FROM hist h JOIN ev USING (tau){act} CROSS JOIN params{where} GROUP BY ALL),
dist AS (SELECT dist0.*, exp(-d_f / length_scale_f) AS w_f, exp(-d_e / length_scale_e) AS w_e, least(exp(-d_f / length_scale_f), exp(-d_e / length_scale_e)) AS w, xi, kappa_min, kappa_max
  FROM dist0 JOIN params USING (param_id))"""


DIST_SQL = dist_sql()
SEL_SQL = """
s1 AS (SELECT *, w >= xi AS in_sim, count(*) FILTER (WHERE w >= xi) OVER (PARTITION BY event_id, param_id) AS n_sim FROM dist),
s2 AS (SELECT *, in_sim AND (n_sim <= kappa_max OR d_p <= big_gamma) AS in_temporal FROM s1),
s3 AS (SELECT *, in_temporal AND (n_sim <= kappa_max OR row_number() OVER (PARTITION BY event_id, param_id, in_temporal ORDER BY d_h, curve_id) <= kappa_max) AS in_spatial FROM s2),
s4 AS (SELECT *, count(*) FILTER (WHERE in_spatial) OVER (PARTITION BY event_id, param_id) AS n_spatial, rank() OVER (PARTITION BY event_id, param_id ORDER BY w DESC) AS wr FROM s3),
sel AS (SELECT *, CASE WHEN n_sim > kappa_max AND n_spatial >= kappa_min THEN in_spatial WHEN n_sim > kappa_max THEN in_temporal WHEN n_sim < kappa_min THEN wr <= kappa_min ELSE in_sim END AS in_final,
  CASE WHEN n_sim > kappa_max AND n_spatial >= kappa_min THEN max(CASE WHEN in_spatial THEN d_h END) OVER (PARTITION BY event_id, param_id) END AS sigma FROM s4)"""
LIE_X = "(2.5::DOUBLE * (60.0::DOUBLE * nu - 60.0::DOUBLE * (s + 1)) / (60.0::DOUBLE * nu - 60.0::DOUBLE))"
LIE_SQL = f"trust_rate * (CASE WHEN {LIE_X} > 0 THEN -{LIE_X} ELSE 1 - exp({LIE_X}) END + 2.5::DOUBLE) / 3.5::DOUBLE"


def scen_sql(trust: str = LIE_SQL, at: int = T) -> str:
    return f"""
chosen AS (SELECT event_id, param_id, curve_id, w / sum(w) OVER (PARTITION BY event_id, param_id) AS wn FROM sel WHERE in_final),
ahead AS (SELECT curve_id, tau - {at} AS s, f, e FROM hist WHERE tau >= {at}),
scen AS (SELECT event_id, param_id, curve_id, s, f * (1 - ({trust})) + e * ({trust}) AS m, wn FROM chosen JOIN ahead USING (curve_id) JOIN params USING (param_id))"""


def flow_sql(at: int = T, param_rows: list[tuple] = PARAM_ROWS) -> str:
    return ",\n".join([ny_sql(at), params_sql(param_rows), dist_sql(at), SEL_SQL, scen_sql(at=at)])


FLOW_SQL = flow_sql()
SELECT_SQL = ",\n".join([NY_SQL, PARAMS_SQL, DIST_SQL, SEL_SQL])
_BANDS = " UNION ALL ".join(f"SELECT event_id, param_id, s, {a}::DOUBLE AS alpha, quantile_disc(m, {a / 2!r}) AS lower, median(m) AS center, quantile_disc(m, {1 - a / 2!r}) AS upper FROM scen GROUP BY ALL" for a in ALPHAS)
BANDS_SQL = f",\nband AS ({_BANDS}),\nrows_ AS (SELECT band.*, y, e FROM band JOIN truth USING (event_id, s))"
BAND_SQL = FLOW_SQL + BANDS_SQL
IS_SQL = "((upper - lower) + (2 / alpha) * (greatest(lower - y, 0) + greatest(y - upper, 0)))"

UD_SQL = """
ub AS (SELECT min(CAST(ts AS DATE)) AS d0, max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 AS days FROM events),
ucells AS (SELECT CAST(a AS INTEGER) AS asset, CAST(d AS INTEGER) AS day, CAST(h AS INTEGER) AS tau, days FROM range(0, 10) AS x(a), (SELECT days, unnest(range(1, days + 1)) AS d FROM ub) AS y, range(0, 24) AS z(h)),
usum AS (SELECT user_id % 10 AS asset, CAST(ts AS DATE) - d0 + 1 AS day, hour(ts) AS tau, sum(value) AS f FROM events, ub GROUP BY ALL),
ufull AS (SELECT asset, day, tau, days, coalesce(f, 0) AS f FROM ucells LEFT JOIN usum USING (asset, day, tau)),
ue AS (SELECT asset, tau, avg(f) AS e FROM ufull WHERE day <= 20 GROUP BY ALL),
ud AS (SELECT CAST(asset * days + day - 1 AS BIGINT) AS curve_id, asset, day, tau, f, e FROM ufull JOIN ue USING (asset, tau))"""

#: user_day as shares of the asset's largest hour, with a site and a day of the year.
UC_SQL = UD_SQL + """,
uc AS (SELECT curve_id, asset, day, day AS yday, -106 + 0.5::DOUBLE * ((7 * asset) % 25) AS lon, 26 + 0.4::DOUBLE * ((11 * asset) % 25) AS lat, tau, f / capacity AS f, e / capacity AS e
       FROM ud JOIN (SELECT asset, max(f) AS capacity FROM ud GROUP BY asset) AS c USING (asset) WHERE capacity > 0)"""

EMBED_SQL = "emb AS (SELECT CAST(label AS BIGINT) AS set_id, vec_id AS curve_id, CAST(i - 1 AS INTEGER) AS tau, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(i))"
YEARS_SQL = NY_SQL + ",\nyset AS (SELECT CAST(y AS BIGINT) AS set_id, curve_id, tau, f AS v FROM ny)"


# The flow in DataFrames ---------------------------------------------------------------------------


def _sides(spark: SparkSession, sf: str, at: int, param_rows: list[tuple]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nation_year, the weighted events and the packed history, settled: several steps read them."""
    from curvecast.operators import neighbors as N

    ny = settle(nation_year(spark, sf))
    return ny, settle(N.with_weights(events(ny, at), params(spark, param_rows), SLOTS, PER_HOUR)), settle(history(ny))


def scored(spark: SparkSession, sf: str, at: int = T, param_rows: list[tuple] = PARAM_ROWS) -> tuple[DataFrame, DataFrame]:
    """(nation_year, distances of all events and parameter sets to the history)."""
    from curvecast.operators import neighbors as N

    ny, weighted, past = _sides(spark, sf, at, param_rows)
    return ny, N.distances(weighted, past)


def near(spark: SparkSession, sf: str, at: int = T, param_rows: list[tuple] = PARAM_ROWS) -> tuple[DataFrame, DataFrame]:
    """(nation_year, the distances that selection can need)."""
    from curvecast.operators import neighbors as N

    ny, weighted, past = _sides(spark, sf, at, param_rows)
    return ny, N.near(weighted, past)


def selected(spark: SparkSession, sf: str, at: int = T, param_rows: list[tuple] = PARAM_ROWS) -> tuple[DataFrame, DataFrame]:
    from curvecast.operators import neighbors as N

    ny, d = near(spark, sf, at, param_rows)
    return ny, N.select(d)


def scenarios(spark: SparkSession, sf: str, at: int = T, param_rows: list[tuple] = PARAM_ROWS) -> tuple[DataFrame, DataFrame]:
    from curvecast.operators import fuse

    ny, sel = selected(spark, sf, at, param_rows)
    return ny, fuse.scenarios(sel, ny.where(F.col("y") < TEST_YEAR), params(spark, param_rows), at, fuse.lie(MINUTES))


def band_rows(spark: SparkSession, sf: str) -> DataFrame:
    from curvecast.operators import bands, scores

    ny, scen = scenarios(spark, sf)
    return scores.with_truth(bands.ecdf_band(scen, ALPHAS), truth(ny)).join(truth(ny).select("event_id", "s", "e"), ["event_id", "s"])
