"""Queries: distances and joins, neighbour selection, fusion, set aggregates, depths, bands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curvecast.functions import curves as C
from curvecast.operators import bands as B
from curvecast.operators import depth as D
from curvecast.operators import envelope as E
from curvecast.operators import fuse, hist, prep, ranks, site_index, site_pairs
from curvecast.operators import neighbors as N
from curvecast.plans import fixtures as X
from curvecast.plans.registry import query, rounded, sql_rounded
from curvecast.plans.workdir import settle

_DIST = "WITH " + ",\n".join([X.NY_SQL, X.PARAMS_SQL, X.DIST_SQL])
_SEL, _FLOW, _BAND = "WITH " + X.SELECT_SQL, "WITH " + X.FLOW_SQL, "WITH " + X.BAND_SQL
_K = "event_id param_id curve_id"


def _distance(name, column):
    @query(name, sql_rounded(_DIST + f"\nSELECT event_id, param_id, curve_id, {column} FROM dist", column, _K))
    def run(spark, sf):
        return rounded(X.scored(spark, sf)[1].select("event_id", "param_id", "curve_id", column))


for _n, _c in (("join_dist_prefix", "d_f"), ("join_dist_forecast", "d_e"), ("join_dist_geo", "d_h"), ("join_dist_season", "d_p")):
    _distance(_n, _c)


@query("join_dist_matrix", sql_rounded(_DIST + "\nSELECT event_id, param_id, curve_id, d_f, d_e FROM dist", "d_f d_e", _K))
def join_dist_matrix(spark, sf):
    ny = settle(X.nation_year(spark, sf))
    return rounded(N.distances(N.with_weights(X.events(ny), X.params(spark), X.SLOTS, X.PER_HOUR), X.history(ny), product=True).select("event_id", "param_id", "curve_id", "d_f", "d_e"))


_NEAR_KM, _NEAR_DAYS = 250.0, 45
_SITES_SQL = "WITH " + X.SY_SQL + f""",
el AS (SELECT DISTINCT curve_id AS event_id, lon, lat, yday FROM ev), hl AS (SELECT DISTINCT curve_id, lon, lat, yday FROM hist),
ep AS (SELECT DISTINCT lon, lat FROM el), hp AS (SELECT DISTINCT lon AS lon_2, lat AS lat_2 FROM hl),
sp AS (SELECT *, {X.hav_sql("lon", "lat", "lon_2", "lat_2")} AS d_h FROM ep CROSS JOIN hp),
dp AS (SELECT *, {X.per_sql("yday", "yday_2")} AS d_p FROM (SELECT DISTINCT yday FROM el) CROSS JOIN (SELECT DISTINCT yday AS yday_2 FROM hl) WHERE least((yday - yday_2 + 730) % 365, (yday_2 - yday + 730) % 365) <= {_NEAR_DAYS})"""


def _supplier_sides(spark, sf):
    sy = settle(X.supplier_year(spark, sf))
    return X.events(sy), X.history(sy)


@query("join_sites_within", sql_rounded(_SITES_SQL + f"\nSELECT lon, lat, lon_2, lat_2, d_h FROM sp WHERE d_h <= {_NEAR_KM}", "lon lat lon_2 lat_2 d_h"))
def join_sites_within(spark, sf):
    """Suppliers' places near one another, found by cells of the sphere."""
    return rounded(site_pairs.within(*_supplier_sides(spark, sf), _NEAR_KM))


@query("join_days_within", sql_rounded(_SITES_SQL + "\nSELECT CAST(yday AS INTEGER) AS yday, CAST(yday_2 AS INTEGER) AS yday_2, d_p FROM dp", "d_p", "yday yday_2"))
def join_days_within(spark, sf):
    return rounded(site_pairs.days_within(*_supplier_sides(spark, sf), _NEAR_DAYS))


@query("join_near_candidates", sql_rounded(_SITES_SQL + f"\nSELECT event_id, curve_id, d_h, d_p FROM el JOIN dp USING (yday) JOIN sp USING (lon, lat) JOIN hl ON hl.lon = lon_2 AND hl.lat = lat_2 AND hl.yday = yday_2 WHERE d_h <= {_NEAR_KM}", "d_h d_p", "event_id curve_id"))
def join_near_candidates(spark, sf):
    """Events and curves near in place and season, by the two tables of pairs."""
    return rounded(site_pairs.candidates(*_supplier_sides(spark, sf), _NEAR_KM, _NEAR_DAYS))


@query("join_similarity", sql_rounded(_DIST + "\nSELECT event_id, param_id, curve_id, w_f, w_e, w FROM dist", "w_f w_e w", _K))
def join_similarity(spark, sf):
    return rounded(X.scored(spark, sf)[1].select("event_id", "param_id", "curve_id", "w_f", "w_e", "w"))


@query("join_params", "WITH " + X.NY_SQL + ", " + X.PARAMS_SQL + "\nSELECT DISTINCT curve_id AS event_id, param_id, xi, kappa_max FROM ev CROSS JOIN params")
def join_params(spark, sf):
    return X.events(X.nation_year(spark, sf)).select("event_id").crossJoin(F.broadcast(X.params(spark).select("param_id", "xi", "kappa_max")))


@query("join_params_by_time", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS t, m FROM orders JOIN (SELECT month(o_orderdate) AS mm, max(o_totalprice) AS m FROM orders GROUP BY ALL) ON month(o_orderdate) = mm")
def join_params_by_time(spark, sf):
    o = X.t(spark, sf, "orders").select("o_orderkey", F.month("o_orderdate").alias("t"), "o_totalprice")
    return o.join(F.broadcast(o.groupBy("t").agg(F.max("o_totalprice").alias("m"))), "t").select("o_orderkey", "t", "m")


@query("join_truth", sql_rounded(_BAND + "\nSELECT event_id, param_id, alpha, s, y, y - center AS gap FROM rows_", "y gap", "event_id param_id alpha s"))
def join_truth(spark, sf):
    return rounded(X.band_rows(spark, sf).select("event_id", "param_id", "alpha", "s", "y", (F.col("y") - F.col("center")).alias("gap")))


@query("join_intersect_ids", _SEL + "\nSELECT event_id, param_id, curve_id FROM sel WHERE in_sim AND d_p <= big_gamma")
def join_intersect_ids(spark, sf):
    d = X.scored(spark, sf)[1]
    sim = d.where(F.col("w") >= F.col("xi")).select("event_id", "param_id", "curve_id")
    return sim.join(d.where(F.col("d_p") <= F.col("big_gamma")).select("event_id", "param_id", "curve_id"), ["event_id", "param_id", "curve_id"], "left_semi")


_BUCKET = ",\nu AS (SELECT DISTINCT event_id, round(d_h, 6) AS d FROM dist),\nth AS (SELECT event_id, d, row_number() OVER (PARTITION BY event_id ORDER BY d) AS i FROM u),\nbk AS (SELECT d.event_id, d.curve_id, count(t.d) AS bucket FROM (SELECT DISTINCT event_id, curve_id, d_h FROM dist) d LEFT JOIN th t ON t.event_id = d.event_id AND t.i IN (5, 10, 20) AND t.d < round(d.d_h, 6) GROUP BY ALL)"


def _buckets(spark, sf):
    # Site distances don't depend on the parameters: one row for each event and curve.
    d = X.scored(spark, sf)[1].groupBy("event_id", "curve_id").agg(F.round(F.min("d_h"), 6).alias("d_h"))
    ordered = d.groupBy("event_id").agg(F.sort_array(F.collect_set("d_h")).alias("ds"))
    th = ordered.select("event_id", F.filter(F.array(*[F.try_element_at("ds", F.lit(i)) for i in (5, 10, 20)]), lambda x: x.isNotNull()).alias("thresholds"))
    return hist.rank_bucket(d, th, "d_h").select("event_id", "curve_id", F.col("bucket").cast("long").alias("bucket"))


@query("join_distance_rank_bucket", _DIST + _BUCKET + "\nSELECT event_id, curve_id, bucket FROM bk")
def join_distance_rank_bucket(spark, sf):
    return _buckets(spark, sf)


def _years(spark, sf):
    """The yearly sets, settled: pair depths read them several times."""
    return settle(X.year_sets(X.nation_year(spark, sf)))


_PAIRS = "WITH " + X.YEARS_SQL + ",\npr AS (SELECT a.set_id, a.curve_id AS a, b.curve_id AS b, max(abs(a.v - b.v)) AS sup, sum(power(a.v - b.v, 2)) AS l2 FROM yset a JOIN yset b USING (set_id, tau) WHERE a.curve_id <> b.curve_id GROUP BY ALL)"


@query("join_curve_pairs", sql_rounded(_PAIRS + "\nSELECT set_id, a, b, sup, l2 FROM pr WHERE a < b", "sup l2", "set_id a b"))
def join_curve_pairs(spark, sf):
    return rounded(D.curve_pairs(_years(spark, sf)).where("a < b"))


# Neighbour selection ------------------------------------------------------------------------------


def _flag(name, flag):
    @query(name, _SEL + f"\nSELECT event_id, param_id, curve_id FROM sel WHERE {flag}")
    def run(spark, sf):
        return N.select(X.scored(spark, sf)[1]).where(flag).select("event_id", "param_id", "curve_id")


for _n, _c in (("nn_similarity", "in_sim"), ("nn_temporal", "in_temporal")):
    _flag(_n, _c)


@query("nn_spatial_topk", sql_rounded(_SEL + "\nSELECT event_id, param_id, curve_id, sigma FROM sel WHERE in_spatial", "sigma", _K, 4))
def nn_spatial_topk(spark, sf):
    return rounded(X.selected(spark, sf)[1].where("in_spatial").select("event_id", "param_id", "curve_id", "sigma"), 4)


@query("nn_fallback_topk", _SEL + "\nSELECT event_id, param_id, curve_id FROM sel WHERE wr <= kappa_min")
def nn_fallback_topk(spark, sf):
    d = X.near(spark, sf)[1]
    r = F.rank().over(Window.partitionBy(*N.KEYS).orderBy(F.col("w").desc()))
    return d.withColumn("r", r).where(F.col("r") <= F.col("kappa_min")).select("event_id", "param_id", "curve_id")


@query("nn_select", _SEL + "\nSELECT event_id, param_id, curve_id, in_sim, in_temporal, in_spatial, in_final FROM sel WHERE in_sim OR in_final")
def nn_select(spark, sf):
    return N.select(X.scored(spark, sf)[1]).where("in_sim or in_final").select("event_id", "param_id", "curve_id", "in_sim", "in_temporal", "in_spatial", "in_final")


#: Few and wide blocks for as few curves as the given tables have; above _WIDE curves narrower ones, so that a block holds
#: about as many; how many times kappa_max curves an event tries first.
_DEGREES, _SEASON_DAYS, _WIDE, _PROBE = 10.0, 60, 50_000, 50


@query("nn_select_indexed", sql_rounded("WITH " + ",\n".join([X.SY_SQL, X.PARAMS_SQL, X.DIST_SQL, X.SEL_SQL]) + "\nSELECT event_id, param_id, curve_id, sigma FROM sel WHERE in_final", "sigma", _K, 4))
def nn_select_indexed(spark, sf):
    """Selection among suppliers' years through the index of places and seasons."""
    sy = settle(X.supplier_year(spark, sf))
    past = settle(X.history(sy))
    degrees = max(1.0, _DEGREES / max(1.0, past.count() / _WIDE) ** 0.5)
    found = site_index.near(N.with_weights(X.events(sy), X.params(spark), X.SLOTS, X.PER_HOUR), past, settle, degrees, _SEASON_DAYS, _PROBE)
    return rounded(N.select(found).where("in_final").select("event_id", "param_id", "curve_id", "sigma"), 4)


def _older(grow: bool) -> str:
    status = "CASE WHEN c < kappa_min THEN 4 ELSE 2 * bd + fr END" if grow else "CASE WHEN c < kappa_min OR fr = 1 THEN 2 ELSE bd END"
    p = "PARTITION BY event_id, param_id"
    return (
        "WITH "
        + ",\n".join([X.NY_SQL, X.PARAMS_SQL, X.DIST_SQL])
        + f""",
a1 AS (SELECT *, count(*) FILTER (WHERE w >= xi) OVER ({p}) AS n, count(*) FILTER (WHERE w >= xi AND d_p <= big_gamma) OVER ({p}) AS dn FROM dist),
a2 AS (SELECT *, CAST(n > kappa_max AND dn > kappa_min AS INTEGER) AS bd FROM a1),
a3 AS (SELECT *, w >= xi AND (bd = 0 OR d_p <= big_gamma) AS k FROM a2),
a4 AS (SELECT *, count(*) FILTER (WHERE k) OVER ({p}) AS m, row_number() OVER ({p}, k ORDER BY d_h, curve_id) - 1 AS i FROM a3),
a5 AS (SELECT *, CAST(m > kappa_max AS INTEGER) AS fr, max(CASE WHEN k AND i = kappa_max THEN d_h END) OVER ({p}) AS sg FROM a4),
a6 AS (SELECT *, k AND (fr = 0 OR d_h <= sg) AS k2, row_number() OVER ({p} ORDER BY w DESC, curve_id) - 1 AS wi FROM a5),
a7 AS (SELECT *, count(*) FILTER (WHERE k2) OVER ({p}) AS c, max(CASE WHEN wi = kappa_min THEN w END) OVER ({p}) AS wt FROM a6)
SELECT event_id, param_id, curve_id, CAST({status} AS INTEGER) AS status FROM a7 WHERE CASE WHEN c < kappa_min THEN w >= wt ELSE k2 END"""
    )


@query("nn_select_v2", _older(True))
def nn_select_v2(spark, sf):
    return N.select_by_order(X.scored(spark, sf)[1], grow=True).where("in_final").select("event_id", "param_id", "curve_id", "status")


@query("nn_select_v1", _older(False))
def nn_select_v1(spark, sf):
    return N.select_by_order(X.scored(spark, sf)[1], grow=False).where("in_final").select("event_id", "param_id", "curve_id", "status")


@query("nn_stage_counts", _SEL + "\nSELECT event_id, param_id, count(*) FILTER (WHERE in_sim) AS n_sim, count(*) FILTER (WHERE in_temporal) AS n_temporal, count(*) FILTER (WHERE in_spatial) AS n_spatial, count(*) FILTER (WHERE in_final) AS n_scenarios FROM sel GROUP BY ALL")
def nn_stage_counts(spark, sf):
    return N.stage_counts(N.select(X.scored(spark, sf)[1]))


@query("nn_rank_for_display", sql_rounded(_SEL + ", g AS (SELECT event_id, param_id, min(w) AS lo, max(w) AS hi FROM sel WHERE in_final GROUP BY ALL)\nSELECT event_id, param_id, curve_id, CASE WHEN hi > lo THEN (w - lo) / (hi - lo) ELSE 0 END AS scaled, CAST(row_number() OVER (PARTITION BY event_id, param_id ORDER BY w DESC, curve_id) AS INTEGER) AS place FROM sel JOIN g USING (event_id, param_id) WHERE in_final", "scaled", _K + " place"))
def nn_rank_for_display(spark, sf):
    return rounded(N.display_rank(X.selected(spark, sf)[1]))


# Fusion and set aggregates ------------------------------------------------------------------------


@query("fc_fuse_scenarios", sql_rounded(_FLOW + "\nSELECT event_id, param_id, curve_id, s, m FROM scen", "m", _K + " s"))
def fc_fuse_scenarios(spark, sf):
    return rounded(X.scenarios(spark, sf)[1].select("event_id", "param_id", "curve_id", "s", "m"))


@query("fc_norm_weights", sql_rounded(_FLOW + "\nSELECT event_id, param_id, curve_id, wn FROM chosen", "wn", _K))
def fc_norm_weights(spark, sf):
    return rounded(X.scenarios(spark, sf)[1].where("s = 0").select("event_id", "param_id", "curve_id", "wn"))


@query("fc_focal_curve", sql_rounded(_FLOW + "\nSELECT event_id, param_id, s, sum(wn * m) AS focal FROM scen GROUP BY ALL", "focal", "event_id param_id s"))
def fc_focal_curve(spark, sf):
    return rounded(fuse.focal_curve(X.scenarios(spark, sf)[1]))


@query("fc_median_curve", sql_rounded(_FLOW + "\nSELECT event_id, param_id, s, median(m) AS median FROM scen GROUP BY ALL", "median", "event_id param_id s"))
def fc_median_curve(spark, sf):
    return rounded(fuse.median_curve(X.scenarios(spark, sf)[1]))


@query("fc_anchor", sql_rounded(_SEL + "\nSELECT event_id, param_id, curve_id, f AS m_0 FROM sel JOIN (SELECT curve_id, f FROM hist WHERE tau = 5) USING (curve_id) WHERE in_final", "m_0", _K))
def fc_anchor(spark, sf):
    ny, sel = X.selected(spark, sf)
    return rounded(fuse.anchors(sel, ny.where("y < 2000"), X.T).select("event_id", "param_id", "curve_id", "m_0"))


@query("fc_dynamic_update", sql_rounded(_FLOW + "\nSELECT event_id, param_id, s, count(*) AS n_scenarios, min(m) AS low, sum(wn * m) AS focal, median(m) AS median, max(m) AS high FROM scen GROUP BY ALL", "low focal median high", "event_id param_id s n_scenarios"))
def fc_dynamic_update(spark, sf):
    """Flagship: event, distances, selection, scenarios, and the set's summary per lead."""
    scen = X.scenarios(spark, sf)[1]
    return rounded(scen.groupBy("event_id", "param_id", "s").agg(F.count(F.lit(1)).alias("n_scenarios"), F.min("m").alias("low"), F.sum(F.col("wn") * F.col("m")).alias("focal"), F.percentile("m", 0.5).alias("median"), F.max("m").alias("high")))


_LOGI = "1 - 1 / (1 + exp(6.906754778648554 * (60 * (s + 1) - 60 * nu) / (30.0::DOUBLE * 4)))"


@query("fc_dynamic_update_logistic", sql_rounded("WITH " + ",\n".join([X.SELECT_SQL, X.scen_sql(_LOGI)]) + "\nSELECT event_id, param_id, s, count(*) AS n, sum(wn * m) AS focal FROM scen GROUP BY ALL", "focal", "event_id param_id s n"))
def fc_dynamic_update_logistic(spark, sf):
    ny, sel = X.selected(spark, sf)
    trust = C.logistic(60 * (F.col("s") + 1) - 60 * F.col("nu"), 4.0)
    scen = fuse.scenarios(sel, ny.where("y < 2000"), X.params(spark), X.T, trust)
    return rounded(scen.groupBy("event_id", "param_id", "s").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wn") * F.col("m")).alias("focal")))


def _masks(ny):
    """event_id, active: each event's flags by slot, by the curves less than ten days from its own day of the year."""
    ev = X.events(ny)
    return prep.mask_arrays(ev, prep.active_slots_window(ny.where(F.col("y") < X.TEST_YEAR), ev, _DAYS, _OVER), X.SLOTS)


_DAYS, _OVER = 10, 2.2
_MASK_SQL = f"""
act0 AS (SELECT d.event_id, h.tau, sum(h.f) > {_OVER} AS active FROM hist h JOIN (SELECT DISTINCT curve_id AS event_id, yday FROM ev) AS d ON abs(h.yday - d.yday) < {_DAYS} GROUP BY ALL),
actf AS (SELECT ev.curve_id AS event_id, ev.tau, coalesce(active, true) AS active FROM ev LEFT JOIN act0 ON act0.event_id = ev.curve_id AND act0.tau = ev.tau)"""
_MASKED = "WITH " + ",\n".join([X.NY_SQL, X.PARAMS_SQL, _MASK_SQL, X.dist_sql(masked=True), X.SEL_SQL, X.scen_sql()])


@query("fc_dynamic_update_masked", sql_rounded(_MASKED + f"\nSELECT scen.event_id, param_id, s, count(*) AS n_scenarios, sum(wn * m) AS focal, median(m) AS median FROM scen JOIN actf ON actf.event_id = scen.event_id AND actf.tau = s + {X.T} WHERE active GROUP BY ALL", "focal median", "event_id param_id s n_scenarios"))
def fc_dynamic_update_masked(spark, sf):
    """The update with each event's inactive slots out of the distances and out of the slots ahead."""
    ny = settle(X.nation_year(spark, sf))
    ev = settle(_masks(ny))
    params = X.params(spark)
    sel = N.select(N.near(settle(N.with_weights(ev, params, X.SLOTS, X.PER_HOUR)), settle(X.history(ny))))
    scen = fuse.scenarios(sel, ny.where(F.col("y") < X.TEST_YEAR), params, X.T, fuse.lie(X.MINUTES), ev.select("event_id", "active"))
    return rounded(scen.groupBy("event_id", "param_id", "s").agg(F.count(F.lit(1)).alias("n_scenarios"), F.sum(F.col("wn") * F.col("m")).alias("focal"), F.percentile("m", 0.5).alias("median")))


#: Minutes of a slot (twelve a day) and the steepness by which trust passes from scenarios to the day-ahead forecast.
_SLOT_MINUTES, _STEEP = 120, 24.0
_ADAPT_SQL = f"nus AS (SELECT curve_id AS event_id, greatest(875, 2750 * sqrt(sqrt(avg(CASE WHEN tau < {X.T} THEN power(f - e, 2) END)))) AS nu_own FROM ev GROUP BY curve_id)"
_ADAPT_TRUST = f"1 - 1 / (1 + exp(6.906754778648554 * ({_SLOT_MINUTES} * (s + 1) - nu_own) / (30.0::DOUBLE * {_STEEP})))"


@query("fc_dynamic_update_adaptive", sql_rounded("WITH " + ",\n".join([X.SELECT_SQL, _ADAPT_SQL, X.scen_sql(_ADAPT_TRUST).replace("JOIN params USING (param_id)", "JOIN params USING (param_id) JOIN nus USING (event_id)")]) + "\nSELECT event_id, param_id, s, count(*) AS n, sum(wn * m) AS focal FROM scen GROUP BY ALL", "focal", "event_id param_id s n"))
def fc_dynamic_update_adaptive(spark, sf):
    """The logistic update with each event's own nu, by the error of its day-ahead forecast so far."""
    ny, sel = X.selected(spark, sf)
    d = F.col("f") - F.col("e")
    so_far = ny.where((F.col("y") >= X.TEST_YEAR) & (F.col("tau") < X.T))
    own = so_far.groupBy(F.col("curve_id").alias("event_id")).agg(C.adaptive_nu(F.avg(d * d)).alias("nu_own"))
    trust = C.logistic(_SLOT_MINUTES * (F.col("s") + 1) - F.col("nu_own"), _STEEP)
    scen = fuse.scenarios(sel, ny.where(F.col("y") < X.TEST_YEAR), X.params(spark), X.T, trust, own)
    return rounded(scen.groupBy("event_id", "param_id", "s").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wn") * F.col("m")).alias("focal")))


@query("fc_weighted_cov", sql_rounded(_FLOW + ", mu AS (SELECT event_id, param_id, s, sum(wn * m) AS u FROM scen GROUP BY ALL), c AS (SELECT scen.*, m - u AS d FROM scen JOIN mu USING (event_id, param_id, s))\nSELECT a.event_id, a.param_id, a.s AS s1, b.s AS s2, sum(a.wn * a.d * b.d) AS cov FROM c a JOIN c b ON a.event_id = b.event_id AND a.param_id = b.param_id AND a.curve_id = b.curve_id AND a.s <= b.s GROUP BY ALL", "cov", "event_id param_id s1 s2", 8))
def fc_weighted_cov(spark, sf):
    return rounded(fuse.weighted_cov(X.scenarios(spark, sf)[1]), 8)


_QS = [0.025, 0.05, 0.1, 0.2, 0.5, 0.8, 0.9, 0.95, 0.975]


_RIBBON = ", ".join(f"quantile_cont(f, {q}) AS q{i}" for i, q in enumerate(_QS))


@query("agg_quantile_ribbon", sql_rounded("WITH " + X.UD_SQL + f",\nmeans AS (SELECT asset, day, avg(f) AS f FROM ud GROUP BY ALL)\nSELECT 'slot' AS form, -1 AS day, tau, {_RIBBON} FROM ud GROUP BY tau UNION ALL SELECT 'day', day, tau, {_RIBBON} FROM ud GROUP BY day, tau UNION ALL SELECT 'daily_mean', day, -1, {_RIBBON} FROM means GROUP BY day", " ".join(f"q{i}" for i in range(9)), "form day tau"))
def agg_quantile_ribbon(spark, sf):
    """Quantiles by slot over all curves, by slot of each day over the assets, and of the assets' daily means."""
    ud, none, out = settle(X.user_day(spark, sf)), F.lit(-1), None
    means = ud.groupBy("asset", "day").agg(F.avg("f").alias("f"))
    for form, rows, day, tau in (("slot", ud, none, F.col("tau")), ("day", ud, F.col("day"), F.col("tau")), ("daily_mean", means, F.col("day"), none)):
        p = ranks.quantiles(rows.select(day.alias("day"), tau.alias("tau"), "f"), ["day", "tau"], "f", _QS)
        one = p.select(F.lit(form).alias("form"), "day", "tau", *[F.col("q")[i].alias(f"q{i}") for i in range(9)])
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("agg_daily_mean", sql_rounded("WITH " + X.UD_SQL + "\nSELECT asset, day, avg(f) AS mean FROM ud GROUP BY ALL", "mean", "asset day"))
def agg_daily_mean(spark, sf):
    return rounded(X.user_day(spark, sf).groupBy("asset", "day").agg(F.avg("f").alias("mean")))


# Depths over the embedding sets (one per label), pair depths over the yearly sets -----------------

_RANK = "WITH " + X.EMBED_SQL + ",\nrk AS (SELECT *, rank() OVER (PARTITION BY set_id, tau ORDER BY v) - 1 AS b, rank() OVER (PARTITION BY set_id, tau ORDER BY v DESC) - 1 AS a, count(*) OVER (PARTITION BY set_id, tau) AS n FROM emb)"
_SC = "set_id curve_id"


@query("depth_mbd", sql_rounded(_RANK + "\nSELECT set_id, curve_id, avg(1 - (b * (b - 1) / 2 + a * (a - 1) / 2) / (n * (n - 1) / 2)) AS depth FROM rk GROUP BY ALL", "depth", _SC))
def depth_mbd(spark, sf):
    return rounded(D.mbd(X.embed(spark, sf)))


_BD = "WITH " + X.YEARS_SQL + """,
sd AS (SELECT a.set_id, a.curve_id AS c, b.curve_id AS o, a.tau, sign(b.v - a.v) AS g FROM yset a JOIN yset b USING (set_id, tau)),
pp AS (SELECT x.set_id, x.c, x.o AS i, y.o AS j, bool_and(x.g * y.g <= 0) AS holds FROM sd x JOIN sd y ON x.set_id = y.set_id AND x.c = y.c AND x.tau = y.tau AND x.o < y.o GROUP BY ALL)"""


@query("depth_bd", sql_rounded(_BD + "\nSELECT set_id, c AS curve_id, avg(CASE WHEN holds THEN 1.0::DOUBLE ELSE 0 END) AS depth FROM pp GROUP BY ALL", "depth", _SC))
def depth_bd(spark, sf):
    return rounded(D.band(_years(spark, sf)))


def _dq_sql(src: str, keys: str, q: float) -> str:
    return f"st AS (SELECT {keys}, tau, avg(v) AS mu, quantile_cont(v, {q!r}) AS lo, quantile_cont(v, {1 - q!r}) AS hi FROM {src} GROUP BY ALL),\ndq AS (SELECT {keys}, curve_id, max(abs(v - mu) / CASE WHEN CASE WHEN v >= mu THEN hi - mu ELSE mu - lo END = 0 THEN 2.220446049250313e-16 ELSE CASE WHEN v >= mu THEN hi - mu ELSE mu - lo END END) AS depth FROM {src} JOIN st USING ({keys}, tau) GROUP BY ALL)"


@query("depth_dq", sql_rounded("WITH " + X.EMBED_SQL + ",\n" + _dq_sql("emb", "set_id", 0.05) + "\nSELECT set_id, curve_id, depth FROM dq", "depth", _SC))
def depth_dq(spark, sf):
    return rounded(D.directional_quantile(X.embed(spark, sf), 0.05))


@query("depth_dq_multi", sql_rounded("WITH " + X.EMBED_SQL + "".join(",\n" + _dq_sql("emb", "set_id", q).replace("st AS", f"st{i} AS").replace("dq AS", f"dq{i} AS").replace("JOIN st USING", f"JOIN st{i} USING") for i, q in enumerate((0.05, 0.1, 0.15))) + "\nSELECT set_id, curve_id, dq0.depth AS dq_1, dq1.depth AS dq_2, dq2.depth AS dq_3 FROM dq0 JOIN dq1 USING (set_id, curve_id) JOIN dq2 USING (set_id, curve_id)", "dq_1 dq_2 dq_3", _SC))
def depth_dq_multi(spark, sf):
    return rounded(D.directional_quantiles(X.embed(spark, sf), (0.05, 0.1, 0.15)))


@query("depth_erl", sql_rounded(_RANK + ", l AS (SELECT set_id, curve_id, list(least(b, a) + 1 ORDER BY least(b, a)) AS r FROM rk GROUP BY ALL)\nSELECT set_id, curve_id, rank() OVER (PARTITION BY set_id ORDER BY r) / count(*) OVER (PARTITION BY set_id) AS depth FROM l", "depth", _SC))
def depth_erl(spark, sf):
    return rounded(D.extreme_rank_length(X.embed(spark, sf)))


@query("depth_ed", sql_rounded(_RANK + ", l AS (SELECT set_id, curve_id, list(round(1 - abs(a - b) / n, 12) ORDER BY round(1 - abs(a - b) / n, 12)) AS r FROM rk GROUP BY ALL)\nSELECT set_id, curve_id, cume_dist() OVER (PARTITION BY set_id ORDER BY r) AS depth FROM l", "depth", _SC))
def depth_ed(spark, sf):
    return rounded(D.extremal(X.embed(spark, sf)))


@query("depth_id", sql_rounded("WITH " + X.EMBED_SQL + ", c AS (SELECT *, 1 - abs(0.5::DOUBLE - cume_dist() OVER (PARTITION BY set_id, tau ORDER BY v)) AS p FROM emb)\nSELECT set_id, curve_id, avg(p) AS depth FROM c GROUP BY ALL", "depth", _SC, 9))
def depth_id(spark, sf):
    return rounded(D.integrated(X.embed(spark, sf)), 9)


@query("depth_linf", sql_rounded(_PAIRS + "\nSELECT set_id, a AS curve_id, 1 / (1 + avg(sup)) AS depth FROM pr GROUP BY ALL", "depth", _SC))
def depth_linf(spark, sf):
    return rounded(D.l_infinity(_years(spark, sf)))


@query("depth_mode", sql_rounded(_PAIRS + ", h AS (SELECT set_id, quantile_cont(sqrt(l2), 0.15) AS h FROM pr GROUP BY ALL)\nSELECT set_id, a AS curve_id, sum(exp(-0.5::DOUBLE * power(sqrt(l2) / h, 2))) AS depth FROM pr JOIN h USING (set_id) GROUP BY ALL", "depth", _SC))
def depth_mode(spark, sf):
    return rounded(D.modal(_years(spark, sf)))


@query("depth_rp")
def depth_rp(spark, sf):
    return rounded(D.random_projection(X.embed(spark, sf)))


@query("depth_rt")
def depth_rt(spark, sf):
    return rounded(D.random_tukey(X.embed(spark, sf)))


@query("depth_msplot", sql_rounded("WITH " + X.EMBED_SQL + ", md AS (SELECT set_id, tau, median(v) AS med FROM emb GROUP BY ALL), dv AS (SELECT emb.*, v - med AS d FROM emb JOIN md USING (set_id, tau)), mad AS (SELECT set_id, tau, 1.4826::DOUBLE * median(abs(d)) AS mad FROM dv GROUP BY ALL), o AS (SELECT set_id, curve_id, CASE WHEN mad > 0 THEN d / mad END AS o FROM dv JOIN mad USING (set_id, tau))\nSELECT set_id, curve_id, avg(o) AS magnitude, var_pop(o) AS shape FROM o GROUP BY ALL", "magnitude shape", _SC))
def depth_msplot(spark, sf):
    return rounded(D.magnitude_shape(X.embed(spark, sf)))


@query("depth_outliergram", sql_rounded(_RANK + "\nSELECT set_id, curve_id, avg(1 - (b * (b - 1) / 2 + a * (a - 1) / 2) / (n * (n - 1) / 2)) AS mbd, avg((n - b) / n) AS mei FROM rk GROUP BY ALL", "mbd mei", _SC, 9))
def depth_outliergram(spark, sf):
    return rounded(D.outliergram(X.embed(spark, sf)), 9)


@query("depth_registry")
def depth_registry(spark, sf):
    """Every registered depth: pair depths over the yearly sets, the others over the embedding sets."""
    embed, years = X.embed(spark, sf), settle(X.year_sets(X.nation_year(spark, sf)))
    out = None
    for name, depth in D.REGISTRY.items():
        x = years if name in ("BD", "LD", "MD") else embed
        one = depth(x).select("set_id", "curve_id", F.lit(name).alias("name"), F.col("depth").cast("double").alias("depth"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("sort_depth_order", _RANK + ", d AS (SELECT set_id, curve_id, round(avg(1 - (b * (b - 1) / 2 + a * (a - 1) / 2) / (n * (n - 1) / 2)), 9) AS depth FROM rk GROUP BY ALL)\nSELECT set_id, curve_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY depth DESC, curve_id) AS INTEGER) AS place FROM d")
def sort_depth_order(spark, sf):
    d = D.mbd(X.embed(spark, sf)).withColumn("depth", F.round("depth", 9))
    return D.order_by_depth(d).select("set_id", "curve_id", "place")


# Bands --------------------------------------------------------------------------------------------


@query("q_ecdf", "WITH " + X.UD_SQL + "\nSELECT asset, tau, " + ", ".join(f"round(quantile_disc(f, {q}), 6) + 0.0 AS q{i}" for i, q in enumerate(_QS)) + " FROM ud GROUP BY ALL")
def q_ecdf(spark, sf):
    found = ranks.quantiles(X.user_day(spark, sf), ["asset", "tau"], "f", _QS, discrete=True)
    return rounded(found.select("asset", "tau", *[F.col("q")[i].alias(f"q{i}") for i in range(len(_QS))]))


@query("band_ecdf", sql_rounded(_BAND + "\nSELECT event_id, param_id, alpha, s, lower, center, upper FROM band", "lower center upper", "event_id param_id alpha s"))
def band_ecdf(spark, sf):
    return rounded(B.ecdf_band(X.scenarios(spark, sf)[1], X.ALPHAS))


_SETS = ",\nst0 AS (SELECT event_id, param_id, curve_id, s AS tau, m AS v FROM scen),\nrks AS (SELECT *, rank() OVER (PARTITION BY event_id, param_id, tau ORDER BY v) - 1 AS b, rank() OVER (PARTITION BY event_id, param_id, tau ORDER BY v DESC) - 1 AS a, count(*) OVER (PARTITION BY event_id, param_id, tau) AS n FROM st0)"
_MBD_SET = ",\ndd AS (SELECT event_id, param_id, curve_id, round(avg(1 - (b * (b - 1) / 2 + a * (a - 1) / 2) / nullif(n * (n - 1) / 2, 0)), 9) AS depth FROM rks GROUP BY ALL)"


def _trim_sql(alpha: float, zeta: float = 1.0) -> str:
    return f",\nkr AS (SELECT *, row_number() OVER (PARTITION BY event_id, param_id ORDER BY depth, curve_id) AS r, count(*) OVER (PARTITION BY event_id, param_id) AS nn FROM dd),\nkeep AS (SELECT event_id, param_id, curve_id FROM kr WHERE r > floor(nn * {zeta}::DOUBLE * {alpha}::DOUBLE))\nSELECT event_id, param_id, s, min(m) AS lower, avg(m) AS center, max(m) AS upper FROM scen JOIN keep USING (event_id, param_id, curve_id) GROUP BY ALL"


_BK = "event_id param_id s"


def _round_depth(fn):
    return lambda x: fn(x).withColumn("depth", F.round("depth", 9))


def _trimmed(spark, sf, fn, alpha, zeta=1.0):
    return rounded(B.depth_band(X.scenarios(spark, sf)[1], _round_depth(fn), alpha, zeta).select("event_id", "param_id", "s", "lower", "center", "upper"))


_DQ_SET = ",\n" + _dq_sql("st0", "event_id, param_id", 0.1).replace("dq AS", "dq0 AS") + ",\ndd AS (SELECT event_id, param_id, curve_id, round(-depth, 9) AS depth FROM dq0)"


@query("band_dq", sql_rounded(_FLOW + _SETS + _DQ_SET + _trim_sql(0.2), "lower center upper", _BK))
def band_dq(spark, sf):
    return _trimmed(spark, sf, lambda x: D.directional_quantile(x, 0.1, bounded=True).withColumn("depth", -F.col("depth")), 0.2)


@query("band_mbd", sql_rounded(_FLOW + _SETS + _MBD_SET + _trim_sql(0.2, 1.5), "lower center upper", _BK))
def band_mbd(spark, sf):
    return _trimmed(spark, sf, D.mbd, 0.2, 1.5)


@query("band_depth", sql_rounded(_FLOW + _SETS + ",\nci AS (SELECT *, 1 - abs(0.5::DOUBLE - cume_dist() OVER (PARTITION BY event_id, param_id, tau ORDER BY v)) AS p FROM st0),\ndd AS (SELECT event_id, param_id, curve_id, round(avg(p), 9) AS depth FROM ci GROUP BY ALL)" + _trim_sql(0.3), "lower center upper", _BK))
def band_depth(spark, sf):
    return _trimmed(spark, sf, D.integrated, 0.3)


@query("band_dq_threshold", sql_rounded(_FLOW + _SETS + ",\n" + _dq_sql("st0", "event_id, param_id", 0.1) + "\nSELECT event_id, param_id, s, min(m) AS lower, max(m) AS upper FROM scen JOIN dq USING (event_id, param_id, curve_id) WHERE depth <= 1 GROUP BY ALL", "lower upper", _BK))
def band_dq_threshold(spark, sf):
    return rounded(B.dq_threshold_band(X.scenarios(spark, sf)[1], 0.2))


_KDE = """,
kd AS (SELECT event_id, param_id, s, i, i / 99.0::DOUBLE AS x, sum(exp(-0.5::DOUBLE * power((i / 99.0::DOUBLE - m) / 0.05::DOUBLE, 2))) AS p FROM scen, range(0, 100) AS r(i) GROUP BY ALL),
kc AS (SELECT *, sum(p) OVER (PARTITION BY event_id, param_id, s ORDER BY i) / sum(p) OVER (PARTITION BY event_id, param_id, s) AS c FROM kd),
kl AS (SELECT *, lag(c) OVER (PARTITION BY event_id, param_id, s ORDER BY i) AS c0, lag(x) OVER (PARTITION BY event_id, param_id, s ORDER BY i) AS x0 FROM kc)"""


def _inv_sql(q: float) -> str:
    return f"min(CASE WHEN c >= {q}::DOUBLE AND coalesce(c0, -1) < {q}::DOUBLE THEN CASE WHEN c0 IS NULL THEN x ELSE x0 + ({q}::DOUBLE - c0) / (c - c0) * (x - x0) END END)"


@query("band_kde", sql_rounded(_FLOW + _KDE + f"\nSELECT event_id, param_id, s, {_inv_sql(0.1)} AS lower, {_inv_sql(0.9)} AS upper FROM kl GROUP BY ALL", "lower upper", _BK))
def band_kde(spark, sf):
    return rounded(B.kde_band(X.scenarios(spark, sf)[1], 0.2, 0.05, 100))


_WIDTH = """,
kw AS (SELECT event_id, param_id, s, greatest(0.9::DOUBLE * least(stddev_pop(m), (quantile_cont(m, 0.75) - quantile_cont(m, 0.25)) / 1.34::DOUBLE) * power(count(*), -0.2::DOUBLE), 1 / 999.0::DOUBLE) AS width FROM scen GROUP BY ALL),
kd AS (SELECT event_id, param_id, s, i, i / 999.0::DOUBLE AS x, sum(exp(-0.5::DOUBLE * power((i / 999.0::DOUBLE - m) / width, 2))) AS p FROM scen JOIN kw USING (event_id, param_id, s), range(0, 1000) AS r(i) GROUP BY ALL),"""


@query("band_kde_silverman", sql_rounded(_FLOW + _WIDTH + _KDE[_KDE.index("\nkc AS"):] + f"\nSELECT event_id, param_id, s, {_inv_sql(0.1)} AS lower, {_inv_sql(0.9)} AS upper FROM kl GROUP BY ALL", "lower upper", _BK))
def band_kde_silverman(spark, sf):
    """On the full grid, each lead with the width of its own scenarios."""
    return rounded(B.kde_band(X.scenarios(spark, sf)[1], 0.2))


def _smooth_sql(step: int) -> str:
    """The smoother is a fixed matrix of the grid; the table of it is given, the sums are SQL."""
    leads = X.SLOTS - X.T
    matrix = E.spline_smoother(leads + 1, E.smooth_grid(leads, step), 6)
    values = ", ".join(f"({i}, {j - 1}, {float(v)!r}::DOUBLE)" for i, row in enumerate(matrix) for j, v in enumerate(row))
    return f"SELECT {step} AS step, event_id, param_id, curve_id, CAST(i AS INTEGER) AS s, sum(c * m) AS m FROM begun JOIN (VALUES {values}) AS b(i, s, c) USING (s) GROUP BY ALL"


@query("curve_smooth_downsample", sql_rounded(_FLOW + ",\nbegun AS (SELECT event_id, param_id, curve_id, s, m FROM scen UNION ALL SELECT event_id, param_id, curve_id, -1, f FROM (SELECT DISTINCT event_id, param_id, curve_id FROM scen) JOIN (SELECT curve_id AS event_id, f FROM ev WHERE tau = 5) USING (event_id))\n" + _smooth_sql(1) + " UNION ALL " + _smooth_sql(2), "m", "step event_id param_id curve_id s"))
def curve_smooth_downsample(spark, sf):
    """Smoothed scenarios on the full grid (step 1) and on every second lead."""
    ny, scen = X.scenarios(spark, sf)
    scen, last = settle(scen), X.events(ny).select("event_id", F.element_at("f", -1).alias("v"))
    both = [E.smooth(scen, last, X.SLOTS - X.T, step).withColumn("step", F.lit(step)) for step in (1, 2)]
    return rounded(both[0].unionByName(both[1]))


def _scen_with_w(spark, sf):
    return X.scenarios(spark, sf)[1].withColumnRenamed("wn", "w")


@query("env_focal")
def env_focal(spark, sf):
    return E.focal_envelope(_scen_with_w(spark, sf), "l2")


@query("env_focal_depths")
def env_focal_depths(spark, sf):
    """Envelopes by each depth that they can be built with."""
    scen, out = settle(_scen_with_w(spark, sf)), None
    for name in sorted(E.DEPTHS):
        one = E.focal_envelope(scen, "l2", name).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_FOCAL = _FLOW + _SETS + _MBD_SET + ",\nfo AS (SELECT event_id, param_id, curve_id AS focal_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id, param_id ORDER BY depth DESC, curve_id) AS r FROM dd) WHERE r = 1),\nfm AS (SELECT event_id, param_id, s, focal_id, m AS fm FROM scen JOIN fo USING (event_id, param_id) WHERE curve_id = focal_id)"


@query("env_distance", sql_rounded(_FOCAL + "\nSELECT event_id, param_id, curve_id, focal_id, max(abs(m - fm)) AS sup, sum(power(m - fm, 2)) AS l2 FROM scen JOIN fm USING (event_id, param_id, s) GROUP BY ALL", "sup l2", _K + " focal_id"))
def env_distance(spark, sf):
    scen = X.scenarios(spark, sf)[1]
    return rounded(E.focal_distances(scen, _round_depth(D.mbd)(B.as_sets(scen))))


@query("band_functional", sql_rounded(_FLOW + _SETS + _MBD_SET + ",\npl AS (SELECT *, row_number() OVER (PARTITION BY event_id, param_id ORDER BY depth DESC, curve_id) - 1 AS place, floor(0.6::DOUBLE * count(*) OVER (PARTITION BY event_id, param_id)) AS k FROM dd)\nSELECT event_id, param_id, s, max(CASE WHEN place = 0 THEN m END) AS center, min(CASE WHEN place >= 1 AND place < k THEN m END) AS lower, max(CASE WHEN place >= 1 AND place < k THEN m END) AS upper FROM scen JOIN pl USING (event_id, param_id, curve_id) GROUP BY ALL", "center lower upper", _BK))
def band_functional(spark, sf):
    scen = X.scenarios(spark, sf)[1]
    d = _round_depth(D.mbd)(B.as_sets(scen))
    placed = D.order_by_depth(d).select(F.col("set_id.event_id").alias("event_id"), F.col("set_id.param_id").alias("param_id"), "curve_id", (F.col("place") - 1).alias("place"))
    sizes = scen.groupBy("event_id", "param_id").agg(F.count_distinct("curve_id").alias("n_scenarios"))
    return rounded(E.functional_bands(scen, placed, sizes, [0.6]).drop("fraction"))
