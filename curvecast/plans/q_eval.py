"""Queries: scores, histograms, experiments and tuning, functional PCA, streaming."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from curvecast.functions import curves as C
from curvecast.operators import bands as B
from curvecast.operators import envelope as E
from curvecast.operators import fpca, fuse, hist, prep, scores, tuning
from curvecast.operators import neighbors as N
from curvecast.plans import fixtures as X
from curvecast.plans.q_flow import _BUCKET, _MBD_SET, _SETS, _buckets, _dq_sql
from curvecast.plans.q_prep import _cdf_sql
from curvecast.plans.registry import query, rounded, sql_rounded
from curvecast.plans.workdir import new_path, settle, settle_last
from curvecast.streaming import state, updates

_FLOW, _BAND, _SEL = "WITH " + X.FLOW_SQL, "WITH " + X.BAND_SQL, "WITH " + X.SELECT_SQL
_EP = "event_id param_id"
_IN = "CASE WHEN y >= lower AND y <= upper THEN 1.0::DOUBLE ELSE 0 END"


# Scores -------------------------------------------------------------------------------------------


@query("score_interval", sql_rounded(_BAND + f"\nSELECT event_id, param_id, alpha, avg({X.IS_SQL}) AS score FROM rows_ GROUP BY ALL", "score", "event_id param_id alpha"))
def score_interval(spark, sf):
    return rounded(scores.interval_score(X.band_rows(spark, sf)))


_WIS = f"wl AS (SELECT event_id, param_id, s, (0.5::DOUBLE * max(abs(y - center)) + sum(alpha / 2 * {X.IS_SQL})) / (count(*) + 0.5::DOUBLE) AS w FROM rows_ GROUP BY ALL),\nwis AS (SELECT event_id, param_id, avg(w) AS wis FROM wl GROUP BY ALL)"


@query("score_wis", sql_rounded(_BAND + ",\n" + _WIS + "\nSELECT event_id, param_id, wis FROM wis", "wis", _EP))
def score_wis(spark, sf):
    return rounded(scores.weighted_interval_score(X.band_rows(spark, sf)))


@query("score_coverage", sql_rounded(_BAND + f"\nSELECT event_id, param_id, alpha, avg({_IN}) AS coverage FROM rows_ GROUP BY ALL", "coverage", "event_id param_id alpha"))
def score_coverage(spark, sf):
    return rounded(scores.coverage(X.band_rows(spark, sf), ["event_id", "param_id", "alpha"]))


@query("score_coverage_levels", sql_rounded(_BAND + "\nSELECT event_id, param_id, " + ", ".join(f"avg(CASE WHEN alpha = {a} THEN {_IN} END) AS cs{round(100 * (1 - a))}" for a in X.ALPHAS) + " FROM rows_ GROUP BY ALL", " ".join(f"cs{round(100 * (1 - a))}" for a in X.ALPHAS), _EP))
def score_coverage_levels(spark, sf):
    return rounded(scores.coverage_levels(X.band_rows(spark, sf), X.ALPHAS))


_NORMAL = _FLOW + ",\nnrm AS (SELECT event_id, param_id, s, avg(m) AS mu, greatest(stddev_samp(m), 0.01) AS sigma, y, e FROM scen JOIN truth USING (event_id, s) GROUP BY event_id, param_id, s, y, e)"
_LEVELS = ",\nlv(z, alpha) AS (VALUES " + ", ".join(f"({z}::DOUBLE, {a}::DOUBLE)" for z, a in scores.NORMAL_LEVELS) + "),\nrows_ AS (SELECT nrm.*, alpha, mu - z * sigma AS lower, mu + z * sigma AS upper, mu AS center FROM nrm CROSS JOIN lv)"


def _normal(spark, sf):
    ny, scen = X.scenarios(spark, sf)
    fits = scen.groupBy("event_id", "param_id", "s").agg(F.avg("m").alias("mu"), F.greatest(F.stddev_samp("m"), F.lit(0.01)).alias("sigma"))
    return fits.join(X.truth(ny), ["event_id", "s"])


@query("score_interval_normal", sql_rounded(_NORMAL + _LEVELS + f"\nSELECT event_id, param_id, alpha, avg({X.IS_SQL}) AS score FROM rows_ GROUP BY ALL", "score", "event_id param_id alpha"))
def score_interval_normal(spark, sf):
    return rounded(scores.interval_score(scores.normal_bands(_normal(spark, sf))))


@query("score_coverage_normal", sql_rounded(_NORMAL + _LEVELS + f"\nSELECT event_id, param_id, alpha, avg({_IN}) AS coverage FROM rows_ GROUP BY ALL", "coverage", "event_id param_id alpha"))
def score_coverage_normal(spark, sf):
    return rounded(scores.coverage(scores.normal_bands(_normal(spark, sf)), ["event_id", "param_id", "alpha"]))


@query("score_wis_normal", sql_rounded(_NORMAL + _LEVELS + ",\n" + _WIS + "\nSELECT event_id, param_id, wis FROM wis", "wis", _EP))
def score_wis_normal(spark, sf):
    return rounded(scores.weighted_interval_score(scores.normal_bands(_normal(spark, sf))))


@query("score_logs", sql_rounded(_NORMAL + "\nSELECT event_id, param_id, avg(0.5::DOUBLE * power((y - mu) / sigma, 2) + ln(sigma) + 0.9189385332046727::DOUBLE) AS logs FROM nrm GROUP BY ALL", "logs", _EP))
def score_logs(spark, sf):
    return rounded(scores.log_score(_normal(spark, sf)))


@query("score_crps_normal", sql_rounded(_NORMAL + ",\nzz AS (SELECT *, (y - mu) / sigma AS z FROM nrm)" + f"\nSELECT event_id, param_id, avg(sigma * (z * (2 * ({_cdf_sql('z')}) - 1) + 2 * exp(-0.5::DOUBLE * z * z) / 2.5066282746310002::DOUBLE - 0.5641895835477563::DOUBLE)) AS crps FROM zz GROUP BY ALL", "crps", _EP))
def score_crps_normal(spark, sf):
    return rounded(scores.crps_normal(_normal(spark, sf)))


def _members(spark, sf):
    ny, scen = X.scenarios(spark, sf)
    return scores.with_truth(scen, X.truth(ny))


@query("score_crps_ensemble", sql_rounded(_FLOW + ",\np AS (SELECT a.event_id, a.param_id, a.s, avg(abs(a.m - b.m)) AS g FROM scen a JOIN scen b USING (event_id, param_id, s) GROUP BY ALL),\nq AS (SELECT event_id, param_id, s, avg(abs(m - y)) AS d FROM scen JOIN truth USING (event_id, s) GROUP BY ALL)\nSELECT event_id, param_id, avg(d - g / 2) AS crps FROM p JOIN q USING (event_id, param_id, s) GROUP BY ALL", "crps", _EP))
def score_crps_ensemble(spark, sf):
    return rounded(scores.crps_ensemble(_members(spark, sf)))


@query("score_pit_normal", sql_rounded(_NORMAL + ",\nzz AS (SELECT param_id, (y - mu) / sigma AS z FROM nrm)" + f"\nSELECT param_id, avg({_cdf_sql('z')}) AS pit_mean, stddev_pop({_cdf_sql('z')}) AS pit_std FROM zz GROUP BY ALL", "pit_mean pit_std", "param_id"))
def score_pit_normal(spark, sf):
    return rounded(scores.pit_normal(_normal(spark, sf)))


_PIT = _FLOW + ",\npit AS (SELECT event_id, param_id, s, avg(CASE WHEN m <= y THEN 1.0::DOUBLE ELSE 0 END) AS pit FROM scen JOIN truth USING (event_id, s) GROUP BY ALL HAVING avg(CASE WHEN m <= y THEN 1.0::DOUBLE ELSE 0 END) < 1)"


@query("score_pit_ecdf", sql_rounded(_PIT + "\nSELECT event_id, param_id, s, pit FROM pit", "pit", "event_id param_id s"))
def score_pit_ecdf(spark, sf):
    return rounded(scores.pit_ecdf(_members(spark, sf)))


def _ks_sql(key: str = "param_id") -> str:
    """Of pit (key, pit): the cumulated density histogram less 1, 2, ..., 100."""
    return f""",
sp0 AS (SELECT {key}, min(pit) AS lo, max(pit) AS hi, count(*) AS n FROM pit GROUP BY ALL),
sp AS (SELECT {key}, n, CASE WHEN hi > lo THEN lo ELSE lo - 0.5::DOUBLE END AS lo, CASE WHEN hi > lo THEN hi - lo ELSE 1.0::DOUBLE END AS w FROM sp0),
hb AS (SELECT {key}, least(floor((pit - lo) / w * 100), 99) AS bin, count(*) AS c FROM pit JOIN sp USING ({key}) GROUP BY ALL),
gr AS (SELECT {key}, n, w, i AS bin FROM sp, range(0, 100) AS r(i)),
gp AS (SELECT {key}, bin, sum(coalesce(c, 0) / n / (w / 100)) OVER (PARTITION BY {key} ORDER BY bin) - (bin + 1) AS gap FROM gr LEFT JOIN hb USING ({key}, bin))"""


_KS = _PIT + _ks_sql()
_KS_NORMAL = _NORMAL + f",\npit AS (SELECT param_id, {_cdf_sql('z')} AS pit FROM (SELECT param_id, (y - mu) / sigma AS z FROM nrm))" + _ks_sql()


@query("score_ks_rms", sql_rounded(_KS_NORMAL + "\nSELECT param_id, sqrt(avg(gap * gap)) / 100 AS ks_rms FROM gp GROUP BY ALL", "ks_rms", "param_id"))
def score_ks_rms(spark, sf):
    pit = _normal(spark, sf).select("param_id", scores.normal_pit().alias("pit"))
    return rounded(scores.ks_gap(pit, "pit", ["param_id"]).select("param_id", "ks_rms"))


@query("score_ks_sup", sql_rounded(_KS + "\nSELECT param_id, max(abs(gap)) AS ks_sup FROM gp GROUP BY ALL", "ks_sup", "param_id"))
def score_ks_sup(spark, sf):
    return rounded(scores.ks_gap(scores.pit_ecdf(_members(spark, sf)), "pit", ["param_id"]).select("param_id", "ks_sup"))


@query("score_errors", sql_rounded(_NORMAL + "\nSELECT event_id, param_id, sqrt(avg(power(y - mu, 2))) AS rmse, avg(abs(y - mu)) AS mae, avg(y - mu) AS mbe FROM nrm GROUP BY ALL", "rmse mae mbe", _EP))
def score_errors(spark, sf):
    return rounded(scores.errors(_normal(spark, sf)))


def _rmse_sql(at: int = X.T) -> str:
    return f",\nra AS (SELECT curve_id AS event_id, sqrt(avg(power(f - e, 2))) AS rmse_tau FROM ev WHERE tau < {at} GROUP BY ALL)" + _RMSE_AHEAD


_RMSE_AHEAD = ",\nmd AS (SELECT event_id, param_id, s, median(m) AS mm FROM scen GROUP BY ALL),\nrb AS (SELECT event_id, param_id, sqrt(avg(power(mm - e, 2))) AS rmse_s FROM md JOIN truth USING (event_id, s) GROUP BY ALL)"
_RMSE = _rmse_sql()


def _rmse_pair(ny, scen, at=X.T):
    before = scores.errors(ny.where((F.col("y") >= X.TEST_YEAR) & (F.col("tau") < at)).withColumnRenamed("curve_id", "event_id"), "f", "e", ["event_id"]).select("event_id", F.col("rmse").alias("rmse_tau"))
    ahead = scores.errors(fuse.median_curve(scen).join(X.truth(ny, at), ["event_id", "s"]), "median", "e").select("event_id", "param_id", F.col("rmse").alias("rmse_s"))
    return ahead.join(before, "event_id")


@query("score_rmse_tau_s", sql_rounded(_FLOW + _RMSE + "\nSELECT event_id, param_id, rmse_s, rmse_tau FROM rb JOIN ra USING (event_id)", "rmse_s rmse_tau", _EP))
def score_rmse_tau_s(spark, sf):
    return rounded(_rmse_pair(*X.scenarios(spark, sf)).select("event_id", "param_id", "rmse_s", "rmse_tau"))


@query("score_by_horizon", sql_rounded(_NORMAL + "\nSELECT param_id, CAST(floor(s / 2) AS BIGINT) AS bucket, sqrt(avg(power(y - mu, 2))) AS rmse, avg(abs(y - mu)) AS mae, avg(y - mu) AS mbe FROM nrm GROUP BY ALL", "rmse mae mbe", "param_id bucket"))
def score_by_horizon(spark, sf):
    return rounded(scores.errors(_normal(spark, sf).withColumn("bucket", F.floor(F.col("s") / 2)), by=["param_id", "bucket"]))


# Histograms ---------------------------------------------------------------------------------------


def _bin_sql(x, low, high, bins):
    return f"CASE WHEN {x} >= {low} AND {x} <= {high} THEN CAST(least(floor(({x} - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE) * {bins}) + 1, {bins}) AS INTEGER) END"


def _hist_sql(prefix, src, x, low, high, bins, by=""):
    lead = by + ", " if by else ""
    return f"{prefix},\nhh AS (SELECT {lead}{_bin_sql(x, low, high, bins)} AS bin FROM {src}),\nhc AS (SELECT {lead}bin, count(*) AS n FROM hh WHERE bin IS NOT NULL GROUP BY ALL)\nSELECT {lead}bin, n, n / sum(n) OVER ({'PARTITION BY ' + by if by else ''}) / (({high} - {low})::DOUBLE / {bins}) AS density FROM hc"


@query("hist_edf_heatmap", sql_rounded(_hist_sql(_FLOW, "scen", "round(100 * m, 9)", 0, 100, 25, "param_id, s"), "density", "param_id s bin n"))
def hist_edf_heatmap(spark, sf):
    return rounded(hist.density(X.scenarios(spark, sf)[1], F.round(100 * F.col("m"), 9), 0.0, 100.0, 25, ["param_id", "s"]))


@query("hist_cut_kde", sql_rounded(_FLOW + ",\nsh AS (SELECT param_id, s, 0.9::DOUBLE * least(stddev_pop(m), (quantile_cont(m, 0.75) - quantile_cont(m, 0.25)) / 1.34::DOUBLE) * power(count(*), -0.2::DOUBLE) AS h FROM scen GROUP BY ALL)\nSELECT param_id, s, CAST(i AS INTEGER) AS i, avg(exp(-0.5::DOUBLE * power((i / 20.0::DOUBLE - m) / h, 2)) / (h * 2.5066282746310002::DOUBLE)) AS density FROM scen JOIN sh USING (param_id, s), range(0, 21) AS r(i) WHERE h > 0 GROUP BY ALL", "density", "param_id s i"))
def hist_cut_kde(spark, sf):
    cut = X.scenarios(spark, sf)[1]
    width = cut.groupBy("param_id", "s").agg(C.silverman(F.col("m")).alias("h"))
    return rounded(hist.gaussian_kde(cut, "m", width, 0.0, 1.0, 21, ["param_id", "s"]).select("param_id", "s", F.round(F.col("g") * 20).cast("int").alias("i"), "density"))


_D = "WITH " + ",\n".join([X.NY_SQL, X.PARAMS_SQL, X.DIST_SQL])


@query("hist_weights", sql_rounded(_hist_sql(_D, "dist", "round(w_f, 9)", 0, 1, 50, "param_id"), "density", "param_id bin n"))
def hist_weights(spark, sf):
    return rounded(hist.density(X.scored(spark, sf)[1], F.round("w_f", 9), 0.0, 1.0, 50, ["param_id"]))


@query("hist_location_counts", sql_rounded(_SEL + "\nSELECT sel.param_id, hc.lon, hc.lat, count(*) AS n FROM sel JOIN (SELECT DISTINCT curve_id, lon, lat FROM hist) hc USING (curve_id) WHERE in_final GROUP BY ALL", "lon lat", "param_id n"))
def hist_location_counts(spark, sf):
    ny, sel = X.selected(spark, sf)
    at = ny.select("curve_id", "lon", "lat").distinct()
    return rounded(sel.where("in_final").join(at, "curve_id").groupBy("param_id", "lon", "lat").agg(F.count(F.lit(1)).alias("n")))


@query("hist_month_distance", _D + _BUCKET + ",\nmo AS (SELECT DISTINCT curve_id, yday // 31 + 1 AS mon FROM hist)\nSELECT bucket, " + ", ".join(f"count(*) FILTER (WHERE mon = {i}) AS m{i}" for i in range(1, 13)) + " FROM bk JOIN mo USING (curve_id) GROUP BY bucket")
def hist_month_distance(spark, sf):
    mo = X.nation_year(spark, sf).select("curve_id", (F.floor(F.col("yday") / 31) + 1).alias("mon")).distinct()
    wide = _buckets(spark, sf).join(mo, "curve_id").groupBy("bucket").pivot("mon", list(range(1, 13))).agg(F.count(F.lit(1)))
    return wide.select("bucket", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"m{i}") for i in range(1, 13)])


_STAGES = ("in_sim", "in_temporal", "in_spatial", "in_final")


@query("hist_yday", sql_rounded(_hist_sql(_SEL + ",\nfy AS (" + " UNION ALL ".join(f"SELECT '{c}' AS stage, sel.param_id, hc.yday FROM sel JOIN (SELECT DISTINCT curve_id, yday FROM hist) hc USING (curve_id) WHERE {c}" for c in _STAGES) + ")", "fy", "yday", 1, 365, 50, "stage, param_id"), "density", "stage param_id bin n"))
def hist_yday(spark, sf):
    """Days of the year of what each stage of the selection keeps."""
    ny, d = X.scored(spark, sf)
    kept = F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in _STAGES]))).alias("stage")
    days = N.select(d).select("param_id", "curve_id", kept).join(ny.select("curve_id", "yday").distinct(), "curve_id")
    return rounded(hist.density(days, F.col("yday"), 1.0, 365.0, 50, ["stage", "param_id"]))


@query("hist_distance", sql_rounded(_hist_sql(_D, "dist", "round(d_h, 6)", 0, 3000, 50, "param_id"), "density", "param_id bin n", 9))
def hist_distance(spark, sf):
    return rounded(hist.density(X.scored(spark, sf)[1], F.round("d_h", 6), 0.0, 3000.0, 50, ["param_id"]), 9)


@query("hist_pit", sql_rounded(_hist_sql(_PIT, "pit", "round(pit, 9)", 0, 1, 10, "param_id"), "density", "param_id bin n"))
def hist_pit(spark, sf):
    return rounded(hist.density(scores.pit_ecdf(_members(spark, sf)), F.round("pit", 9), 0.0, 1.0, 10, ["param_id"]))


# Experiments and results --------------------------------------------------------------------------

#: The swept parameter's values, the others as in the base set; update times in slots (quarters of the grid).
_SWEEP = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0]
_BASE, _TIMES = X.PARAM_ROWS[1], (3, 6, 9)
_SWEPT = [(i, *_BASE[1:5], v, *_BASE[6:]) for i, v in enumerate(_SWEEP)]


@query("exp_param_grid", "WITH " + X.NY_SQL + ",\n" + X.params_sql(_SWEPT) + "\nSELECT DISTINCT curve_id AS event_id, CAST(t AS INTEGER) AS t, params.* FROM ev CROSS JOIN params CROSS JOIN (VALUES (3), (6), (9)) AS u(t)")
def exp_param_grid(spark, sf):
    """Events x update times x the sweep."""
    names = X.params(spark).columns
    grid = tuning.param_grid(spark, dict(zip(names[1:], _BASE[1:], strict=True)), "lookup_rate", _SWEEP).select(*names)
    times = spark.createDataFrame([(t,) for t in _TIMES], "t int")
    events = X.nation_year(spark, sf).where(F.col("y") >= X.TEST_YEAR).select(F.col("curve_id").alias("event_id")).distinct()
    return events.crossJoin(F.broadcast(times.crossJoin(grid)))


def _validated(spark, sf, param_rows=X.PARAM_ROWS, times=(X.T,)):
    """t, event_id, param_id, wis_f, wis_e, rmse_s, rmse_tau, n_scenarios at each update time."""
    ny, params = settle(X.nation_year(spark, sf)), X.params(spark, param_rows)
    past = settle(X.history(ny))  # formed once, whatever the number of times

    def scored(at):
        weighted = settle(N.with_weights(X.events(ny, at), params, X.SLOTS, X.PER_HOUR))
        sel = N.select(N.near(weighted, past))
        scen = settle(fuse.scenarios(sel, ny.where(F.col("y") < X.TEST_YEAR), params, at, fuse.lie(X.MINUTES)))
        own = scores.with_truth(B.ecdf_band(scen, X.ALPHAS), X.truth(ny, at)).join(X.truth(ny, at).select("event_id", "s", "e"), ["event_id", "s"])
        n = scen.groupBy("event_id", "param_id").agg(F.count_distinct("curve_id").alias("n_scenarios"))
        wis_f = scores.weighted_interval_score(own).withColumnRenamed("wis", "wis_f")
        wis_e = scores.weighted_interval_score(own.withColumns({"y": F.col("e")})).withColumnRenamed("wis", "wis_e")
        one = wis_f.join(wis_e, ["event_id", "param_id"]).join(_rmse_pair(ny, scen, at), ["event_id", "param_id"]).join(n, ["event_id", "param_id"])
        return one.select(F.lit(at).alias("t"), "event_id", "param_id", "wis_f", "wis_e", "rmse_s", "rmse_tau", "n_scenarios")

    # A time's scores are a row an event and parameter; its scenarios go once these are written.
    return functools.reduce(lambda a, b: a.unionByName(b), [settle_last(lambda at=at: scored(at)) for at in times])


_WIS_E = _WIS.replace("wl AS", "wle AS").replace("wis AS (", "wise AS (").replace("FROM wl", "FROM wle").replace("abs(y -", "abs(e -").replace("lower - y", "lower - e").replace("y - upper", "e - upper")


def _valid_sql(param_rows=X.PARAM_ROWS, times=(X.T,)) -> str:
    """val: t, event_id, param_id and the scores, each update time a flow of its own."""
    one = lambda at: (
        "(WITH " + X.flow_sql(at, param_rows) + X.BANDS_SQL + ",\n" + _WIS + ",\n" + _WIS_E + _rmse_sql(at)
        + ",\nns AS (SELECT event_id, param_id, count(DISTINCT curve_id) AS n_scenarios FROM scen GROUP BY ALL)"
        + f"\nSELECT CAST({at} AS INTEGER) AS t, event_id, param_id, wis.wis AS wis_f, wise.wis AS wis_e, rmse_s, rmse_tau, n_scenarios FROM wis JOIN wise USING (event_id, param_id) JOIN rb USING (event_id, param_id) JOIN ra USING (event_id) JOIN ns USING (event_id, param_id))"
    )
    return "WITH val AS (" + " UNION ALL ".join(f"SELECT * FROM {one(at)}" for at in times) + ")"


_VALID, _SWEEP_SQL = _valid_sql(), _valid_sql(_SWEPT, _TIMES)
_VC = "wis_f wis_e rmse_s rmse_tau"


def _swept(spark, sf):
    return _validated(spark, sf, _SWEPT, _TIMES)


@query("exp_validate", sql_rounded(_SWEEP_SQL + "\nSELECT t, event_id, param_id, wis_f, wis_e, rmse_s, rmse_tau, n_scenarios FROM val", _VC, "t " + _EP + " n_scenarios"))
def exp_validate(spark, sf):
    return rounded(_swept(spark, sf))


#: The shares of the scenarios in a band, and its levels.
_FRACTIONS = [0.1, 0.175, 0.25, 0.325, 0.4, 0.475, 0.55, 0.625, 0.7, 0.775, 0.85, 0.925]
_ENVELOPE_ALPHAS = [0.1, 0.2, 0.3, 0.4]


def _envelope_scores(spark, sf, scen, ny):
    """Each fraction's band of the envelope by each distance, scored at each level."""
    n = scen.groupBy("event_id", "param_id").agg(F.count_distinct("curve_id").alias("n_scenarios"))
    alphas = F.explode(F.array(*[F.lit(a) for a in _ENVELOPE_ALPHAS])).alias("alpha")

    def scored(kind):
        env = settle(E.focal_envelope(scen, kind))
        size = env.groupBy("event_id", "param_id").agg(F.count(F.lit(1)).alias("n_envelope"))
        rows = scores.with_truth(E.functional_bands(scen, env, n, _FRACTIONS), X.truth(ny)).where("lower is not null")
        rows = rows.select("*", alphas)
        inside = (F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))
        one = rows.groupBy("event_id", "param_id", "fraction", "alpha").agg(F.sum(scores.interval(F.col("lower"), F.col("upper"), F.col("y"), F.col("alpha"))).alias("wis"), F.avg(inside.cast("double")).alias("fcs"))
        return one.join(n.join(size, ["event_id", "param_id"]), ["event_id", "param_id"]).withColumn("distance", F.lit(kind))

    out = functools.reduce(lambda a, b: a.unionByName(b), [settle_last(lambda kind=kind: scored(kind)) for kind in ("sup", "l2", "similarity")])
    return out.select("event_id", "param_id", "distance", "fraction", "alpha", F.floor(F.col("fraction") * F.col("n_scenarios")).alias("k"), "n_scenarios", "n_envelope", "wis", "fcs")


@query("exp_validate_envelope")
def exp_validate_envelope(spark, sf):
    ny, scen = X.scenarios(spark, sf)
    return rounded(_envelope_scores(spark, sf, settle(scen.withColumnRenamed("wn", "w")), ny))


#: Each level's shares to trim, swept one level at a time about the level itself.
_CAL_LEVELS = (0.1, 0.2, 0.3, 0.4)
_CAL_GRID = [(a, round(a + k / 100, 2)) for a in _CAL_LEVELS for k in range(-5, 6)]


def _bands_sql(steps):
    dq = "".join(",\n" + _cal_dq(a).replace("st AS", f"sq{i} AS").replace("dq AS", f"dq{i} AS").replace("JOIN st USING", f"JOIN sq{i} USING") for i, a in enumerate(_CAL_LEVELS))
    grid = ", ".join(f"({a}::DOUBLE, {z}::DOUBLE)" for a, z in steps)
    deep = " UNION ALL ".join([f"SELECT 'MBD' AS method, {a}::DOUBLE AS level, event_id, param_id, curve_id, depth FROM dd" for a in _CAL_LEVELS] + [f"SELECT 'DQ', {a}::DOUBLE, event_id, param_id, curve_id, round(-depth, 9) FROM dq{i}" for i, a in enumerate(_CAL_LEVELS)])
    return _FLOW + _SETS + _MBD_SET + dq + f""",
gz(level, zeta) AS (VALUES {grid}),
deep AS ({deep}),
kr AS (SELECT *, row_number() OVER (PARTITION BY method, level, event_id, param_id ORDER BY depth, curve_id) AS r, count(*) OVER (PARTITION BY method, level, event_id, param_id) AS nn FROM deep),
cut AS (SELECT method, level, zeta, event_id, param_id, s, min(m) AS lower, max(m) AS upper FROM scen JOIN kr USING (event_id, param_id, curve_id) JOIN gz USING (level) WHERE r > floor(nn * zeta) GROUP BY ALL),
li AS (SELECT event_id, param_id, s, list(m ORDER BY m) AS v, count(*) AS n, median(m) AS mid FROM scen GROUP BY ALL),
bnd AS (SELECT * FROM cut UNION ALL SELECT 'eCDF', level, zeta, event_id, param_id, s, v[CAST(greatest(1, ceil(n * (zeta / 2))) AS BIGINT)], v[CAST(greatest(1, ceil(n * (1 - zeta / 2))) AS BIGINT)] FROM li CROSS JOIN gz)"""


def _cal_sql():
    return _bands_sql(_CAL_GRID) + f""",
sc AS (SELECT method, level, zeta, event_id, param_id, s, level / 2 * ((upper - lower) + (2 / level) * (greatest(lower - y, 0) + greatest(y - upper, 0))) AS part, CASE WHEN y >= lower AND y <= upper THEN 1.0::DOUBLE ELSE 0 END AS hit FROM bnd JOIN truth USING (event_id, s)),
bs AS (SELECT method, event_id, param_id, s, sum(part) AS total FROM sc WHERE level = zeta GROUP BY ALL),
bl AS (SELECT method, event_id, param_id, level, s, part AS own FROM sc WHERE level = zeta),
wz AS (SELECT method, level, zeta, event_id, param_id, median((0.5::DOUBLE * abs(y - mid) + total - own + part) / 4.5::DOUBLE) AS wis FROM sc JOIN bs USING (method, event_id, param_id, s) JOIN bl USING (method, event_id, param_id, level, s) JOIN li USING (event_id, param_id, s) JOIN truth USING (event_id, s) GROUP BY ALL),
cv AS (SELECT method, level, zeta, event_id, param_id, avg(hit) AS cs FROM sc GROUP BY ALL),
cb AS (SELECT method, event_id, param_id, {", ".join(f"max(CASE WHEN level = {a} THEN cs END) AS b{round(100 * (1 - a))}" for a in _CAL_LEVELS)} FROM cv WHERE level = zeta GROUP BY ALL)
SELECT method, level, zeta, event_id, param_id, wis, {", ".join(f"CASE WHEN level = {a} THEN cs ELSE b{round(100 * (1 - a))} END AS cs{round(100 * (1 - a))}" for a in _CAL_LEVELS)} FROM wz JOIN cv USING (method, level, zeta, event_id, param_id) JOIN cb USING (method, event_id, param_id)"""


def _cal_dq(alpha: float) -> str:
    return _dq_sql("st0", "event_id, param_id", alpha / 2)


@query("score_method_table", sql_rounded(_bands_sql([(a, a) for a in _CAL_LEVELS]) + f"\nSELECT method, level, param_id, avg({_IN}) AS coverage, avg(upper - lower) AS width FROM bnd JOIN truth USING (event_id, s) GROUP BY ALL", "level coverage width", "method param_id"))
def score_method_table(spark, sf):
    """Coverage and mean width by method and level."""
    ny, scen = X.scenarios(spark, sf)
    rows = scores.with_truth(tuning.level_bands(settle(scen), _CAL_LEVELS, [(a, a) for a in _CAL_LEVELS])[0], X.truth(ny))
    inside = (F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))
    return rounded(rows.groupBy("method", "level", "param_id").agg(F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("width")))


@query("exp_calibrate", sql_rounded(_cal_sql(), "level zeta wis cs90 cs80 cs70 cs60", "method event_id param_id"))
def exp_calibrate(spark, sf):
    """Each level's trimmed share swept with the others at their own level, by each kind of band."""
    ny, scen = X.scenarios(spark, sf)
    return rounded(tuning.calibrate(settle(scen), X.truth(ny), _CAL_LEVELS, _CAL_GRID))


@query("exp_holdout", sql_rounded(_valid_sql([_BASE], _TIMES) + "\nSELECT t, event_id, wis_f, wis_e, rmse_s, rmse_tau, n_scenarios FROM val WHERE event_id // 10000 >= 10", _VC, "t event_id n_scenarios"))
def exp_holdout(spark, sf):
    """Fixed parameters on the assets kept for the end (keys of 10 and over), at each update time."""
    return rounded(_validated(spark, sf, [_BASE], _TIMES).where("event_id div 10000 >= 10").drop("param_id"))


_LOO_AT, _LOO_ROW, _LOO_FLOOR = 12, (0, 2.0, 2.0, 0.05, 0.05, 3.0, 0.8, 2.5, 10.0, 0.05, 5, 20), 1e-4
_LOO_SQL = (
    "WITH " + ",\n".join([X.UC_SQL, "hist AS (SELECT * FROM uc), ev AS (SELECT * FROM uc)", X.params_sql([_LOO_ROW]), X.dist_sql(_LOO_AT, "h.day <> ev.day"), X.SEL_SQL, X.scen_sql(at=_LOO_AT)])
    + f""",
fused AS (SELECT event_id, s, sum(wn * m) AS mu, sqrt(greatest(sum(wn * m * m) - power(sum(wn * m), 2), {_LOO_FLOOR}::DOUBLE)) AS sd FROM scen GROUP BY ALL),
z AS (SELECT day, f - mu AS d, sd FROM fused JOIN uc ON uc.curve_id = fused.event_id AND uc.tau = fused.s + {_LOO_AT}),
sc AS (SELECT day, avg(0.5::DOUBLE * power(d / sd, 2) + ln(sd) + 0.9189385332046727::DOUBLE) AS logs, avg(sd * ((d / sd) * (2 * (""" + _cdf_sql("(d / sd)") + """) - 1) + 2 * exp(-0.5::DOUBLE * (d / sd) * (d / sd)) / 2.5066282746310002::DOUBLE - 0.5641895835477563::DOUBLE)) AS crps FROM z GROUP BY day),
pit AS (SELECT day, """ + _cdf_sql("(d / sd)") + " AS pit FROM z)" + _ks_sql("day")
)


@query("exp_loocv", sql_rounded(_LOO_SQL + "\nSELECT sc.day, logs, crps, sqrt(avg(gap * gap)) / 100 AS ks FROM sc JOIN gp ON sc.day = gp.day GROUP BY ALL", "logs crps ks", "day", 5))
def exp_loocv(spark, sf):
    """Each day forecast by its nearest curves of all other days and scored: one search, no join a fold."""
    curves = settle(X.user_curves(spark, sf))
    packed = settle(prep.pack(curves, X.UC_KEYS, f="f", e="e").withColumn("fold", F.col("day")))
    params = X.params(spark, [_LOO_ROW])
    events = prep.make_event(packed, _LOO_AT).withColumnRenamed("curve_id", "event_id")
    sel = N.select(N.near(settle(N.with_weights(events, params, 24, X.PER_HOUR)), packed))
    scen = fuse.scenarios(sel, curves, params, _LOO_AT, fuse.lie(X.MINUTES))
    mean = F.sum(F.col("wn") * F.col("m"))
    fused = scen.groupBy("event_id", "s").agg(mean.alias("mu"), F.sqrt(F.greatest(F.sum(F.col("wn") * F.col("m") * F.col("m")) - mean * mean, F.lit(_LOO_FLOOR))).alias("sigma"))
    truth = curves.where(F.col("tau") >= _LOO_AT).select(F.col("curve_id").alias("event_id"), "day", (F.col("tau") - _LOO_AT).alias("s"), F.col("f").alias("y"))
    rows = settle(truth.join(fused, ["event_id", "s"]).select(F.col("day").alias("event_id"), F.lit(0).alias("param_id"), "y", "mu", "sigma"))
    both = scores.log_score(rows).join(scores.crps_normal(rows), ["event_id", "param_id"])
    ks = scores.ks_gap(rows.select("event_id", scores.normal_pit().alias("pit")), "pit", ["event_id"])
    return rounded(both.join(ks, "event_id").select(F.col("event_id").alias("day"), "logs", "crps", F.col("ks_rms").alias("ks")), 5)


@query("res_median_by_param", sql_rounded(_SWEEP_SQL + "\nSELECT t, param_id, median(wis_f) AS median FROM val GROUP BY ALL", "median", "t param_id"))
def res_median_by_param(spark, sf):
    return rounded(tuning.median_by_param(_swept(spark, sf), "param_id", "wis_f", ["t"]))


@query("res_mean_by_fraction")
def res_mean_by_fraction(spark, sf):
    return rounded(exp_validate_envelope(spark, sf).groupBy("distance", "fraction", "alpha").agg(F.avg("wis").alias("wis"), F.avg("fcs").alias("fcs")))


_VALUES_SQL = "(VALUES " + ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(_SWEEP)) + ") AS sv(param_id, lookup_rate)"
_RES = _SWEEP_SQL + f",\nrr AS (SELECT event_id // 10000 AS asset, event_id % 10000 AS day, t, round(wis_f, 9) AS wis, wis_e, rmse_s, rmse_tau, lookup_rate FROM val JOIN {_VALUES_SQL} USING (param_id))"


def _results(spark, sf):
    """The sweep's rows by asset, day (year), update time and value of the swept parameter."""
    values = spark.createDataFrame(list(enumerate(_SWEEP)), "param_id int, lookup_rate double")
    rows = _swept(spark, sf).join(F.broadcast(values), "param_id")
    return rows.select(F.floor(F.col("event_id") / 10_000).alias("asset"), (F.col("event_id") % 10_000).alias("day"), "t", F.round("wis_f", 9).alias("wis"), "wis_e", "rmse_s", "rmse_tau", "lookup_rate")


@query("res_best_param", sql_rounded(_RES + ",\nm AS (SELECT asset, t, lookup_rate, median(wis) AS md FROM rr GROUP BY ALL),\nb AS (SELECT asset, t, lookup_rate, row_number() OVER (PARTITION BY asset, t ORDER BY round(md, 9), lookup_rate) AS r FROM m)\nSELECT 'lookup_rate' AS name, " + ", ".join(f"median(CASE WHEN t = {t} THEN lookup_rate END) AS t{t}" for t in _TIMES) + " FROM b WHERE r = 1", " ".join(f"t{t}" for t in _TIMES), "name"))
def res_best_param(spark, sf):
    """Each time's best value side by side, as the table of parameters by time is read."""
    best = tuning.best_param(_results(spark, sf), "lookup_rate", "wis")
    wide = best.groupBy(F.lit("lookup_rate").alias("name")).pivot("t", list(_TIMES)).agg(F.first("best"))
    return rounded(wide.select("name", *[F.col(str(t)).alias(f"t{t}") for t in _TIMES]))


@query("res_status_counts", _SEL + ",\nst AS (SELECT DISTINCT event_id, param_id, CASE WHEN n_sim > kappa_max THEN 1 WHEN n_sim < kappa_min THEN 4 ELSE 0 END AS status FROM sel)\nSELECT param_id, CAST(status AS INTEGER) AS status, count(*) AS n FROM st GROUP BY ALL")
def res_status_counts(spark, sf):
    sel = X.near(spark, sf)[1].groupBy("event_id", "param_id").agg(F.sum("sim_here").alias("n"), F.max("kappa_max").alias("hi"), F.max("kappa_min").alias("lo"))
    return sel.groupBy("param_id", F.when(F.col("n") > F.col("hi"), 1).when(F.col("n") < F.col("lo"), 4).otherwise(0).alias("status")).agg(F.count(F.lit(1)).alias("n"))


_LABEL = _RES + ",\nlb AS (SELECT asset, day, t, lookup_rate AS label FROM (SELECT *, row_number() OVER (PARTITION BY asset, day, t ORDER BY wis, lookup_rate) AS r FROM rr) WHERE r = 1)"


@query("res_label_argmin", sql_rounded(_LABEL + "\nSELECT asset, day, t, label FROM lb", "label", "asset day t"))
def res_label_argmin(spark, sf):
    return rounded(tuning.label_argmin(_results(spark, sf), "lookup_rate", "wis", ["asset", "day", "t"]))


@query("mdl_features", sql_rounded(_LABEL + f"\nSELECT asset, day, t, wis_e, rmse_s, rmse_tau, label FROM rr JOIN lb USING (asset, day, t) WHERE lookup_rate = {_BASE[5]}::DOUBLE", "wis_e rmse_s rmse_tau label", "asset day t"))
def mdl_features(spark, sf):
    return rounded(_features(spark, sf))


def _features(spark, sf):
    """The features at the base value and the value of least score, of each asset, day and time."""
    rows, keys = settle(_results(spark, sf)), ["asset", "day", "t"]
    return rows.where(F.col("lookup_rate") == _BASE[5]).select(*keys, "wis_e", "rmse_s", "rmse_tau").join(tuning.label_argmin(rows, "lookup_rate", "wis", keys), keys)


_FEATURES = ["t", "wis_e", "rmse_s", "rmse_tau"]
#: Penalties on a logarithmic grid: 10 for the lasso, 25 for the ridge.
_LASSO = [round(10 ** (-3 + 4 * i / 9), 6) for i in range(10)]
_RIDGE = [round(10 ** (-3 + 6 * i / 24), 6) for i in range(25)]


@query("mdl_lasso")
def mdl_lasso(spark, sf):
    return tuning.linear(settle(_features(spark, sf)), _FEATURES, "label", True, _LASSO)


@query("mdl_ridge")
def mdl_ridge(spark, sf):
    return tuning.linear(settle(_features(spark, sf)), _FEATURES, "label", False, _RIDGE)


@query("mdl_tree")
def mdl_tree(spark, sf):
    return tuning.tree(settle(_features(spark, sf)), _FEATURES, "label", [2, 3, 5, 8], [1, 2, 5, 10])


@query("mdl_metrics", sql_rounded("WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)\nSELECT 1 - sum(power(y - p, 2)) / (sum(y * y) - count(y) * avg(y) * avg(y)) AS r2, sqrt(avg(power(y - p, 2))) AS rmse, avg(abs(y - p) / nullif(abs(y), 0)) AS mape, avg(abs(y - p) / nullif(abs(p), 0)) AS mape_by_prediction FROM x", "r2 rmse mape mape_by_prediction", "", 4))
def mdl_metrics(spark, sf):
    x = X.t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return rounded(tuning.metrics(x, "y", "p"), 4)


# Functional PCA -----------------------------------------------------------------------------------


@query("fpca_mean", sql_rounded("WITH " + X.EMBED_SQL + "\nSELECT set_id, tau, avg(v) AS mu FROM emb GROUP BY ALL", "mu", "set_id tau"))
def fpca_mean(spark, sf):
    return rounded(fpca.mean(X.embed(spark, sf)))


@query("fpca_cov", sql_rounded("WITH " + X.EMBED_SQL + "\nSELECT a.set_id, a.tau AS tau1, b.tau AS tau2, covar_samp(a.v, b.v) AS cov FROM emb a JOIN emb b ON a.curve_id = b.curve_id AND a.set_id = b.set_id AND a.tau <= b.tau GROUP BY ALL", "cov", "set_id tau1 tau2", 8))
def fpca_cov(spark, sf):
    return rounded(fpca.covariance(X.embed(spark, sf)), 8)


def _model(spark, sf, k=4):
    x = X.embed(spark, sf)
    phi = settle(fpca.fit(x, k))
    return x, fpca.mean(x), phi


#: The share of variance that components are to explain.
_SHARE = 0.9


def _explaining(x):
    """Means, components (as many as explain _SHARE, set by set) and error variances of curves, settled."""
    error = settle(fpca.noise(x))
    return settle(fpca.mean(x)), settle(fpca.fit(x, share=_SHARE, error=error)), error


@query("fpca_noise", sql_rounded("WITH " + X.EMBED_SQL + "\nSELECT a.set_id, coalesce(avg(power(c.v - 2 * b.v + a.v, 2)) / 6, 0) AS sigma2 FROM emb a LEFT JOIN emb b ON a.set_id = b.set_id AND a.curve_id = b.curve_id AND b.tau = a.tau + 1 LEFT JOIN emb c ON a.set_id = c.set_id AND a.curve_id = c.curve_id AND c.tau = a.tau + 2 GROUP BY ALL", "sigma2", "set_id", 8))
def fpca_noise(spark, sf):
    return rounded(fpca.noise(X.embed(spark, sf)), 8)


@query("fpca_fit")
def fpca_fit(spark, sf):
    """Components by explained variance, the error's variance taken off first."""
    return rounded(_explaining(X.embed(spark, sf))[1])


@query("fpca_project")
def fpca_project(spark, sf):
    x = X.embed(spark, sf)
    mu, phi, error = _explaining(x)
    return rounded(fpca.expected_scores(x, mu, phi, error))


@query("fpca_reconstruct")
def fpca_reconstruct(spark, sf):
    x, mu, phi = _model(spark, sf)
    p = phi.select("set_id", "k", "tau", "phi")
    return rounded(fpca.reconstruct(fpca.project(x, mu, p), mu, p))


@query("fpca_per_asset")
def fpca_per_asset(spark, sf):
    x = X.nation_year(spark, sf).select(F.col("asset").cast("long").alias("set_id"), "curve_id", "tau", F.col("f").alias("v"))
    return rounded(fpca.fit(x, 2).select("set_id", "k", "eigenvalue", "tau", "phi"))


def _split_curves(spark, sf):
    """Training curves and held-out ones, a tenth drawn at random by id."""
    x = X.embed(spark, sf).withColumn("split", prep.random_split(F.col("curve_id"), 10))
    return x.where("split = 'train'").drop("split"), x.where("split = 'test'").drop("split")


@query("fpca_partial_day")
def fpca_partial_day(spark, sf):
    """Fitted on the training curves' first slots; predicted curves of the held-out ones over the same slots."""
    train, test = (x.where(F.col("tau") < _UP_TO) for x in _split_curves(spark, sf))
    mu, phi, error = _explaining(train)
    found = fpca.reconstruct(fpca.expected_scores(test, mu, phi, error), mu, phi.select("set_id", "k", "tau", "phi"))
    return rounded(found.join(test.withColumnRenamed("v", "actual"), ["set_id", "curve_id", "tau"]))


_UP_TO = 24


@query("fpca_partial_forecast")
def fpca_partial_forecast(spark, sf):
    """Fitted on whole training curves; held-out ones, seen up to a slot, are forecast beyond it."""
    train, test = _split_curves(spark, sf)
    mu, phi, error = _explaining(train)
    score = fpca.expected_scores(test.where(F.col("tau") < _UP_TO), mu, phi, error)
    found = fpca.reconstruct(score, mu, phi.select("set_id", "k", "tau", "phi")).where(F.col("tau") >= _UP_TO)
    return rounded(found.join(test.withColumnRenamed("v", "actual"), ["set_id", "curve_id", "tau"]))


# Streaming ----------------------------------------------------------------------------------------


@query("stream_dynamic_update", sql_rounded("SELECT user_id % 10 AS asset, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS tau, sum(value) AS f FROM events GROUP BY ALL HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)", "f", "asset day tau", 4))
def stream_dynamic_update(spark, sf):
    """Hours that the watermark has closed, as the stream's micro-batches append them."""
    out = new_path(spark)
    updates.run_updates(_stream(spark, sf), out, new_path(spark))
    rows = spark.read.schema(updates.HOURS).parquet(f"{out}/hours")
    return rounded(rows.select("asset", F.to_date("start").alias("day"), F.hour("start").alias("tau"), "f"), 4)


def _stream(spark, sf):
    """The events table as a stream of files, a few at a time, in order of time."""
    schema, source = X.t(spark, sf, "events").schema, new_path(spark)
    X.t(spark, sf, "events").repartitionByRange(4, "ts").write.parquet(source)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    return rows.select((F.col("user_id") % 10).alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "value")


def _day_events(hours, means, first, days):
    """One event per asset-day from day 21 on (`first` is day 1): the hours so far, zero where none came in between."""
    number = (F.date_diff(F.to_date("start"), F.lit(first)) + 1).alias("day")
    at = hours.select(F.col("asset").cast("int").alias("asset"), number, F.hour("start").alias("tau"), "f").where("day >= 21")
    slots = F.map_from_entries(F.collect_list(F.struct("tau", "f")))
    packed = at.groupBy("asset", "day").agg(slots.alias("m"), (F.max("tau") + 1).alias("t"))
    f = F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    placed = packed.withColumn("f", f).where("t < 24").join(means, "asset")
    return placed.select((F.col("asset") * days + F.col("day") - 1).cast("long").alias("event_id"), "asset", "day", "t", F.transform("f", lambda v: v / F.col("cap")).alias("f"), "e", X.lon(F.col("asset")).alias("lon"), X.lat(F.col("asset")).alias("lat"), F.col("day").alias("yday"))


def _static(spark, sf):
    ud = settle(X.user_day(spark, sf).where("day <= 20"))
    cap = ud.groupBy("asset").agg(F.greatest(F.max("f"), F.lit(1e-9)).alias("cap"))
    past = ud.join(cap, "asset").withColumns({"f": F.col("f") / F.col("cap"), "e": F.col("e") / F.col("cap"), "lon": X.lon(F.col("asset")), "lat": X.lat(F.col("asset")), "yday": F.col("day")})
    means = prep.pack(past.where("day = 1"), ["asset"], e="e").join(cap, "asset")
    return settle(past.select("curve_id", "tau", "f", "e", "lon", "lat", "yday")), settle(means)


@query("stream_forecast_update")
def stream_forecast_update(spark, sf):
    """Forecasts that each micro-batch's finished hours set off, from all hours so far and static history."""
    past, means = _static(spark, sf)
    packed = settle(prep.pack(past, ["curve_id", "lon", "lat", "yday"], f="f", e="e"))
    first, days = X.day_span(spark, sf)

    def update(new, hours):
        touched = new.select("asset", F.to_date("start").alias("_d")).distinct()
        so_far = hours.withColumn("_d", F.to_date("start")).join(touched, ["asset", "_d"], "left_semi")
        return updates.forecast(_day_events(so_far, means, first, days), packed, past, X.params(spark), 24, X.PER_HOUR, X.MINUTES)

    out = new_path(spark)
    updates.run_updates(_stream(spark, sf), out, new_path(spark), update)
    rows = spark.read.schema("event_id long, param_id int, t int, s int, focal double, lower double, upper double, batch long").parquet(f"{out}/updates")
    return rounded(rows.select("batch", "event_id", "param_id", "t", "s", "focal", "lower", "upper"))


_HOURLY_SQL = "WITH " + X.UD_SQL.strip() + ",\n" + X.PARAMS_SQL + f""",
closed AS (SELECT user_id % 10 AS asset, CAST(ts AS DATE) - d0 + 1 AS day, CAST(hour(ts) + 1 AS INTEGER) AS t FROM events, ub GROUP BY ALL
           HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)),
uscale AS (SELECT asset, greatest(max(f), 1e-9) AS cap FROM ud WHERE day <= 20 GROUP BY asset),
us AS (SELECT curve_id, asset, day, tau, f / cap AS f, e / cap AS e, -106 + 0.5::DOUBLE * ((7 * asset) % 25) AS lon, 26 + 0.4::DOUBLE * ((11 * asset) % 25) AS lat FROM ud JOIN uscale USING (asset)),
hist AS (SELECT * FROM us WHERE day <= 20),
dist0 AS (SELECT ev.curve_id * 24 + t AS event_id, t, param_id, h.curve_id,
  sum(CASE WHEN h.tau < t THEN power(0.5::DOUBLE, (t - 1 - h.tau) / forget_rate_f) * power(h.f - ev.f, 2) END) / sum(CASE WHEN h.tau < t THEN power(0.5::DOUBLE, (t - 1 - h.tau) / forget_rate_f) END) AS d_f,
  sum(power(0.5::DOUBLE, CASE WHEN h.tau < t THEN (t - 1 - h.tau) / forget_rate_e ELSE (h.tau - t) / lookup_rate END) * power(h.e - ev.e, 2)) / sum(power(0.5::DOUBLE, CASE WHEN h.tau < t THEN (t - 1 - h.tau) / forget_rate_e ELSE (h.tau - t) / lookup_rate END)) AS d_e,
  min({X.hav_sql('h.lon', 'h.lat', 'ev.lon', 'ev.lat')}) AS d_h, min({X.per_sql('h.day', 'ev.day')}) AS d_p, min({X.per_sql('ev.day', 'ev.day + gamma')}) AS big_gamma
  FROM closed JOIN us ev USING (asset, day) JOIN hist h USING (tau) CROSS JOIN params WHERE ev.day >= 21 AND t < 24 GROUP BY ALL),
dist AS (SELECT dist0.*, round(least(exp(-d_f / length_scale_f), exp(-d_e / length_scale_e)), 12) AS w, xi, kappa_min, kappa_max FROM dist0 JOIN params USING (param_id)),
{X.SEL_SQL},
chosen AS (SELECT event_id, t, param_id, curve_id, w / sum(w) OVER (PARTITION BY event_id, param_id) AS wn FROM sel WHERE in_final),
fused AS (SELECT event_id, t, param_id, tau - t AS s, f, e, wn FROM chosen JOIN hist USING (curve_id) WHERE tau >= t),
scen AS (SELECT event_id, t, param_id, s, f * (1 - ({X.LIE_SQL})) + e * ({X.LIE_SQL}) AS m, wn FROM fused JOIN params USING (param_id))
SELECT event_id // 24 AS event_id, param_id, t, CAST(s AS INTEGER) AS s, sum(wn * m) AS focal, quantile_disc(m, 0.1) AS lower, quantile_disc(m, 0.9) AS upper FROM scen GROUP BY ALL"""


@query("stream_stateful_update", sql_rounded(_HOURLY_SQL, "focal lower upper", "event_id param_id t s"))
def stream_stateful_update(spark, sf):
    """Forecasts as of every finished hour, from running distances in the stream's state."""
    return _stateful(spark, sf)


def _stateful(spark, sf, curves=N.CURVES):
    past, means = _static(spark, sf)
    first, days = X.day_span(spark, sf)
    out = new_path(spark)

    def as_events(hours):
        day = F.date_diff(F.to_date("start"), F.lit(first)) + 1
        at = hours.select(F.col("asset").cast("int").alias("asset"), "start", day.alias("day"), F.hour("start").alias("tau"), "f").where("day >= 21").join(means, "asset")
        ends = (F.to_date("start") + F.expr("INTERVAL 1 DAY")).cast("timestamp")
        return at.select((F.col("asset") * days + F.col("day") - 1).cast("long").alias("event_id"), "start", "tau", (F.col("f") / F.col("cap")).alias("f"), "e", X.lon(F.col("asset")).alias("lon"), X.lat(F.col("asset")).alias("lat"), F.col("day").alias("yday"), ends.alias("ends"))

    packed = settle(prep.pack(past, ["curve_id", "lon", "lat", "yday"], f="f", e="e"))
    state.run_stateful(_stream(spark, sf), out, new_path(spark), as_events, packed, past, X.params(spark), 24, X.PER_HOUR, X.MINUTES, curves=curves)
    rows = spark.read.schema("event_id long, param_id int, t int, s int, focal double, lower double, upper double").parquet(out)
    return rounded(rows.select("event_id", "param_id", "t", "s", "focal", "lower", "upper"))
