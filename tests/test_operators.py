"""Closed forms against brute force on tiny sets, invariants, and edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from curvecast.functions import curves as C
from curvecast.operators import bands, envelope, fpca, hist, prep, ranks, scores, tuning
from curvecast.operators import depth as D
from curvecast.operators import neighbors as N
from curvecast.plans import fixtures as X
from curvecast.plans import q_eval
from curvecast.plans.workdir import settle
from curvecast.streaming import updates

SF = "/root/testdata/sf0.001"


def curves(n=7, slots=5, seed=1, levels=4):
    rng = random.Random(seed)
    return {i: [float(rng.randrange(levels)) for _ in range(slots)] for i in range(n)}


def long(spark, sets):
    return spark.createDataFrame([(1, i, t, v) for i, row in sets.items() for t, v in enumerate(row)], "set_id long, curve_id long, tau int, v double")


def found(df, column="depth"):
    return {r["curve_id"]: r[column] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a), (a, b)


def test_mbd_equals_all_pairs_with_ties(spark):
    s = curves()
    pairs = list(itertools.combinations(s.values(), 2))
    want = {i: np.mean([[min(a, b) <= x <= max(a, b) for x, a, b in zip(row, p, q, strict=True)] for p, q in pairs]) for i, row in s.items()}
    close(found(D.mbd(long(spark, s))), want)
    y = np.array(list(s.values()))
    assert np.allclose(envelope.mbd_matrix(y), list(want.values()))


def test_bd_and_linf_equal_definitions(spark):
    s = curves(6, 3)
    want, linf = {}, {}
    for i, row in s.items():
        others = [r for j, r in s.items() if j != i]
        # pairs that contain the curve itself always hold it
        pairs = list(itertools.combinations(s.values(), 2))
        want[i] = np.mean([all(min(a, b) <= x <= max(a, b) for x, a, b in zip(row, p, q, strict=True)) for p, q in pairs])
        linf[i] = 1 / (1 + np.mean([max(abs(a - b) for a, b in zip(row, o, strict=True)) for o in others]))
    close(found(D.band(long(spark, s))), want)
    close(found(D.l_infinity(long(spark, s))), linf)


@pytest.mark.parametrize("block", [2, 3, 500])
def test_pair_depths_in_blocks_equal_definitions(spark, block):
    s = curves(8, 4, 9, 7)
    y, ids, x = np.array(list(s.values())), list(s), long(spark, s)
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    off = ~np.eye(len(y), dtype=bool)
    h = np.quantile(d[off], 0.15)
    close(found(D.modal(x, block=block)), dict(zip(ids, (np.exp(-0.5 * (d / h) ** 2) * off).sum(1), strict=True)))
    close(found(D.l_infinity(x, block=block)), dict(zip(ids, 1 / (1 + np.abs(y[:, None] - y[None]).max(-1).sum(1) / (len(y) - 1)), strict=True)))
    pairs = list(itertools.combinations(s.values(), 2))
    want = {i: np.mean([all(min(a, b) <= v <= max(a, b) for v, a, b in zip(row, p, q, strict=True)) for p, q in pairs]) for i, row in s.items()}
    close(found(D.band(x, block=block)), want)


def test_ks_gap_equals_a_numpy_histogram(spark):
    rng = np.random.default_rng(3)
    sets = {1: rng.uniform(0.1, 0.7, 2000), 2: rng.beta(2, 5, 300), 3: np.full(5, 0.25), 4: np.array([0.0, 1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, own in sets.items() for v in own], "k long, pit double")
    got = {r["k"]: (r["ks_rms"], r["ks_sup"]) for r in scores.ks_gap(df, "pit", ["k"]).collect()}
    for k, own in sets.items():
        gap = np.cumsum(np.histogram(own, 100, density=True)[0]) - np.arange(1, 101)
        assert np.allclose(got[k], (np.sqrt(np.mean(gap**2)) / 100, np.abs(gap).max()), atol=1e-6), k


def test_components_of_curves(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=(30, 6)) @ rng.normal(size=(6, 6)) + 1000
    x = long(spark, {i: row.tolist() for i, row in enumerate(y)})
    c = np.cov(y.T)
    got = {(r["tau1"], r["tau2"]): r["cov"] for r in fpca.covariance(x).collect()}
    assert len(got) == 21 and all(np.isclose(v, c[k], atol=1e-8) for k, v in got.items())
    phi, mu = fpca.fit(x, 6), fpca.mean(x)
    rows = phi.orderBy("k", "tau").collect()
    m = np.array([r["phi"] for r in rows]).reshape(6, 6)
    assert np.allclose(m @ m.T, np.eye(6), atol=1e-8)
    assert np.allclose(sorted({r["eigenvalue"] for r in rows}, reverse=True), np.linalg.eigvalsh(c)[::-1], atol=1e-6)
    p = phi.select("set_id", "k", "tau", "phi")
    score = fpca.project(x, mu, p)
    assert np.allclose([r["v"] for r in score.groupBy("k").agg(F.var_samp("score").alias("v")).orderBy("k").collect()], np.linalg.eigvalsh(c)[::-1], atol=1e-6)
    back = {(r["curve_id"], r["tau"]): r["v"] for r in fpca.reconstruct(score, mu, p).collect()}
    assert all(np.isclose(back[i, j], y[i, j], atol=1e-6) for i in range(30) for j in range(6))
    few = {(r["curve_id"], r["tau"]): r["v"] for r in fpca.reconstruct(fpca.project(x, mu, p.where("k <= 3")), mu, p.where("k <= 3")).collect()}
    left = sum((few[i, j] - y[i, j]) ** 2 for i in range(30) for j in range(6)) / 29
    assert np.isclose(left, np.linalg.eigvalsh(c)[:3].sum(), atol=1e-6)  # what three components leave out


def test_projection_depths_equal_definitions(spark):
    s = curves(9, 5, 6, 50)
    x = long(spark, s)
    p = {(r["curve_id"], r["j"]): r["p"] for r in D._projected(x, 20, 1).collect()}
    depth = lambda i, j: min(sum(p[o, j] <= p[i, j] for o in s), sum(p[o, j] >= p[i, j] for o in s)) / len(s)
    close(found(D.random_projection(x)), {i: np.mean([depth(i, j) for j in range(1, 21)]) for i in s})
    close(found(D.random_tukey(x)), {i: min(depth(i, j) for j in range(1, 21)) for i in s})
    close(found(D.REGISTRY["RP"](x)), found(D.random_projection(x)))


def test_models_find_what_made_the_labels(spark):
    rng = random.Random(1)
    rows = [(float(i % 3), rng.random(), rng.random()) for i in range(200)]
    df = spark.createDataFrame([(a, b, c, 3 * a - 2 * b + 1, 5.0 if b > 0.5 else 1.0) for a, b, c in rows], "a double, b double, c double, line double, step double")
    for lasso in (True, False):
        got = tuning.linear(df, ["a", "b", "c"], "line", lasso, [1e-4, 10.0])
        assert 20 < got.count() < 70 and all(abs(r["label"] - r["prediction"]) < 0.05 for r in got.collect())
    assert all(abs(r["label"] - r["prediction"]) < 0.5 for r in tuning.tree(df, ["a", "b", "c"], "step", [1, 3], [1, 5]).collect())


def test_envelope_bands_by_hand(spark):
    curve = {1: [0.0, 0.0], 2: [1.0, -1.0], 3: [-1.0, 1.0], 4: [2.0, 2.0]}
    scen = spark.createDataFrame([(7, 0, c, s, v) for c, row in curve.items() for s, v in enumerate(row)], "event_id long, param_id int, curve_id long, s int, m double")
    env = spark.createDataFrame([(7, 0, 1, 0), (7, 0, 2, 1), (7, 0, 3, 2)], "event_id long, param_id int, curve_id long, place int")
    sizes = spark.createDataFrame([(7, 0, 4)], "event_id long, param_id int, n_scenarios long")
    got = {(r["fraction"], r["s"]): (r["center"], r["lower"], r["upper"]) for r in envelope.functional_bands(scen, env, sizes, [0.25, 0.5, 0.75]).collect()}
    assert got[0.25, 0] == (0.0, None, None) and got[0.5, 0] == (0.0, 1.0, 1.0) and got[0.75, 0] == (0.0, -1.0, 1.0) and got[0.75, 1] == (0.0, -1.0, 1.0)


def test_envelope_scores_equal_plain_python(spark):
    ny, scen = X.scenarios(spark, SF, X.T, X.PARAM_ROWS[:1])
    scen = settle(scen.withColumnRenamed("wn", "w"))
    y = {(r["event_id"], r["s"]): r["y"] for r in X.truth(ny).collect()}
    env = {kind: {(r["event_id"], r["curve_id"]): r["place"] for r in envelope.focal_envelope(scen, kind).collect()} for kind in ("sup", "similarity")}
    m: dict = {}
    for r in scen.collect():
        m.setdefault(r["event_id"], {}).setdefault(r["curve_id"], {})[r["s"]] = r["m"]
    rows = q_eval._envelope_scores(spark, SF, scen, ny).where("distance <> 'l2'").collect()
    assert len(rows) > 500
    for r in rows:
        own = m[r["event_id"]]
        k = math.floor(r["fraction"] * len(own))
        inside = [own[c] for c in own if 1 <= env[r["distance"]].get((r["event_id"], c), -1) < k]
        wis = hits = 0
        for s in range(X.SLOTS - X.T):
            lo, hi, v = min(c[s] for c in inside), max(c[s] for c in inside), y[r["event_id"], s]
            wis += (hi - lo) + 2 / r["alpha"] * (max(lo - v, 0) + max(v - hi, 0))
            hits += lo <= v <= hi
        assert math.isclose(r["wis"], wis, abs_tol=1e-9) and math.isclose(r["fcs"], hits / (X.SLOTS - X.T)) and r["k"] == k


def test_streamed_forecasts_equal_those_of_the_finished_hours(spark):
    rows = q_eval.stream_forecast_update(spark, SF).collect()
    last = {}
    for r in rows:
        last[r["event_id"]] = max(last.get(r["event_id"], -1), r["batch"])
    closed = q_eval.stream_dynamic_update(spark, SF).select("asset", (F.to_timestamp("day").cast("long") + F.col("tau") * 3600).cast("timestamp").alias("start"), "f")
    past, means = q_eval._static(spark, SF)
    packed = prep.pack(past, ["curve_id", "lon", "lat", "yday"], f="f", e="e")
    want = updates.forecast(q_eval._day_events(closed, means, *X.day_span(spark, SF)), packed, past, X.params(spark), 24, X.PER_HOUR, X.MINUTES)
    want = {(r["event_id"], r["param_id"], r["t"], r["s"]): (r["focal"], r["lower"], r["upper"]) for r in want.collect()}
    got = {(r["event_id"], r["param_id"], r["t"], r["s"]): (r["focal"], r["lower"], r["upper"]) for r in rows if r["batch"] == last[r["event_id"]]}
    assert want and all(np.allclose(got[k], v, atol=1e-5) for k, v in want.items())


def test_depths_do_not_depend_on_row_order(spark):
    x = long(spark, curves(9, 4, 3))
    for fn in D.REGISTRY.values():
        close(found(fn(x)), found(fn(x.orderBy(F.rand(5)).repartition(3))))


def test_crps_ensemble_equals_pairs(spark):
    rng = random.Random(4)
    m = [rng.random() for _ in range(9)]
    df = spark.createDataFrame([(1, 0, i, 0, v, 0.4) for i, v in enumerate(m)], "event_id long, param_id int, curve_id long, s int, m double, y double")
    want = np.mean([abs(a - 0.4) for a in m]) - np.mean([abs(a - b) for a in m for b in m]) / 2
    assert math.isclose(scores.crps_ensemble(df).first()["crps"], want, abs_tol=1e-12)


def test_normal_cdf(spark):
    xs = [-40.0, -8.0, -7.2, -1.3, 0.0, 0.4, 2.5, 7.3, 39.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(C.normal_cdf(F.col("x"))).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], atol=1e-15)


def test_trust_runs_from_zero(spark):
    df = spark.range(0, 200).select(C.lie_trust(F.col("id"), 2.0, 0.9, 5.0).alias("e"))
    e = [r[0] for r in df.collect()]
    assert abs(e[0]) < 1e-12 and all(a <= b for a, b in zip(e, e[1:], strict=False)) and e[-1] < 0.9


def test_ecdf_ranks_are_exact_and_bands_nest(spark):
    df = spark.createDataFrame([(1, 0, i, 0, float(i)) for i in range(1, 21)], "event_id long, param_id int, curve_id long, s int, m double")
    rows = {r["alpha"]: (r["lower"], r["upper"]) for r in bands.ecdf_band(df, [0.1, 0.2, 0.4]).collect()}
    assert rows[0.4] == (4.0, 16.0)
    assert rows[0.1][0] <= rows[0.2][0] <= rows[0.4][0] <= rows[0.4][1] <= rows[0.2][1] <= rows[0.1][1]


def test_last_bin_is_closed(spark):
    got = spark.createDataFrame([(0.0,), (99.9,), (100.0,), (100.1,)], "x double").select(hist.bin_of(F.col("x"), 0.0, 100.0, 25)).collect()
    assert [r[0] for r in got] == [1, 25, 25, None]


def scored_rows(w, d_h=None, d_p=None, xi=0.5, lo=2, hi=3):
    return [(1, 0, i, float(v), float((d_h or [0] * len(w))[i]), float((d_p or [0] * len(w))[i]), 0.5, xi, lo, hi) for i, v in enumerate(w)]


SCHEMA = "event_id long, param_id int, curve_id long, w double, d_h double, d_p double, big_gamma double, xi double, kappa_min int, kappa_max int"


def final(df):
    return sorted(r["curve_id"] for r in df.where("in_final").collect())


def test_selection_cases(spark):
    make = lambda *a, **k: N.select(spark.createDataFrame(scored_rows(*a, **k), SCHEMA))
    assert final(make([0.9, 0.8, 0.1])) == [0, 1]  # between the bounds
    assert final(make([0.9, 0.3, 0.3, 0.1])) == [0, 1, 2]  # too few: ties of the second weight stay
    assert final(make([0.9] * 5, d_h=[5, 1, 1, 1, 1])) == [1, 2, 3]  # too many: nearest, ties by id
    assert final(make([0.9] * 5, d_h=[1, 2, 3, 4, 5], d_p=[1, 1, 0, 0, 0])) == [2, 3, 4]  # days first
    assert final(make([0.9] * 5, d_p=[1, 1, 1, 1, 0])) == [4]  # fewer than kappa_min are left


def test_blocks_and_pruning_keep_the_selection(spark):
    _, weighted, past = X._sides(spark, SF, X.T, X.PARAM_ROWS)
    keys = ["event_id", "param_id", "curve_id"]
    full = settle(N.select(N.distances(weighted, past)).where("in_final").select(keys))
    assert full.count() > 0
    for event_rows, curves in ((1000, 4000), (40, 9)):
        near = settle(N.near(weighted, past, event_rows, curves))
        chosen = N.select(near).where("in_final").select(keys)
        assert full.exceptAll(chosen).count() == 0 and chosen.exceptAll(full).count() == 0
    assert near.count() < weighted.count() * past.count()


def test_distances_by_products_equal_differences(spark):
    _, weighted, past = X._sides(spark, SF, X.T, X.PARAM_ROWS)
    a, b = (N.distances(weighted, past, product=p, curves=50) for p in (False, True))
    both = a.alias("a").join(b.alias("b"), ["event_id", "param_id", "curve_id"])
    assert both.count() == weighted.count() * past.count()
    assert both.where("abs(a.d_f - b.d_f) > 1e-9 or abs(a.d_e - b.d_e) > 1e-9").count() == 0


def test_no_active_slot_gives_null_distance(spark):
    ny = X.nation_year(spark, SF)
    w = N.with_weights(X.events(ny), X.params(spark), X.SLOTS, X.PER_HOUR, [False] * 12)
    assert N.distances(w, X.history(ny)).where("d_f is not null").count() == 0


def test_pack_and_unpack(spark):
    x = long(spark, curves())
    assert prep.unpack(prep.pack(x, ["set_id", "curve_id"], v="v"), ["set_id", "curve_id"], v="v").exceptAll(x).count() == 0


def test_envelope_surrounds_and_orders():
    y = np.array([[0.0, 0, 0], [1, 1, 1], [-1, -1, -1], [5, 5, 5], [-5, -5, -5.0]])
    order = envelope.greedy_envelope(y, None, "l2")
    assert order[0] == 0 and {1, 2} <= set(order)


def test_smoother_keeps_cubics():
    x = np.arange(13.0)
    m = envelope.spline_smoother(13, x, 7)
    assert np.allclose(m @ (x**3 - 4 * x), x**3 - 4 * x)


def test_empty_inputs(spark):
    x = long(spark, {0: [1.0]}).where("false")
    for fn in D.REGISTRY.values():
        assert fn(x).count() == 0


def test_random_split_is_spread_and_reproducible(spark):
    days = spark.range(3650).selectExpr("date_add(date'1992-01-01', cast(id AS int)) AS day", "id")
    test = sorted(r["id"] for r in days.withColumn("split", prep.random_split(F.col("day"), 10)).where("split = 'test'").collect())
    again = sorted(r["id"] for r in days.repartition(5).withColumn("split", prep.random_split(F.col("day"), 10)).where("split = 'test'").collect())
    gaps = {b - a for a, b in itertools.pairwise(test)}
    assert test == again and 280 < len(test) < 450
    assert len(gaps) > 15 and {i % 10 for i in test} == set(range(10)) and len({i % 7 for i in test}) == 7


def gappy(seed=5, n=40, slots=12):
    """Curves of two smooth components and noise, whole (below 30) or with gaps."""
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 1, slots)
    y = 3 + rng.normal(size=(n, 2)) * [2.0, 1.0] @ np.array([np.sin(np.pi * t), np.cos(np.pi * t)]) + 0.1 * rng.normal(size=(n, slots))
    seen = rng.random((n, slots)) < 0.5
    seen[:30] = True
    seen[38], seen[39] = False, np.arange(slots) == 3
    return y, seen


def test_scores_and_curves_of_partial_days_equal_numpy(spark):
    y, seen = gappy()
    rows = [(s, i, t, float(v) if seen[i, t] else None) for s in (1, 2) for i, row in enumerate(y) for t, v in enumerate(row) if seen[i, t] or t % 2]
    x = spark.createDataFrame(rows, "set_id long, curve_id long, tau int, v double")
    train = x.where("curve_id < 30")
    mu, error = fpca.mean(train), fpca.noise(train)
    second = y[:30, 2:] - 2 * y[:30, 1:-1] + y[:30, :-2]
    s2 = (second**2).mean() / 6
    assert all(np.isclose(r["sigma2"], s2) for r in error.collect()) and 0.005 < s2 < 0.03  # 0.01 and what is curved
    phi = settle(fpca.fit(train, share=0.95, error=error))
    value, vector = np.linalg.eigh(np.cov(y[:30].T) - s2 * np.eye(12))
    value, vector = value[::-1], vector[:, ::-1]
    k = int(np.searchsorted(np.cumsum(np.maximum(value, 0)), 0.95 * np.maximum(value, 0).sum()) + 1)
    assert sorted({(r["set_id"], r["k"]) for r in phi.collect()}) == [(s, i + 1) for s in (1, 2) for i in range(k)] and k == 2
    p = vector[:, :k] * np.sign(vector[np.abs(vector[:, :k]).argmax(0), np.arange(k)])
    for block in (3, 2000):  # a set in many parts or in one
        got = {(r["set_id"], r["curve_id"], r["k"]): r["score"] for r in fpca.expected_scores(x, mu, phi, error, block).collect()}
        assert {c for _, c, _ in got} == set(range(40)) - {38}  # nothing is known of that one
        for i in set(range(40)) - {38}:
            o = seen[i]
            want = value[:k] * (p[o].T @ np.linalg.solve((p[o] * value[:k]) @ p[o].T + s2 * np.eye(o.sum()), y[i, o] - y[:30, o].mean(0)))
            assert all(np.isclose(got[s, i, j + 1], want[j], atol=1e-7) for s in (1, 2) for j in range(k)), i
    whole = fpca.reconstruct(fpca.expected_scores(x, mu, phi, error), mu, phi.select("set_id", "k", "tau", "phi"))
    back = {(r["curve_id"], r["tau"]): r["v"] for r in whole.where("set_id = 1").collect()}
    plain = fpca.reconstruct(fpca.project(x.where("v IS NOT NULL"), mu, phi.select("set_id", "k", "tau", "phi")), mu, phi.select("set_id", "k", "tau", "phi"))
    naive = {(r["curve_id"], r["tau"]): r["v"] for r in plain.where("set_id = 1").collect()}
    gap = [(i, t) for i in range(30, 38) for t in range(12) if not seen[i, t]]
    rms = lambda f: np.sqrt(np.mean([(f[i, t] - y[i, t]) ** 2 for i, t in gap]))
    assert rms(back) < 0.3 < rms(naive)  # what was never seen is predicted; plain products can't


def test_no_component_without_variance_and_k_by_set(spark):
    flat = {i: [2.0] * 6 for i in range(5)}
    x = long(spark, flat)
    phi = fpca.fit(x, share=0.9, error=fpca.noise(x))
    got = fpca.expected_scores(x, fpca.mean(x), phi, fpca.noise(x)).collect()
    assert {r["curve_id"] for r in got} == set(range(5)) and all(r["score"] == 0 for r in got)
    rng = np.random.default_rng(3)
    one, many = np.outer(rng.normal(size=30), np.arange(8.0)), rng.normal(size=(30, 8))
    both = spark.createDataFrame([(s, i, t, float(v)) for s, y in ((1, one), (2, many)) for i, row in enumerate(y) for t, v in enumerate(row)], "set_id long, curve_id long, tau int, v double")
    assert [r["n"] for r in fpca.fit(both, share=0.9).groupBy("set_id").agg(F.max("k").alias("n")).orderBy("set_id").collect()][0] == 1
    assert [r["n"] for r in fpca.fit(both, share=0.9).groupBy("set_id").agg(F.max("k").alias("n")).orderBy("set_id").collect()][1] > 4


def test_no_event_meets_its_own_fold(spark):
    """One search leaves each fold out; the same as a search for each fold alone, whatever the blocks."""
    curves = settle(X.user_curves(spark, SF).where("day <= 6"))
    packed = settle(prep.pack(curves, X.UC_KEYS, f="f", e="e").withColumn("fold", F.col("day")))
    events = N.with_weights(prep.make_event(packed, 12).withColumnRenamed("curve_id", "event_id"), X.params(spark), 24, 1.0)
    key = lambda df: sorted(map(tuple, df.where("in_final").select("event_id", "param_id", "curve_id").collect()))
    once = key(N.select(N.near(settle(events), packed)))
    assert once == key(N.select(N.near(settle(events), packed, 3, 7))) == key(N.select(N.distances(events, packed)))
    apart = [x for day in range(1, 7) for x in key(N.select(N.near(events.where(f"day = {day}").drop("fold"), packed.where(f"day <> {day}").drop("fold"))))]
    assert once == sorted(apart) and once


def test_masks_of_events(spark):
    events = spark.createDataFrame([(1,), (2,)], "event_id long")
    flags = spark.createDataFrame([(1, 0, False), (1, 2, True)], "event_id long, tau int, active boolean")
    got = {r["event_id"]: r["active"] for r in prep.mask_arrays(events, flags, 3).collect()}
    assert got == {1: [False, True, True], 2: [True, True, True]}


def test_quantiles_and_ranks_of_a_hot_group_spread_over_tasks(spark):
    rng = np.random.default_rng(8)
    hot = rng.integers(0, 3000, 20_000).astype(float)
    rows = [("hot", float(v)) for v in hot] + [("tied", 5.0)] * 3000 + [(None, 1.0), (None, 3.0), ("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]
    got = {r["g"]: r["q"] for r in ranks.quantiles(df, ["g"], "v", probs, parts=7).collect()}
    assert np.allclose(got["hot"], np.quantile(hot, probs)) and got["tied"] == [5.0] * 6 and got["one"] == [7.0] * 6 and np.allclose(got[None], [1, 1.05, 1.6, 2, 2.95, 3]) and "none" not in got
    least = {r["g"]: r["q"] for r in ranks.quantiles(df, ["g"], "v", probs, discrete=True, parts=3).collect()}
    assert least["hot"] == np.quantile(hot, probs, method="inverted_cdf").tolist()
    at = ranks.cumulated(df.where("v is not null"), ["g"], F.col("v").desc(), parts=7)
    want = df.where("v is not null").withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc())))
    assert sorted(map(repr, ((r["g"], r["v"], r["_upto"] - r["_own"] + 1) for r in at.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    counts = df.where("v is not null").groupBy("g", "v").count()
    per = settle(counts.repartitionByRange(7, "g", "v").withColumn("p", F.spark_partition_id())).where("g = 'hot'").groupBy("p").count().collect()
    assert len(per) >= 5 and max(r["count"] for r in per) < 1500


def test_kde_bands_equal_numpy_on_the_full_grid(spark):
    rng = random.Random(8)
    sets = {0: [rng.random() for _ in range(15)], 1: [0.4] * 9, 2: [0.1] * 6 + [0.9], 3: [rng.random() * 0.05 for _ in range(4)]}
    scen = spark.createDataFrame([(1, 0, s, i, m) for s, ms in sets.items() for i, m in enumerate(ms)], "event_id long, param_id int, s int, curve_id long, m double")
    x = np.linspace(0, 1, 1000)
    for width in (None, 0.05):
        got = {r["s"]: (r["lower"], r["upper"]) for r in bands.kde_band(scen, 0.2, width).collect()}
        for s, ms in sets.items():
            m = np.array(ms)
            silverman = 0.9 * min(m.std(), (np.percentile(m, 75) - np.percentile(m, 25)) / 1.34) * len(m) ** -0.2
            c = np.cumsum(np.exp(-0.5 * ((x[:, None] - m) / (width or max(silverman, 1 / 999))) ** 2).sum(axis=1))
            assert np.allclose(got[s], np.interp([0.1, 0.9], c / c[-1], x), atol=1e-9)


def test_curves_reach_tasks_as_arrays_and_leave_as_pairs(spark):
    """No Python object a slot, no set's partial sums whole in a task; slots without a value count as missing."""
    rng = np.random.default_rng(11)
    y = rng.normal(size=(2500, 5))
    y[::3, 2], y[1::4, 4] = np.nan, np.nan  # more curves than a task lays out at once
    rows = [(1, i, t, None if np.isnan(v) else float(v)) for i, row in enumerate(y) for t, v in enumerate(row)]
    x = spark.createDataFrame([*rows, (2, 9, 7, 1.0)], "set_id long, curve_id long, tau int, v double")
    cov = fpca.covariance(x)
    assert "FlatMapGroups" not in cov._jdf.queryExecution().executedPlan().toString()
    got = {(r["set_id"], r["tau1"], r["tau2"]): r["cov"] for r in cov.collect()}
    assert got.pop((2, 7, 7)) is None and len(got) == 15
    for (_, i, j), c in got.items():
        both = ~np.isnan(y[:, i]) & ~np.isnan(y[:, j])
        assert np.isclose(c, np.cov(y[both, i], y[both, j])[0, 1], atol=1e-10)
    error, phi = fpca.noise(x.where("set_id = 1")), fpca.fit(x.where("set_id = 1"), 2)
    plan = fpca.expected_scores(x, fpca.mean(x), phi, error)._jdf.queryExecution().analyzed().treeString()
    at = next(line for line in plan.splitlines() if "FlatMapCoGroups" in line)
    assert "taus#" in at and "vs#" in at


def test_models_are_fitted_one_at_a_time(spark, monkeypatch):
    """Threads of a CrossValidator share the local properties of one Java object, so that fits in parallel fail by chance."""
    seen, fit = [], tuning.CrossValidator.fit
    monkeypatch.setattr(tuning.CrossValidator, "fit", lambda self, *a: seen.append(self.getParallelism()) or fit(self, *a))
    df = spark.createDataFrame([(float(i % 7), i % 7 * 2.0) for i in range(60)], "a double, y double")
    assert tuning.linear(df, ["a"], "y", False, [1e-4]).count() >= 0 and seen == [1]


@pytest.mark.parametrize(("make", "asset_years"), [(X.nation_year, "y < 2000"), (X.supplier_year, "y < 2000"), (X.user_curves, "true")])
def test_largest_share_is_one_however_sums_come_out(spark, monkeypatch, make, asset_years):
    """Floating sums taken twice differ in their last bits on a cluster (here by a noise of their own); shares at the capacity tie all the same."""
    noisy = F.udf(lambda v: v * (1 + 1e-13 * random.SystemRandom().random()), "double").asNondeterministic()
    plain = X.t

    def table(spark, sf, name):
        df = plain(spark, sf, name)
        for c in {"o_totalprice", "l_extendedprice", "value"} & set(df.columns):
            df = df.withColumn(c, noisy(c))
        return df

    monkeypatch.setattr(X, "t", table)
    spark.conf.set("spark.sql.exchange.reuse", "false")  # filters keep larger plans from it; this one would be spared the second sum
    try:
        most = [r["m"] for r in make(spark, SF).where(asset_years).groupBy("asset").agg(F.max("f").alias("m")).collect()]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(most) >= 10 and set(most) == {1.0}


def test_reconstruction_covers_every_slot(spark, tmp_path):
    """Longer vectors than those of the given tables: all slots are fitted and come back."""
    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(70)], i % 2) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["curve_id"], r["tau"]): r["v"] for r in q_eval.fpca_reconstruct(spark, str(tmp_path)).collect()}
    assert set(got) == {(i, k) for i in range(12) for k in range(70)}
    for label in (0, 1):
        x = np.array([[float(np.float32(v)) for v in row] for i, row, own in rows if own == label])
        d = x - x.mean(axis=0)
        top = np.linalg.svd(d, full_matrices=False)[2][:4]
        want = x.mean(axis=0) + d @ top.T @ top
        assert all(math.isclose(got[i, k], want[i // 2, k], abs_tol=2e-6) for i in range(label, 12, 2) for k in range(70))
