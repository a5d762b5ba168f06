"""Distances from update events to historical curves, and the neighbours that they select."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvecast.functions import curves as C

KEYS = ["event_id", "param_id"]


def with_weights(events: DataFrame, params: DataFrame, slots: int, per_hour: float, active: list[bool] | None = None) -> DataFrame:
    """Events x parameter sets (few rows) with the weight arrays phi and psi, nought where inactive: by the
    one list `active` or, where events have such a column (an array of flags), by each event's own."""
    grid = F.sequence(F.lit(0), F.lit(slots - 1))
    own = F.transform("active", lambda a: a.cast("double")) if "active" in events.columns else F.array_repeat(F.lit(1.0), slots)
    on = F.array(*[F.lit(float(a)) for a in active]) if active else own
    both = events.crossJoin(params)
    phi = F.transform(F.slice(grid, 1, F.col("t")), lambda i: C.growth(i, F.col("t"), F.col("forget_rate_f"), per_hour) * F.element_at(on, i + 1))
    psi = F.transform(grid, lambda i: C.psi(i, F.col("t"), F.col("forget_rate_e"), F.col("lookup_rate"), per_hour) * F.element_at(on, i + 1))
    return both.withColumns({"phi": phi, "psi": psi})


#: Rows of events and of curves in a block; a task holds one of each.
EVENT_ROWS, CURVES = 1000, 4000
_SCORED = "event_id long, param_id int, curve_id long, d_f double, d_e double, d_h double, d_p double, big_gamma double, xi double, kappa_min int, kappa_max int, w_f double, w_e double, w double, sim_here long"
_CURVE = ("curve_id", "f", "e", "lon", "lat", "yday")


def _dense(rows: pd.Series, slots: int) -> np.ndarray:
    out = np.zeros((len(rows), slots))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _haversine(lon1, lat1, lon2, lat2):
    lon1, lat1, lon2, lat2 = (np.radians(x) for x in (lon1, lat1, lon2, lat2))
    h = np.sin((lat1 - lat2) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon1 - lon2) / 2) ** 2
    return 2 * C.EARTH_KM * np.arcsin(np.sqrt(h))


def _periodic(a, b):
    return np.sin(0.5 * (360.0 / 365.0) * (a - b) * np.pi / 180.0) ** 2


def _needed(w, d_h, d_p, curve, big_gamma, xi, lo, hi) -> np.ndarray:
    """Of one event and one block of curves, the rows that selection can need.

    These are, of the similar rows, the hi nearest of the season (more can't be chosen) and, if they
    are no more than hi, all; and the lo (and one) largest weights with their ties, for the fallback.
    """
    sim = w >= xi
    keep = np.zeros(len(w), dtype=bool)
    if sim.sum() <= hi:
        keep |= sim
    season = np.flatnonzero(sim & (d_p <= big_gamma))
    keep[season[np.lexsort((curve[season], d_h[season]))[:hi]]] = True
    known = w[~np.isnan(w)]
    if len(known):
        keep |= w >= np.sort(known)[::-1][min(lo, len(known) - 1)]
    return keep


def _score_block(ev: pd.DataFrame, past: pd.DataFrame, whole: bool, product: bool) -> pd.DataFrame:
    """The rows of one block of events against one of curves: all (whole) or those needed."""
    events, out = [], []
    if len(ev) and len(past):
        slots = max(past["e"].map(len).max(), ev["e"].map(len).max())
        hf, he = _dense(past["f"], slots), _dense(past["e"], slots)
        curve, lon, lat, day, fold = (past[c].to_numpy() for c in ("curve_id", "lon", "lat", "yday", "fold"))
        for r in ev.itertuples(index=False):
            d = []
            for x, v, weight in ((hf, r.f, r.phi), (he, r.e, r.psi)):
                n, weight = len(weight), np.asarray(weight, dtype=float)
                v = np.asarray(v, dtype=float)[:n]
                if product:  # sum w (X - x)^2 = X^2 w - 2 X (w x) + sum w x^2
                    sums = np.maximum((x[:, :n] ** 2) @ weight - 2 * x[:, :n] @ (weight * v) + (weight * v**2).sum(), 0)
                else:
                    sums = (x[:, :n] - v) ** 2 @ weight
                total = weight.sum()
                d.append(sums / total if total > 0 else np.full(len(x), np.nan))
            d_h, d_p = _haversine(lon, lat, r.lon, r.lat), _periodic(day, r.yday)
            big = _periodic(r.yday, r.yday + r.gamma)
            w_f, w_e = np.exp(-d[0] / r.length_scale_f), np.exp(-d[1] / r.length_scale_e)
            w = np.where(fold == r.fold, np.nan, np.fmin(w_f, w_e))  # curves of the event's own fold are left out
            sim = w >= r.xi
            keep = fold != r.fold if whole else _needed(w, d_h, d_p, curve, big, r.xi, r.kappa_min, r.kappa_max)
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            here = sim[at].astype(np.int64)
            if not whole:
                here[:] = 0
                here[0] = sim.sum()
            events.append((r.event_id, r.param_id, big, r.xi, r.kappa_min, r.kappa_max, len(at)))
            out.append((curve[at], d[0][at], d[1][at], d_h[at], d_p[at], w_f[at], w_e[at], w[at], here))
    if not out:
        return pd.DataFrame({c.split()[0]: [] for c in _SCORED.split(", ")})
    # One table a block: making one an event would cost more than the distances.
    by_event = pd.DataFrame(events, columns=["event_id", "param_id", "big_gamma", "xi", "kappa_min", "kappa_max", "n"])
    by_row = dict(zip(("curve_id", "d_f", "d_e", "d_h", "d_p", "w_f", "w_e", "w", "sim_here"), map(np.concatenate, zip(*out))))
    rows = {c: np.repeat(by_event[c].to_numpy(), by_event["n"]) for c in by_event.columns[:-1]} | by_row
    return pd.DataFrame({c.split()[0]: rows[c.split()[0]] for c in _SCORED.split(", ")})


#: Events and curves of one product, pairs worked out exactly at once, and the allowance for a product's rounding.
_TILE_EVENTS, _TILE_CURVES, _PAIRS, _ROUNDING = 256, 4096, 200_000, 4e-6


def _exact(x: np.ndarray, v: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Mean square differences of events i and curves j; curves alike give the same to the last bit."""
    total = w.sum(axis=1)
    parts = [(((x[j[k : k + _PAIRS]] - v[i[k : k + _PAIRS]]) ** 2) * w[i[k : k + _PAIRS]]).sum(axis=1) / total[i[k : k + _PAIRS]] for k in range(0, len(i), _PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _within(i: np.ndarray, n: int) -> np.ndarray:
    """The place of each row among those of its event, of rows in order of events."""
    return np.arange(len(i)) - np.searchsorted(i, np.arange(n))[i]


#: Kinds of weights up to which curves are scaled for each.
_KINDS = 16


def _factors(x: np.ndarray, v: np.ndarray, w: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product is sum w (x - v)^2 of each event and curve; one: all events have the same w, and half the columns do."""
    if one:
        root = np.sqrt(w[0])[w[0] > 0]
        z, y = x[:, w[0] > 0] * root, v[:, w[0] > 0] * root
        left, right = [-2 * y, np.ones((len(y), 1)), (y**2).sum(axis=1)[:, None]], [z.T, (z**2).sum(axis=1)[None], np.ones((1, len(z)))]
    else:
        left, right = [w, -2 * w * v, (w * v**2).sum(axis=1)[:, None]], [(x**2).T, x.T, np.ones((1, len(x)))]
    return np.hstack(left).astype(np.float32), np.vstack(right).astype(np.float32)


def _candidates(left, right, slack, bar, want, own, fold) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (event, curve) that may be similar, or among the `want` of least q, in order of events.

    q, the larger of both sides, is at least half their sum, which takes one product and one look a
    tile; the pairs that it leaves get their q.
    """
    n, folds = len(bar), bool(np.isin(own, fold).any())
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    most, least, found = np.full(n, np.inf), none, []  # most: a bound on q of the largest weights; least: events and q of those
    both, curves = (np.hstack(left), np.vstack(right)), [np.ascontiguousarray(r.T) for r in right]
    for c in range(0, right[0].shape[1], _TILE_CURVES):
        at = slice(c, c + _TILE_CURVES)
        if np.isinf(most).any():
            q = np.maximum(left[0] @ right[0][:, at], left[1] @ right[1][:, at])
            if folds:
                q[own[:, None] == fold[None, at]] = np.inf
            if q.shape[1] >= want:
                most = np.minimum(most, np.partition(q, want - 1, axis=1)[:, want - 1])
        limit = np.maximum(most, bar) + 2 * slack
        total = both[0] @ both[1][:, at]
        i, j = np.divmod(np.flatnonzero((total <= (2 * limit).astype(np.float32)[:, None]).ravel()), total.shape[1])
        j += c
        if folds:
            i, j = i[own[i] != fold[j]], j[own[i] != fold[j]]
        q = np.concatenate([np.maximum(*(np.einsum("ij,ij->i", m[i[k : k + _PAIRS]], x[j[k : k + _PAIRS]]) for m, x in zip(left, curves))) for k in range(0, len(i), _PAIRS)] or [none[1]])
        keep = q <= limit[i]
        i, j, q = i[keep], j[keep], q[keep]
        found.append((i, j, q))
        lower = (q < most[i]) & (most[i] > bar[i])  # what has been found lowers the bound, where it is not that of similar curves
        i, q = np.concatenate([least[0], i[lower]]), np.concatenate([least[1], q[lower]])
        order = np.lexsort((q, i))
        i, q = i[order], q[order]
        place = _within(i, n)
        least, last = (i[place < want], q[place < want]), place == want - 1
        most[i[last]] = np.minimum(most[i[last]], q[last])
    i, j, q = map(np.concatenate, zip(*found))
    keep = np.flatnonzero(q <= (np.maximum(most, bar) + 2 * slack)[i])
    keep = keep[np.argsort(i[keep], kind="stable")]
    return i[keep], j[keep]


def _needed_block(ev: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
    """The needed rows of one block of events against one of curves, as _score_block finds them, by matrix products.

    Products give distances up to rounding, and with them q = max(d_f / l_f, d_e / l_e), of which the weight is
    exp(-q). Curves that may be similar, or among the kappa_min + 1 of largest weight, are told by q with an allowance
    for rounding; these few are worked out exactly. Events go by their kind of weights, if these are few.
    """
    plain = lambda: _score_block(ev, past, False, False)
    if not len(ev) or not len(past):
        return plain()
    slots = max(past["e"].map(len).max(), ev["e"].map(len).max())
    sides = [(_dense(past[c], slots), _dense(ev[c], slots), _dense(ev[w], slots), ev[scale].to_numpy(dtype=float)) for c, w, scale in (("f", "phi", "length_scale_f"), ("e", "psi", "length_scale_e"))]
    # Lengths that differ, weights of nought and what is no number take the plain way.
    uneven = any((ev[w].map(len) > np.minimum(ev[c].map(len), past[c].map(len).min())).any() for c, w in (("f", "phi"), ("e", "psi")))
    if uneven or not all(np.isfinite(m).all() for side in sides for m in side) or any((w.sum(axis=1) <= 0).any() or (w < 0).any() or (scale <= 0).any() for *_, w, scale in sides) or (ev["xi"] <= 0).any():
        return plain()
    slack, scaled = np.full(len(ev), _ROUNDING), []
    for x, v, w, scale in sides:
        w = w / (w.sum(axis=1) * scale)[:, None]
        scaled.append(w)
        slack += _ROUNDING * (w * (np.abs(v) + np.abs(x).max(axis=0)) ** 2).sum(axis=1)
    xi, lo, hi = (ev[c].to_numpy() for c in ("xi", "kappa_min", "kappa_max"))
    curve, fold, own = past["curve_id"].to_numpy(), past["fold"].to_numpy(), ev["fold"].to_numpy()
    place, at_event = ([df[c].to_numpy(dtype=float) for c in ("lon", "lat", "yday")] for df in (past, ev))
    big = _periodic(at_event[2], at_event[2] + ev["gamma"].to_numpy())
    bar = -np.log(xi.astype(float))
    kinds, kind = np.unique(np.hstack(scaled), axis=0, return_inverse=True)
    kind, one, out = kind.ravel(), len(kinds) <= _KINDS, []
    for rows in [np.flatnonzero(kind == k) for k in range(len(kinds))] if one else [np.arange(len(ev))]:
        left, right = zip(*(_factors(x, v[rows], w[rows], one) for (x, v, *_), w in zip(sides, scaled)))
        for a in range(0, len(rows), _TILE_EVENTS):
            at, here = rows[a : a + _TILE_EVENTS], slice(a, a + _TILE_EVENTS)
            i, j = _candidates([m[here] for m in left], right, slack[at], bar[at], int(lo[at].max()) + 1, own[at], fold)
            out.append(_worked_out(ev, at, i, j, sides, xi, lo, hi, big, curve, place, at_event))
    return pd.concat(out, ignore_index=True)


def _worked_out(ev, at, i, j, sides, xi, lo, hi, big, curve, place, at_event) -> pd.DataFrame:
    """Exact rows of the pairs (i among the events `at`, j) that are needed; pairs come in order of events."""
    n, i = len(at), np.asarray(i)
    e = at[i]
    d_f, d_e = (_exact(x, v, w, e, j) for x, v, w, _ in sides)
    w_f, w_e = np.exp(-d_f / sides[0][3][e]), np.exp(-d_e / sides[1][3][e])
    w = np.fmin(w_f, w_e)
    d_h, d_p = _haversine(place[0][j], place[1][j], at_event[0][e], at_event[1][e]), _periodic(place[2][j], at_event[2][e])
    sim = w >= xi[e]
    n_sim = np.bincount(i[sim], minlength=n)
    keep = sim & (n_sim <= hi[at])[i]
    season = np.flatnonzero(sim & (d_p <= big[e]))
    season = season[np.lexsort((curve[j[season]], d_h[season], i[season]))]
    keep[season[_within(i[season], n) < hi[e[season]]]] = True
    order = np.lexsort((-w, i))
    rank, last = _within(i[order], n), np.bincount(i, minlength=n) - 1
    bound = np.zeros(n)
    at_bound = rank == np.minimum(lo[e[order]], last[i[order]])
    bound[i[order][at_bound]] = w[order][at_bound]
    keep |= w >= bound[i]
    k = np.flatnonzero(keep)
    k = k[np.argsort(i[k], kind="stable")]
    i, e, j = i[k], e[k], j[k]
    here = np.where(_within(i, n) == 0, n_sim[i], 0)
    event = ev.iloc[e]
    return pd.DataFrame({"event_id": event["event_id"].to_numpy(), "param_id": event["param_id"].to_numpy(), "curve_id": curve[j], "d_f": d_f[k], "d_e": d_e[k], "d_h": d_h[k], "d_p": d_p[k], "big_gamma": big[e], "xi": xi[e], "kappa_min": lo[e], "kappa_max": hi[e], "w_f": w_f[k], "w_e": w_e[k], "w": w[k], "sim_here": here.astype(np.int64)})


def _in_blocks(weighted: DataFrame, history: DataFrame, whole: bool, product: bool, event_rows: int, curves: int, many: bool = False) -> DataFrame:
    n_events, n_curves = -(-weighted.count() // event_rows) or 1, -(-history.count() // curves) or 1
    block = lambda keys, n: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fold = lambda df, none: (F.coalesce(F.col("fold").cast("long"), F.lit(none)) if "fold" in df.columns else F.lit(none)).alias("fold")
    ev = weighted.select(*KEYS, "f", "e", "phi", "psi", "lon", "lat", "yday", "gamma", "length_scale_f", "length_scale_e", "xi", "kappa_min", "kappa_max", fold(weighted, -1))
    ev = ev.withColumn("_v", block(KEYS, n_events)).withColumn("_h", every(n_curves))
    # Names of their own: both sides may come of one table.
    past = history.select(*[F.col(c).alias(f"h_{c}") for c in _CURVE], fold(history, -2).alias("h_fold")).withColumn("h_h", block(["h_curve_id"], n_curves)).withColumn("h_v", every(n_events))
    score = _needed_block if many else lambda a, b: _score_block(a, b, whole, product)
    run = lambda a, b: score(a, b.rename(columns=lambda c: c[2:]))
    return ev.groupBy("_v", "_h").cogroup(past.groupBy("h_v", "h_h")).applyInPandas(run, _SCORED)


def distances(weighted: DataFrame, history: DataFrame, product: bool = False, event_rows: int = EVENT_ROWS, curves: int = CURVES) -> DataFrame:
    """event_id, param_id, curve_id with d_f, d_e, d_h, d_p, w_f, w_e, w for each event and curve.

    Events and curves meet block by block, so that neither side is ever whole in a task or on the
    driver. product: by matrix products instead of differences. Inputs are read twice (counted
    first), so settle what is dear to compute. Where both have a column `fold` (a number), no event
    meets curves of its own: leave-one-out needs no join a fold.
    """
    return _in_blocks(weighted, history, True, product, event_rows, curves)


def near(weighted: DataFrame, history: DataFrame, event_rows: int = EVENT_ROWS, curves: int = CURVES) -> DataFrame:
    """The rows of distances() that select() can need, at most 2 kappa_max + kappa_min + 1 (and ties)
    of each block of curves; sim_here adds up to the number of similar curves."""
    return _in_blocks(weighted, history, False, False, event_rows, curves)


#: The same for near_all, whose blocks are products.
MANY_EVENT_ROWS, MANY_CURVES = 16_000, 80_000


def near_all(weighted: DataFrame, history: DataFrame, event_rows: int = MANY_EVENT_ROWS, curves: int = MANY_CURVES) -> DataFrame:
    """near() for many events of which few curves are similar: large blocks, told by matrix products, so that
    rows are copied less often and a pair costs some nanoseconds; figures and ties are exact."""
    return _in_blocks(weighted, history, False, False, event_rows, curves, True)


def select(scored: DataFrame) -> DataFrame:
    """Flags in_sim, in_temporal, in_spatial and in_final of each row, and sigma. The rows are those of
    distances(), or of near(), whose sim_here count similar rows that were left out as well.

    Ties on the site distance go by curve_id; the fallback keeps all ties of the last weight.
    """
    whole = Window.partitionBy(*KEYS)
    sim = F.col("w") >= F.col("xi")
    n_sim = F.sum("sim_here") if "sim_here" in scored.columns else F.count_if(sim)
    x = scored.withColumns({"in_sim": sim, "n_sim": n_sim.over(whole)})
    many, few = F.col("n_sim") > F.col("kappa_max"), F.col("n_sim") < F.col("kappa_min")
    x = x.withColumn("in_temporal", F.col("in_sim") & (~many | (F.col("d_p") <= F.col("big_gamma"))))
    near = Window.partitionBy(*KEYS, "in_temporal").orderBy("d_h", "curve_id")
    x = x.withColumn("in_spatial", F.col("in_temporal") & (~many | (F.row_number().over(near) <= F.col("kappa_max"))))
    x = x.withColumn("n_spatial", F.count_if("in_spatial").over(whole))
    x = x.withColumn("_wr", F.rank().over(whole.orderBy(F.col("w").desc())))
    final = F.when(many & (F.col("n_spatial") >= F.col("kappa_min")), F.col("in_spatial")).when(many, F.col("in_temporal")).when(few, F.col("_wr") <= F.col("kappa_min")).otherwise(F.col("in_sim"))
    sigma = F.when(many & (F.col("n_spatial") >= F.col("kappa_min")), F.max(F.when(F.col("in_spatial"), F.col("d_h"))).over(whole))
    return x.withColumns({"in_final": final, "sigma": sigma}).drop("_wr", "n_sim", "n_spatial")


def select_by_order(scored: DataFrame, grow: bool) -> DataFrame:
    """The two older rules: in_final and status. sigma is the site distance at index kappa_max (from
    0) of the remaining rows, ties kept; the fallback threshold is the weight at index kappa_min.

    grow=False: status 1 if only days cut, 2 if distance cut or the fallback applied. grow=True: 2
    if days cut, 1 more if distance cut, 4 for the fallback.
    """
    whole = Window.partitionBy(*KEYS)
    sim = F.col("w") >= F.col("xi")
    x = scored.withColumns({"_s": sim, "_n": F.count_if(sim).over(whole)})
    days = x["_s"] & (F.col("d_p") <= F.col("big_gamma"))
    x = x.withColumn("_d", F.count_if(days).over(whole))
    by_day = (F.col("_n") > F.col("kappa_max")) & (F.col("_d") > F.col("kappa_min"))
    x = x.withColumns({"_k": F.when(by_day, F.col("_s") & (F.col("d_p") <= F.col("big_gamma"))).otherwise(F.col("_s")), "_by": by_day})
    x = x.withColumn("_m", F.count_if("_k").over(whole))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "_k").orderBy("d_h", "curve_id"))
    x = x.withColumn("_i", F.when(F.col("_k"), rank - 1))
    far = F.col("_m") > F.col("kappa_max")
    x = x.withColumn("sigma", F.when(far, F.max(F.when(F.col("_i") == F.col("kappa_max"), F.col("d_h"))).over(whole)))
    x = x.withColumn("_k", F.col("_k") & (~far | (F.col("d_h") <= F.col("sigma"))))
    x = x.withColumns({"_c": F.count_if("_k").over(whole), "_wi": F.row_number().over(whole.orderBy(F.col("w").desc(), "curve_id")) - 1})
    x = x.withColumn("_wt", F.max(F.when(F.col("_wi") == F.col("kappa_min"), F.col("w"))).over(whole))
    few = F.col("_c") < F.col("kappa_min")
    by = F.col("_by").cast("int")
    status = F.when(few, 4).otherwise(2 * by + far.cast("int")) if grow else F.when(few | far, 2).otherwise(by)
    return x.withColumns({"in_final": F.when(few, F.col("w") >= F.col("_wt")).otherwise(F.col("_k")), "status": status}).drop("_s", "_n", "_d", "_k", "_by", "_m", "_i", "_c", "_wi", "_wt")


def stage_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy(*KEYS).agg(*[F.count_if(c).alias(n) for c, n in (("in_sim", "n_sim"), ("in_temporal", "n_temporal"), ("in_spatial", "n_spatial"), ("in_final", "n_scenarios"))])


def display_rank(selected: DataFrame) -> DataFrame:
    """Min-max scaled weight and order of the selected rows."""
    whole = Window.partitionBy(*KEYS)
    lo, hi = F.min("w").over(whole), F.max("w").over(whole)
    return selected.where("in_final").select(*KEYS, "curve_id", F.when(hi > lo, (F.col("w") - lo) / (hi - lo)).otherwise(F.lit(0.0)).alias("scaled"), F.row_number().over(whole.orderBy(F.col("w").desc(), "curve_id")).alias("place"))
