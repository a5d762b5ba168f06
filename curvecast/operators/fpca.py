"""Functional principal components of curve sets (set_id, curve_id, tau, v).

Means and the slot-by-slot covariance are distributed sums; only the T x T matrix (a few hundred
slots square, whatever the number of curves) is decomposed, in one task per set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean(x: DataFrame) -> DataFrame:
    return x.groupBy("set_id", "tau").agg(F.avg("v").alias("mu"))


#: Curves that a task lays out as one matrix, and the sums that it holds before it passes them on.
_ROWS, _SUMS = 1000, 2**20


def _packed(x: DataFrame, value: str) -> DataFrame:
    """set_id, curve_id and the arrays taus and vs of a curve's slots that have a value, in order."""
    rows = F.sort_array(F.collect_list(F.struct("tau", F.col(value).alias("v"))))
    packed = x.where(F.col(value).isNotNull()).groupBy("set_id", "curve_id").agg(rows.alias("_c"))
    return packed.select("set_id", "curve_id", F.col("_c.tau").cast("array<int>").alias("taus"), F.col("_c.v").cast("array<double>").alias("vs"))


def covariance(x: DataFrame) -> DataFrame:
    """Sample covariance by pair of slots, tau1 <= tau2, over the curves that have both.

    Curves go as arrays, read as Arrow buffers with no Python object a slot; each task adds up T x T
    products of its own and sends them by pair of slots, so that no task holds what all others sent.
    """
    centred = _packed(x.join(mean(x), ["set_id", "tau"]).withColumn("d", F.col("v") - F.col("mu")), "d")

    def sent(sums: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for key, (s, a, n) in sums.items():
            i, j = np.nonzero(np.triu(n))
            cols = {"set_id": np.full(len(i), key, dtype=np.int64), "tau1": i.astype(np.int32), "tau2": j.astype(np.int32), "s": s[i, j], "a1": a[i, j], "a2": a[j, i], "n": n[i, j]}
            yield pa.RecordBatch.from_pydict(cols)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for own in (b.slice(start, _ROWS) for start in range(0, b.num_rows, _ROWS)):
                keys, taus = own["set_id"].to_numpy(zero_copy_only=False), own["taus"].flatten().to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(len(keys)), pc.list_value_length(own["taus"]).to_numpy(zero_copy_only=False)), taus
                top = int(taus.max(initial=-1)) + 1
                rows, has = np.zeros((len(keys), top)), np.zeros((len(keys), top))
                rows[at], has[at] = own["vs"].flatten().to_numpy(zero_copy_only=False), 1
                for key in np.unique(keys):
                    r, h = rows[keys == key], has[keys == key]
                    new = [r.T @ r, r.T @ h, h.T @ h]
                    old = sums.get(key, new)
                    size = max(len(old[0]), top)
                    grown = lambda m, size=size: np.pad(m, (0, size - len(m)))
                    sums[key] = new if key not in sums else [grown(p) + grown(q) for p, q in zip(old, new, strict=True)]
                if sum(m[0].size for m in sums.values()) > _SUMS:
                    yield from sent(sums)
                    sums = {}
        yield from sent(sums)

    parts = centred.select("set_id", "taus", "vs").mapInArrow(partial, "set_id long, tau1 int, tau2 int, s double, a1 double, a2 double, n double")
    total = parts.groupBy("set_id", "tau1", "tau2").agg(*[F.sum(c).alias(c) for c in ("s", "a1", "a2", "n")])
    cov = F.when(F.col("n") > 1, (F.col("s") - F.col("a1") * F.col("a2") / F.col("n")) / (F.col("n") - 1))
    return total.select("set_id", "tau1", "tau2", cov.alias("cov"))


def noise(x: DataFrame) -> DataFrame:
    """set_id, sigma2: the measurement error's variance, a sixth of the mean square of second
    differences (over three slots in a row that a curve has)."""
    at = Window.partitionBy("set_id", "curve_id").orderBy("tau")
    near = x.where(F.col("v").isNotNull()).withColumns({f"_{n}{c}": f(c).over(at) for n, f in (("p", F.lag), ("n", F.lead)) for c in ("tau", "v")})
    row = (F.col("_ptau") == F.col("tau") - 1) & (F.col("_ntau") == F.col("tau") + 1)
    second = F.when(row, F.col("_nv") - 2 * F.col("v") + F.col("_pv"))
    return near.groupBy("set_id").agg(F.coalesce(F.avg(second * second) / 6, F.lit(0.0)).alias("sigma2"))


def fit(x: DataFrame, k: int | None = None, share: float | None = None, error: DataFrame | None = None) -> DataFrame:
    """set_id, k, eigenvalue, tau, phi: the leading eigenfunctions; the largest entry is positive.

    How many: k, or as many as explain `share` of the variance (of the positive eigenvalues), set by
    set. error (set_id, sigma2, of noise()): its variance is taken off the diagonal first.
    """

    def eigen(pdf: pd.DataFrame) -> pd.DataFrame:
        taus = np.unique(pdf["tau1"])
        c = np.zeros((len(taus), len(taus)))
        i, j = np.searchsorted(taus, pdf["tau1"]), np.searchsorted(taus, pdf["tau2"])
        c[i, j] = c[j, i] = pdf["cov"].fillna(0.0)
        value, vector = np.linalg.eigh(c - pdf["sigma2"].iloc[0] * np.eye(len(taus)))
        value, vector = value[::-1], vector[:, ::-1]
        positive = np.maximum(value, 0)
        some = int(np.searchsorted(np.cumsum(positive), share * positive.sum() * (1 - 1e-12)) + 1) if share is not None else len(taus)
        out = []
        for n in range(min(len(taus), some, k or len(taus))):
            v = vector[:, n] * np.sign(vector[np.argmax(np.abs(vector[:, n])), n])
            out.append(pd.DataFrame({"set_id": pdf["set_id"].iloc[0], "k": n + 1, "eigenvalue": value[n], "tau": taus, "phi": v}))
        return pd.concat(out)

    cov = covariance(x)
    cov = cov.withColumn("sigma2", F.lit(0.0)) if error is None else cov.join(error, "set_id")
    return cov.groupBy("set_id").applyInPandas(eigen, "set_id long, k int, eigenvalue double, tau int, phi double")


#: Curves of one set that are scored in a task.
CURVES = 2000


def expected_scores(x: DataFrame, mu: DataFrame, phi: DataFrame, error: DataFrame, curves: int = CURVES) -> DataFrame:
    """set_id, curve_id, k, score: the scores' expectation given the slots that a curve has.

    With eigenvalues L, eigenfunctions P at those slots and error variance s that is
    (P'P + s / L)^-1 P'(v - mu), which is the same as L P' (P L P' + s I)^-1 (v - mu): a missing slot
    adds no evidence, where a plain product takes it for the mean. Components without variance score
    nought. Curves without any value (of a slot that the model has) have no row. A set's curves are
    dealt out `curves` at a time, each part with a copy of the set's model (slots x components).
    """
    packed = _packed(x, "v")
    parts = x.where(F.col("v").isNotNull()).select("set_id", "curve_id").distinct().groupBy("set_id").agg(F.ceil(F.count(F.lit(1)) / curves).cast("int").alias("_n"))
    dealt = packed.join(parts, "set_id").withColumn("_b", F.pmod(F.xxhash64("curve_id"), F.col("_n")).cast("int")).drop("_n")
    rows = F.sort_array(F.collect_list(F.struct("tau", "mu", "phi")))
    model = phi.join(mu, ["set_id", "tau"]).groupBy("set_id", "k", "eigenvalue").agg(rows.alias("m"))
    model = model.select("set_id", "k", "eigenvalue", F.col("m.tau").alias("taus"), F.col("m.mu").alias("mu"), F.col("m.phi").alias("phi")).join(error, "set_id")
    model = model.join(parts, "set_id").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")

    def score(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(model):
            return pd.DataFrame({"set_id": [], "curve_id": [], "k": [], "score": []})
        model = model.sort_values("k")
        slots, centre, p = np.asarray(model["taus"].iloc[0]), np.asarray(model["mu"].iloc[0]), np.column_stack(model["phi"])
        value, s = model["eigenvalue"].to_numpy(), float(model["sigma2"].iloc[0])
        some = value > 0
        row, taus, vs = np.repeat(np.arange(len(own)), own["taus"].map(len)), np.concatenate(own["taus"].to_numpy()), np.concatenate(own["vs"].to_numpy())
        at = np.minimum(np.searchsorted(slots, taus), len(slots) - 1)
        known = slots[at] == taus
        d, has = np.zeros((len(own), len(slots))), np.zeros((len(own), len(slots)), dtype=bool)
        d[row[known], at[known]], has[row[known], at[known]] = vs[known] - centre[at[known]], True
        alike: dict[bytes, list[int]] = {}  # curves with the same slots share one matrix
        for i in np.flatnonzero(has.any(axis=1)):
            alike.setdefault(has[i].tobytes(), []).append(i)
        scores = np.zeros((len(own), len(value)))
        for which in alike.values():
            seen = has[which[0]]
            q = p[seen][:, some]
            scores[np.ix_(which, some)] = np.linalg.lstsq(q.T @ q + np.diag(s / value[some]), q.T @ d[which][:, seen].T, rcond=None)[0].T
        scored = np.flatnonzero(has.any(axis=1))
        ids = own["curve_id"].to_numpy()[scored]
        return pd.DataFrame({"set_id": own["set_id"].iloc[0], "curve_id": np.repeat(ids, len(value)), "k": np.tile(model["k"].to_numpy(), len(ids)), "score": scores[scored].ravel()})

    return dealt.groupBy("set_id", "_b").cogroup(model.groupBy("set_id", "_b")).applyInPandas(score, "set_id long, curve_id long, k int, score double")


def project(x: DataFrame, mu: DataFrame, phi: DataFrame) -> DataFrame:
    """set_id, curve_id, k, score of whole curves by plain products (expected_scores takes gaps into account)."""
    centred = x.join(mu, ["set_id", "tau"]).withColumn("d", F.col("v") - F.col("mu"))
    return centred.join(phi, ["set_id", "tau"]).groupBy("set_id", "curve_id", "k").agg(F.sum(F.col("d") * F.col("phi")).alias("score"))


def reconstruct(scores: DataFrame, mu: DataFrame, phi: DataFrame) -> DataFrame:
    part = scores.join(phi, ["set_id", "k"]).groupBy("set_id", "curve_id", "tau").agg(F.sum(F.col("score") * F.col("phi")).alias("p"))
    return part.join(mu, ["set_id", "tau"]).select("set_id", "curve_id", "tau", (F.col("mu") + F.col("p")).alias("v"))
