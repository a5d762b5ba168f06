"""Forecast updates with keyed state: each block of history carries the running distances of the open days.

The key is a block of curves. Its curves are put into the state once, when the stream first starts,
so that afterwards only finished hours move; a day's hours go to all blocks. Of each open day a block
keeps the decayed sum of squares so far to each of its curves: the distance at t + 1 follows from the
one at t by one multiplication and one slot, not from the whole prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from curvecast.operators import neighbors as N
from curvecast.streaming.updates import hourly, summaries

_PARTS = ("curve_id", "lon", "lat", "yday", "f", "e")
_BLOCK = ", ".join(f"{c} binary" for c in _PARTS)
_CANDIDATE = "event_id long, t int, param_id int, curve_id long, d_h double, d_p double, big_gamma double, xi double, kappa_min int, kappa_max int, w double, sim_here long"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Weights are compared to this many decimals: a running sum and a fresh one differ in the last bits.
PLACES = 12


def blocks(history: DataFrame, n: int) -> DataFrame:
    """History (curve_id, f, e, lon, lat, yday) as one row a block: its columns as the bytes of float64 (ids int64)."""

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("curve_id")
        flat = {c: pdf[c].to_numpy(dtype="int64" if c == "curve_id" else "float64").tobytes() for c in _PARTS[:4]}
        flat |= {c: np.stack(pdf[c].to_list()).astype("float64").tobytes() for c in _PARTS[4:]}
        return pd.DataFrame([{"block": key[0], **flat}])

    keyed = history.select(*_PARTS, _block_of("curve_id", n).alias("block"))
    return keyed.groupBy("block").applyInPandas(packed, f"block int, {_BLOCK}")


def _block_of(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


class PrefixDistances(StatefulProcessor):
    """Takes finished hours (event_id, tau, f, e, lon, lat, yday, ends) of a block's key; returns for each,
    as of t = tau + 1 observed slots, the rows that selection can need (neighbors.near).

    An hour without rows counts as nought once a later one of its day is there; so does a null. A day
    leaves the state with its last slot, or when an hour at or after its end (`ends`) has been finished:
    the watermark finishes hours in order of time, so none of its own can follow.
    """

    def __init__(self, params: list[dict], slots: int, per_hour: float):
        self.params, self.slots, self.per_hour = params, slots, per_hour

    def init(self, handle) -> None:
        self.block = handle.getValueState("block", _BLOCK)
        self.open = handle.getMapState("open", "event_id long", "t int, ends long, sums binary, totals binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.block.update(tuple(bytes(getattr(r, c)) for c in _PARTS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hours = pd.concat(list(rows))
        if not self.block.exists():  # a block without curves
            return
        raw = dict(zip(_PARTS, self.block.get()))
        past = {c: np.frombuffer(raw[c], dtype="int64" if c == "curve_id" else "float64") for c in _PARTS}
        n = len(past["curve_id"])
        past["f"], past["e"] = past["f"].reshape(n, self.slots), past["e"].reshape(n, self.slots)
        for event, day in hours.sort_values(["event_id", "tau"]).groupby("event_id"):
            found = self._advance(int(event), day, past)
            if found:
                yield pd.concat(found)
        latest = hours["start"].max()
        over = [k for k, v in self.open.iterator() if v[1] <= latest]
        for k in over:
            self.open.removeKey(k)

    def _advance(self, event: int, day: pd.DataFrame, past: dict) -> list[pd.DataFrame]:
        """One day's new hours: the sums brought forward slot by slot, and the candidates at each hour."""
        first, n = day.iloc[0], len(past["curve_id"])
        halving = np.array([0.5 ** (1 / (self.per_hour * p["forget_rate_f"])) for p in self.params])
        t, sums, totals = 0, np.zeros((len(self.params), n)), np.zeros(len(self.params))
        if self.open.containsKey((event,)):
            t, _, kept, weight = self.open.getValue((event,))
            sums, totals = np.frombuffer(kept).reshape(len(self.params), n), np.frombuffer(weight)
        gap_e = (past["e"] - np.asarray(first["e"], dtype=float)) ** 2
        d_h, d_p = N._haversine(past["lon"], past["lat"], first["lon"], first["lat"]), N._periodic(past["yday"], first["yday"])
        out = []
        for tau, f in zip(day["tau"], np.nan_to_num(day["f"].to_numpy(dtype=float))):
            for slot in range(t, tau + 1):
                sums = sums * halving[:, None] + (past["f"][:, slot] - (f if slot == tau else 0.0)) ** 2
                totals = totals * halving + 1
            t = int(tau) + 1
            if t < self.slots:
                out += [self._candidates(event, t, first["yday"], p, sums[i] / totals[i], gap_e, d_h, d_p, past["curve_id"]) for i, p in enumerate(self.params)]
        if t >= self.slots:
            if self.open.containsKey((event,)):
                self.open.removeKey((event,))
        else:
            self.open.updateValue((event,), (t, int(first["ends"]), sums.tobytes(), totals.tobytes()))
        return out

    def _candidates(self, event, t, yday, p, d_f, gap_e, d_h, d_p, curve) -> pd.DataFrame:
        lead = np.arange(self.slots) - t
        psi = 0.5 ** (np.where(lead < 0, -1 - lead, lead) / (self.per_hour * np.where(lead < 0, p["forget_rate_e"], p["lookup_rate"])))
        d_e = np.einsum("ij,j->i", gap_e, psi) / psi.sum()
        w = np.round(np.fmin(np.exp(-d_f / p["length_scale_f"]), np.exp(-d_e / p["length_scale_e"])), PLACES)
        big = N._periodic(yday, yday + p["gamma"])
        keep = N._needed(w, d_h, d_p, curve, big, p["xi"], p["kappa_min"], p["kappa_max"])
        here = np.zeros(int(keep.sum()), dtype=np.int64)
        here[:1] = (w >= p["xi"]).sum()
        return pd.DataFrame({
            "event_id": event, "t": t, "param_id": p["param_id"], "curve_id": curve[keep], "d_h": d_h[keep], "d_p": d_p[keep], "big_gamma": big,
            "xi": p["xi"], "kappa_min": p["kappa_min"], "kappa_max": p["kappa_max"], "w": w[keep], "sim_here": here,
        })


def run_stateful(
    stream: DataFrame, path: str, checkpoint: str, as_events: Callable[[DataFrame], DataFrame], history: DataFrame, history_long: DataFrame, params: DataFrame,
    slots: int, per_hour: float, minutes: float, late: str = "2 hours", curves: int = N.CURVES,
) -> None:
    """Append, for each finished hour of the stream (asset, ts, value), the forecast as of that hour
    (event_id, param_id, t, s, focal, lower, upper) to `path`, in a folder a micro-batch.

    as_events turns hours (asset, start, f) into event_id, start, tau, f, e, lon, lat, yday and ends (the
    day's end), by joins with tables at rest. history is counted once, for blocks of about `curves`
    curves; the state lies in as many partitions as shuffles have at the first start. params: a few rows.
    A batch run again after a failure starts from the state before it and replaces its own folder.
    """
    spark = stream.sparkSession
    n = -(-history.count() // curves) or 1
    rows = as_events(hourly(stream, late)).select("event_id", "start", "tau", "f", "e", "lon", "lat", "yday", "ends").withColumns({c: F.unix_timestamp(c) for c in ("start", "ends")})
    keyed = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    processor = PrefixDistances([r.asDict() for r in params.collect()], slots, per_hour)
    near = keyed.groupBy("block").transformWithStateInPandas(processor, _CANDIDATE, "append", "none", blocks(history, n).groupBy("block"))

    def write(batch: DataFrame, number: int) -> None:
        # An hour of a day is an event of its own here: selection goes by (event, t, parameter set).
        chosen = N.select(batch.withColumn("event_id", F.col("event_id") * slots + F.col("t"))).where("in_final")
        found = summaries(chosen.select(*N.KEYS, "t", "curve_id", "w"), history_long, params, minutes)
        found.withColumn("event_id", F.floor(F.col("event_id") / slots)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = spark.conf.get(_ROCKS[0])
    spark.conf.set(*_ROCKS)
    try:
        query = near.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    finally:
        spark.conf.set(_ROCKS[0], before)
    query.awaitTermination()
