"""The stateful stream against its unstreamed form: blocks, gaps, late rows, nulls, restarts."""

import datetime as dt
import os
import random

import numpy as np
from pyspark.sql import functions as F

from curvecast.operators import prep
from curvecast.operators.tuning import PARAMS
from curvecast.plans import q_eval
from curvecast.plans import fixtures as X
from curvecast.streaming import state, updates

SLOTS = 4
ROWS = [  # one list a file, so a micro-batch each: asset, hour since the first midnight, value
    [(1, 0.2, 0.3), (1, 0.9, 0.1), (2, 0.5, 0.7), (None, 0.5, 1.0), (9, 0.6, 1.0)],
    [(1, 1.5, 0.2), (2, 1.1, 0.4), (1, 0.4, 0.2)],  # the last is late, but not too late
    [(1, 3.1, 0.9), (2, 3.5, None), (2, 2.5, 0.3)],  # asset 1 has no hour 2
    [(1, 25.0, 0.5), (1, 26.0, 0.1), (2, 24.5, 0.2)],
    [(1, 0.1, 50.0), (1, 30.0, 0.0), (2, 33.0, 0.0)],  # the first is too late
]


def _key(r):
    return r["event_id"], r["param_id"], r["t"], r["s"]


def test_state_equals_the_unstreamed_flow_over_restarts_gaps_and_late_rows(spark, tmp_path):
    rng = random.Random(4)
    long = spark.createDataFrame([(c, k, rng.random(), rng.random(), -100.0 + c, 30.0 + c % 3, 1 + 40 * c) for c in range(9) for k in range(SLOTS)], "curve_id long, tau int, f double, e double, lon double, lat double, yday int")
    packed = prep.pack(long, ["curve_id", "lon", "lat", "yday"], f="f", e="e")
    means = spark.createDataFrame([(1, [0.1, 0.5, 0.4, 0.2], -99.0, 31.0), (2, [0.9, 0.1, 0.2, 0.6], -95.0, 30.5)], "asset int, e array<double>, lon double, lat double")
    params = spark.createDataFrame([(0, 2.0, 2.0, 0.05, 0.05, 3.0, 0.8, 2.5, 40.0, 0.05, 2, 4), (1, 1.0, 3.0, 0.2, 0.1, 1.0, 1.0, 2.5, 90.0, 0.6, 3, 3)], PARAMS)
    day, source = F.dayofyear("start"), tmp_path / "in"

    def as_events(hours):
        at = hours.select(F.col("asset").cast("int").alias("asset"), "start", "f").join(means, "asset").where(F.hour("start") < SLOTS)
        return at.select((F.col("asset") * 10 + day).cast("long").alias("event_id"), "start", F.hour("start").alias("tau"), "f", "e", "lon", "lat", day.alias("yday"), (F.to_date("start") + F.expr("INTERVAL 1 DAY")).cast("timestamp").alias("ends"))

    def stream():
        return spark.readStream.schema("asset long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(source))

    for part in ([0, 1, 2], [3, 4]):  # the second run goes on from the first one's checkpoint
        for i in part:
            rows = [(a, dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h), v) for a, h, v in ROWS[i]]
            spark.createDataFrame(rows, "asset long, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
            os.makedirs(source, exist_ok=True)
            (file,) = (tmp_path / f"w{i}").glob("*.parquet")
            os.utime(file, (1e9 + i, 1e9 + i))
            os.rename(file, source / f"{i}.parquet")
        state.run_stateful(stream(), str(tmp_path / "out"), str(tmp_path / "c1"), as_events, packed, long, params, SLOTS, 1.0, 60.0, curves=4)
        updates.run_updates(stream(), str(tmp_path / "hours"), str(tmp_path / "c2"))

    hours = spark.read.schema(updates.HOURS).parquet(str(tmp_path / "hours/hours"))
    closed = {(r["event_id"], r["tau"]): r for r in as_events(hours).collect()}
    assert {k for k in closed if k[0] == 11} == {(11, 0), (11, 1), (11, 3)} and abs(closed[11, 0]["f"] - 0.6) < 1e-9  # 50.0 came too late
    events = []
    for (event, tau), r in closed.items():
        if tau + 1 < SLOTS:
            f = [closed[event, k]["f"] or 0.0 if (event, k) in closed else 0.0 for k in range(tau + 1)]
            events.append((event * SLOTS + tau + 1, tau + 1, f, r["e"], r["lon"], r["lat"], r["yday"]))
    events = spark.createDataFrame(events, "event_id long, t int, f array<double>, e array<double>, lon double, lat double, yday int")
    want = updates.forecast(events, packed, long, params, SLOTS, 1.0, 60.0).withColumn("event_id", F.floor(F.col("event_id") / SLOTS)).collect()
    rows = spark.read.schema("event_id long, param_id int, t int, s int, focal double, lower double, upper double").parquet(str(tmp_path / "out")).collect()
    got = {_key(r): (r["focal"], r["lower"], r["upper"]) for r in rows}
    assert len(got) == len(rows) == len(want) and {k[0] for k in got} >= {11, 12, 21}
    for r in want:
        assert np.allclose(got[_key(r)], (r["focal"], r["lower"], r["upper"]), atol=1e-9)


def test_blocks_do_not_change_the_forecasts(spark):
    sf = "/root/testdata/sf0.001"
    one, many = (sorted(map(tuple, q_eval._stateful(spark, sf, curves=c).collect())) for c in (X.SLOTS * 1000, 29))
    assert one and one == many


def test_a_stream_without_rows_or_history(spark, tmp_path):
    (tmp_path / "in").mkdir()
    empty = spark.readStream.schema("asset long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    past = spark.createDataFrame([], "curve_id long, f array<double>, e array<double>, lon double, lat double, yday int")
    long = spark.createDataFrame([], "curve_id long, tau int, f double, e double")
    as_events = lambda h: h.select(F.col("asset").alias("event_id"), "start", F.hour("start").alias("tau"), "f", F.array(F.lit(0.0)).alias("e"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), F.lit(1).alias("yday"), F.col("start").alias("ends"))
    params = spark.createDataFrame(X.PARAM_ROWS, PARAMS)
    state.run_stateful(empty, str(tmp_path / "out"), str(tmp_path / "c"), as_events, past, long, params, 1, 1.0, 60.0)
    assert not list((tmp_path / "out").glob("*/*.parquet")) or spark.read.parquet(str(tmp_path / "out")).count() == 0
