"""The index of places and seasons: same selection as the search over all blocks, and few blocks touched."""

import random

from pyspark.sql import functions as F

from curvecast.operators import neighbors as N
from curvecast.operators import site_index
from curvecast.operators.tuning import PARAMS
from curvecast.plans.workdir import settle

CURVE = "curve_id long, f array<double>, e array<double>, lon double, lat double, yday int"


def _history(spark, n, wide, seed=3, noise=0.2, hot=0, odd=True):
    """n curves over `wide` degrees, `hot` more in one cell; some at one and the same place, some without a place or day."""
    rng = random.Random(seed)
    curve = lambda: [rng.random() * noise for _ in range(6)]
    rows = [(i, curve(), curve(), -120 + wide * rng.random(), 25 + 20 * rng.random(), rng.randrange(1, 366)) for i in range(n)]
    rows += [(10**6 + i, curve(), curve(), -100.5, 30.5, 100) for i in range(hot)]
    if odd:
        rows += [(2 * 10**6 + i, curve(), curve(), None if i % 2 else -110.0, 30.0, None if i % 3 == 0 else 20) for i in range(9)]
    return spark.createDataFrame(rows, CURVE)


def _events(spark, n, wide, seed=5, noise=0.2):
    rng = random.Random(seed)
    rows = [(i, 3, [rng.random() * noise for _ in range(3)], [rng.random() * noise for _ in range(6)], -120 + wide * rng.random(), 25 + 20 * rng.random(), (i * 37) % 366) for i in range(n)]
    params = spark.createDataFrame([(0, 2.0, 2.0, 0.5, 0.5, 3.0, 0.8, 2.5, 40.0, 0.2, 3, 10), (1, 3.0, 1.0, 0.005, 0.005, 2.0, 0.6, 3.5, 60.0, 0.5, 3, 10), (2, 1.0, 1.0, 0.002, 0.002, 2.0, 0.6, 3.5, 20.0, 0.9, 6, 8)], PARAMS)
    return N.with_weights(spark.createDataFrame(rows, "event_id long, t int, f array<double>, e array<double>, lon double, lat double, yday int"), params, 6, 1.0)


def _final(scored):
    return {(r["event_id"], r["param_id"], r["curve_id"], r["sigma"]) for r in N.select(scored).where("in_final").collect()}


class _Count:
    """settle, with the number of (event, parameter set, block, part) rows that pass through it."""

    pairs = 0

    def __call__(self, df):
        out = settle(df)
        if "block" in out.columns and "param_id" in out.columns:
            self.pairs += out.count()
        return out


def test_selection_is_that_of_all_blocks(spark):
    history, events = settle(_history(spark, 900, 30, hot=400)), settle(_events(spark, 25, 30))
    history = settle(history.where("lon is not null and yday is not null"))
    want = _final(N.near(events, history))
    assert {p for _, p, _, _ in want} == {0, 1, 2} and any(s is not None for *_, s in want) and any(s is None for *_, s in want)
    for degrees, days, curves in ((2.0, 30, 4000), (7.0, 400, 50)):  # with 50, the hot cell is scored in parts
        assert _final(site_index.near(events, history, settle, degrees, days, curves=curves, event_rows=10)) == want


def test_rows_without_place_or_day_are_searched_by_all(spark):
    history, events = settle(_history(spark, 60, 10)), settle(_events(spark, 8, 10).withColumn("lon", F.when(F.col("event_id") != 3, F.col("lon"))))
    # At full width: near cuts each block by itself, and only distances() keeps every row.
    want = _final(N.distances(events, history).withColumn("sim_here", (F.col("w") >= F.col("xi")).cast("long")))
    got = _final(site_index.near(events, history, settle, 2.0))
    assert {k for k in got if k[1] == 2} == {k for k in want if k[1] == 2}


def test_own_fold_is_left_out(spark):
    history, events = _history(spark, 200, 10, odd=False).withColumn("fold", F.col("curve_id") % 5), _events(spark, 10, 10).withColumn("fold", F.col("event_id") % 5)
    history, events = settle(history), settle(events)
    got = _final(site_index.near(events, history, settle, 2.0))
    assert got == _final(N.near(events, history)) and all(e % 5 != c % 5 for e, _, c, _ in got)


def test_blocks_touched_do_not_grow_with_the_area(spark):
    touched = []
    for n, wide in ((1000, 20), (3000, 60)):  # as dense, three times as wide
        history, count = settle(_history(spark, n, wide, odd=False)), _Count()
        events = settle(_events(spark, 20, wide).where("param_id = 0"))
        found = site_index.near(events, history, count, 2.0)
        assert _final(found) == _final(N.near(events, history))
        touched.append((count.pairs / 20, site_index.blocks(history).count()))
    assert touched[1][1] > 2.5 * touched[0][1]  # the blocks grow
    assert touched[1][0] < 1.6 * touched[0][0] and touched[1][0] < 0.1 * touched[1][1]  # those of an event hardly


def test_events_with_few_similar_curves_meet_all_by_products(spark):
    """They are listed for no block after the first ones, and products give the rows, counts and ties of the plain way."""
    one = _history(spark, 700, 30, odd=False)
    history = settle(one.unionByName(one.withColumn("curve_id", F.col("curve_id") + 10_000).withColumn("lon", F.col("lon") + 0.5)))  # each curve twice: ties
    events, count = settle(_events(spark, 30, 30).where("param_id = 2")), _Count()
    found = site_index.near(events, history, count, 2.0)
    assert _final(found) == _final(N.near(events, history)) and len(_final(found)) == 30 * 6
    assert count.pairs / 30 < 0.2 * site_index.blocks(history).count()  # before: all blocks, and so 1 a block and event


def test_products_keep_what_is_needed(spark, monkeypatch):
    monkeypatch.setattr(N, "_TILE_CURVES", 64)
    columns = [c.split()[0] for c in N._SCORED.split(", ")]
    ev = _events(spark, 20, 30).toPandas().assign(fold=lambda d: d["event_id"] % 4)
    past = _history(spark, 500, 30, odd=False).toPandas().assign(fold=lambda d: d["curve_id"] % 4)
    past = N.pd.concat([past, past.assign(curve_id=past["curve_id"] + 10_000)], ignore_index=True)
    want, got = (df.sort_values(columns[:3]).reset_index(drop=True) for df in (N._score_block(ev, past, False, False), N._needed_block(ev, past)))
    assert want[columns[:3]].values.tolist() == got[columns[:3]].values.tolist() and len(want) > 500
    assert all(N.np.allclose(want[c], got[c], rtol=1e-12, atol=1e-14) for c in columns[3:-1])
    sims = lambda df: df.groupby(N.KEYS)["sim_here"].sum().to_dict()
    assert sims(want) == sims(got)


def test_events_with_some_similar_curves_look_wider(spark, monkeypatch):
    """An event whose near blocks hold a few similar curves tries more of them before it meets all; the selection stays."""
    history, events = settle(_history(spark, 3000, 20, noise=0.5, odd=False)), settle(_events(spark, 40, 20, noise=0.5).where("param_id = 0").withColumn("xi", F.lit(0.95)))
    met, plain = [], N.near_all
    monkeypatch.setattr(N, "near_all", lambda left, placed: (met.append(left.count()), plain(left, placed))[1])
    want = _final(N.near(events, history))
    assert _final(site_index.near(events, history, settle, 2.0, probe=4)) == want
    monkeypatch.setattr(site_index, "_SOME", 10**6)  # as before: no second look
    assert _final(site_index.near(events, history, settle, 2.0, probe=4)) == want
    assert met[0] < 0.5 * met[1]


def test_products_by_kind_or_by_event_are_alike(spark, monkeypatch):
    ev, past = (df.toPandas().assign(fold=k) for df, k in ((_events(spark, 30, 30), -1), (_history(spark, 600, 30, hot=200, odd=False), -2)))
    by_kind = N._needed_block(ev, past)
    monkeypatch.setattr(N, "_KINDS", 0)
    want, by_event, plain = by_kind.sort_values(N.KEYS + ["curve_id"]), N._needed_block(ev, past).sort_values(N.KEYS + ["curve_id"]), N._score_block(ev, past, False, False).sort_values(N.KEYS + ["curve_id"])
    assert want.drop(columns="sim_here").to_numpy().tolist() == by_event.drop(columns="sim_here").to_numpy().tolist()
    assert want[["event_id", "param_id", "curve_id"]].to_numpy().tolist() == plain[["event_id", "param_id", "curve_id"]].to_numpy().tolist()


def test_empty_history(spark):
    history = spark.createDataFrame([], CURVE)
    assert site_index.near(_events(spark, 3, 5), history, settle).count() == 0
