"""Places and days near one another against all pairs; tables that go with their scope."""

import math
import random

import pytest
from pyspark.sql import functions as F

from curvecast.operators import depth, envelope, site_pairs
from curvecast.plans import workdir


def haversine(a, b):
    (x1, y1), (x2, y2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((y1 - y2) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x1 - x2) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def places(seed, n=60):
    rng = random.Random(seed)
    around = [(179.9, 10.0), (-179.9, 10.2), (0.0, 89.5), (120.0, 89.9), (30.0, -90.0), (-100.0, 35.0)]
    return [(x + rng.uniform(-1, 1), max(-90.0, min(90.0, y + rng.uniform(-1, 1)))) for x, y in (rng.choice(around) for _ in range(n))]


def rows(spark, name, at):
    return spark.createDataFrame([(i, *p, d) for i, (p, d) in enumerate(at)], f"{name} long, lon double, lat double, yday int")


@pytest.mark.parametrize("km", [0.0, 40.0, 300.0, 21_000.0])
def test_places_within_equal_all_pairs(spark, km):
    """Over the date line and at the poles; equal places are one, those without a place none."""
    a, b = places(1), places(2)
    b += a[:3]
    left = rows(spark, "k", [(p, 1) for p in [*a, *a[:9], (None, 1.0), (1.0, None)]])
    right = rows(spark, "k", [(p, 1) for p in [*b, (None, None)]])
    got = {(r["lon"], r["lat"], r["lon_2"], r["lat_2"]): r["d_h"] for r in site_pairs.within(left, right, km).collect()}
    want = {(*p, *q): haversine(p, q) for p in a for q in b if haversine(p, q) <= km}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)
    assert site_pairs.within(left, right, km).count() == len(want)


@pytest.mark.parametrize("days", [0, 10, 182])
def test_days_within_equal_all_pairs(spark, days):
    a, b = [1, 2, 5, 180, 364, 365, 366, None, 1], [3, 190, 360, 366, None]
    left, right = (rows(spark, "k", [((0.0, 0.0), d) for d in x]) for x in (a, b))
    got = sorted((r["yday"], r["yday_2"]) for r in site_pairs.days_within(left, right, days).collect())
    apart = lambda x, y: min((x - y) % 365, (y - x) % 365)
    assert got == sorted({(x, y) for x in a for y in b if x and y and apart(x, y) <= days})


def test_candidates_equal_all_pairs(spark):
    rng = random.Random(3)
    ev, past = ([(p, rng.choice([1, 20, 200, 364, None])) for p in places(s, 40) * 2] for s in (4, 5))
    got = sorted((r["event_id"], r["curve_id"]) for r in site_pairs.candidates(rows(spark, "event_id", ev), rows(spark, "curve_id", past), 90.0, 25).collect())
    near = lambda x, y: x[1] and y[1] and haversine(x[0], y[0]) <= 90 and min((x[1] - y[1]) % 365, (y[1] - x[1]) % 365) <= 25
    assert got == [(i, j) for i, x in enumerate(ev) for j, y in enumerate(past) if near(x, y)] and len(got) > 50
    assert site_pairs.candidates(rows(spark, "event_id", ev).where("false"), rows(spark, "curve_id", past), 90.0, 25).count() == 0


def test_candidates_do_not_meet_all_pairs(spark):
    """The plan joins by equal keys alone."""
    ev, past = (rows(spark, k, [(p, 5) for p in places(6, 5)]) for k in ("event_id", "curve_id"))
    plan = site_pairs.candidates(ev, past, 50.0, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("Join Inner") >= 5


@pytest.mark.parametrize("name", sorted(envelope.DEPTHS))
def test_depths_of_envelopes_equal_those_of_tables(spark, name):
    rng = random.Random(7)
    y = [[float(rng.randrange(5)) for _ in range(6)] for _ in range(12)]
    long = spark.createDataFrame([(1, i, t, v) for i, row in enumerate(y) for t, v in enumerate(row)], "set_id long, curve_id long, tau int, v double")
    table = {r["curve_id"]: r["depth"] for r in depth.REGISTRY[name](long).collect()}
    own = envelope.DEPTHS[name](envelope.np.array(y))
    assert all(math.isclose(own[i], table[i], abs_tol=1e-9) for i in range(len(y)))


def test_envelope_takes_any_depth(spark):
    scen = spark.createDataFrame([(1, 0, c, s, float(c * (1 + s % 2))) for c in range(-5, 6) for s in range(4)], "event_id long, param_id int, curve_id long, s int, m double").withColumn("w", F.lit(1.0))
    first = lambda d: envelope.focal_envelope(scen, "l2", d).where("place = 0").first()["curve_id"]
    assert first("MBD") == first("LD") == 0
    assert first(lambda y: y.mean(axis=1)) == 5  # a depth of one's own: the highest curve is the deepest
    with pytest.raises(KeyError):
        envelope.focal_envelope(scen, "l2", "none such")


def test_settled_tables_go_with_their_scope(spark):
    seen = []
    path = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]
    there = lambda p: (lambda where, files: files.exists(where))(*workdir._place(spark, p))

    def make():
        seen.append(path(a := workdir.settle(spark.range(5))))
        seen.append(path(b := workdir.settle_last(lambda: workdir.settle(spark.range(3)).union(a))))
        return b.distinct()

    out = workdir.settle_last(make)
    assert out.count() == 5 and there(path(out)) and not any(map(there, seen))
    with pytest.raises(ZeroDivisionError):
        workdir.settle_last(lambda: 1 // 0)
    assert workdir._on_the_way.get() is None


def test_candidates_shuffle_no_row_a_day(spark):
    """Without broadcasts by size, events and curves are dealt out by place and stretch of days; only the days' own small tables by day."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ev, past = (rows(spark, k, [(p, d) for p in places(6, 5) for d in (1, 100, 364)]) for k in ("event_id", "curve_id"))
        found = site_pairs.candidates(ev, past, 50.0, 9)
        plan = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
        assert not any("lon_2" in line and "yday_2" in line for line in plan) and any("_stretch" in line for line in plan)
        apart = lambda x, y: min((x - y) % 365, (y - x) % 365)
        at = [(p, d) for p in places(6, 5) for d in (1, 100, 364)]
        assert found.count() == sum(haversine(p, q) <= 50 and apart(d, g) <= 9 for p, d in at for q, g in at)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
