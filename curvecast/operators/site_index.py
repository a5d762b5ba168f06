"""Neighbour search by an index of places and seasons: blocks that can't hold a selected curve are skipped.

Curves lie in blocks by a cell of longitude and latitude and a stretch of days of the year. Of an event
with more than kappa_max similar curves in its season, selection keeps the kappa_max nearest; so once a
few near blocks have given that many, only blocks nearer than the last of them can matter. All other
events (too few similar curves near them) meet all curves in large blocks by matrix products
(`neighbors.near_all`), and give what `neighbors.near` gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvecast.functions import curves as C
from curvecast.operators import neighbors as N

_BLOCK = ["cx", "cy", "season"]
#: Kilometres taken off a bound, for rounding.
_SLACK = 1e-6


def _placed(history: DataFrame, degrees: float, days: int) -> DataFrame:
    cell = lambda c: F.coalesce(F.floor(F.col(c) / degrees), F.lit(-(10**6))).cast("long")
    return history.withColumns({"cx": cell("lon"), "cy": cell("lat"), "season": F.coalesce(F.floor(F.col("yday") / days), F.lit(-(10**6))).cast("long")})


def blocks(history: DataFrame, degrees: float = 2.0, days: int = 30, curves: int = N.CURVES) -> DataFrame:
    """One row a block: its cell and season, n curves, the first and last day, the largest distance from the
    cell's middle (reach), and the parts of about `curves` curves that it is scored in.

    There are at most (360 / degrees) (180 / degrees) (366 / days + 1) rows, and those of null places
    or days, however many curves.
    """
    middle = lambda c: (F.col(c) + 0.5) * degrees
    reach = C.haversine(F.col("lon"), F.col("lat"), middle("cx"), middle("cy"))
    found = _placed(history, degrees, days).groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min("yday").cast("double").alias("d0"), F.max("yday").cast("double").alias("d1"), F.max(reach).alias("reach"))
    return found.withColumns({"parts": F.ceil(F.col("n") / curves).cast("int"), "mid_x": middle("cx"), "mid_y": middle("cy")})


def _bounds(r, table: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of an event and each block: the least site distance possible, and whether a day of it can be in season."""
    far = N._haversine(table["mid_x"].to_numpy(), table["mid_y"].to_numpy(), r.lon, r.lat) - table["reach"].to_numpy() - _SLACK
    a, b = table["d0"].to_numpy() - r.yday, table["d1"].to_numpy() - r.yday
    least = np.where(np.floor(b / 365) >= np.ceil(a / 365), 0.0, np.minimum(N._periodic(a, 0), N._periodic(b, 0)))
    unknown = np.isnan(far) | (table["cx"].to_numpy() < -(10**5)) | (table["cy"].to_numpy() < -(10**5))
    return np.where(unknown, 0.0, np.maximum(far, 0)), ~(least > N._periodic(r.yday, r.yday + r.gamma) + 1e-12)


def _choose(table: pd.DataFrame, probe: int, first: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Events to (event_id, param_id, block, part): the blocks to try first, or those left within the radius."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, parts = table["n"].to_numpy(), table["parts"].to_numpy()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                least, in_season = _bounds(r, table)
                order = np.flatnonzero(in_season)[np.argsort(least[in_season], kind="stable")]
                before = np.cumsum(n[order]) - n[order]
                near = order[before < probe * r.kappa_max]
                if first:
                    chosen = near
                else:
                    left = in_season & (least <= r.radius)
                    left[near] = False
                    chosen = np.flatnonzero(left)
                b = np.repeat(chosen, parts[chosen])
                part = np.arange(len(b)) - np.repeat(np.cumsum(parts[chosen]) - parts[chosen], parts[chosen])
                out.append((r.event_id, r.param_id, b, part))
            if out:  # one table a batch: making one an event costs more than the bounds
                size = [len(b) for _, _, b, _ in out]
                event, param = (np.repeat(np.array(c, dtype=np.int64), size) for c in list(zip(*out))[:2])
                yield pd.DataFrame({"event_id": event, "param_id": param, "block": np.concatenate([b for _, _, b, _ in out]), "part": np.concatenate([q for *_, q in out])})

    return run


def _score(weighted: DataFrame, pairs: DataFrame, placed: DataFrame, event_rows: int) -> DataFrame:
    """The rows that selection can need of the listed (event, parameter set, block, part); a part that
    many events want is copied for each chunk of them."""
    chunks = pairs.groupBy("block", "part").agg(F.ceil(F.count(F.lit(1)) / event_rows).cast("int").alias("chunks"))
    fold = lambda df, none: (F.coalesce(F.col("fold").cast("long"), F.lit(none)) if "fold" in df.columns else F.lit(none)).alias("fold")
    ev = weighted.select(*N.KEYS, "f", "e", "phi", "psi", "lon", "lat", "yday", "gamma", "length_scale_f", "length_scale_e", "xi", "kappa_min", "kappa_max", fold(weighted, -1))
    ev = pairs.join(chunks, ["block", "part"]).withColumn("_c", F.pmod(F.xxhash64(*N.KEYS), "chunks").cast("int")).drop("chunks").join(ev, N.KEYS)
    past = placed.join(chunks, ["block", "part"]).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    past = past.select(F.col("block").alias("h_block"), F.col("part").alias("h_part"), F.col("_c").alias("h_c"), *[F.col(c).alias(f"h_{c}") for c in N._CURVE], fold(placed, -2).alias("h_fold"))
    run = lambda a, b: N._needed_block(a, b.rename(columns=lambda c: c[2:]))
    # A number of our own: these rows are few bytes and much work, and would be merged into one task by their bytes.
    n = int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ev, past = ev.repartition(n, "block", "part", "_c"), past.repartition(n, "h_block", "h_part", "h_c")
    return ev.groupBy("block", "part", "_c").cogroup(past.groupBy("h_block", "h_part", "h_c")).applyInPandas(run, N._SCORED)


def near(
    weighted: DataFrame, history: DataFrame, settle: Callable[[DataFrame], DataFrame], degrees: float = 2.0, days: int = 30, probe: int = 4, event_rows: int = N.EVENT_ROWS, curves: int = N.CURVES,
) -> DataFrame:
    """Rows from which neighbors.select finds what it finds in those of neighbors.near: in_final and sigma are
    the same (in_sim and in_temporal are whole only for events that met all curves).

    An event first meets the near blocks of its season, until they hold `probe` times kappa_max
    curves. `settle` writes a table and reads it back: events, both lists of pairs and the first
    rows are used twice. The table of blocks has a fixed bound (see blocks) and goes to every task.
    Events or curves without a place or a day are never skipped for it.
    """
    spark = weighted.sparkSession
    table = blocks(history, degrees, days, curves).orderBy(*_BLOCK).toPandas()
    if table.empty:
        return N.near(weighted, history)
    keys = spark.createDataFrame([(int(r.cx), int(r.cy), int(r.season), i, int(r.parts)) for i, r in enumerate(table.itertuples())], "cx long, cy long, season long, block int, parts int")
    placed = _placed(history, degrees, days).join(F.broadcast(keys), _BLOCK).withColumn("part", F.pmod(F.xxhash64("curve_id"), "parts").cast("int"))
    weighted, placed = settle(weighted), settle(placed.drop("parts", *_BLOCK))
    sites = weighted.select(*N.KEYS, "lon", "lat", "yday", "gamma", "kappa_min", "kappa_max")
    schema = "event_id long, param_id int, block int, part int"
    tried = lambda who, n: settle(_score(weighted, settle(who.mapInPandas(_choose(table, n, True), schema)), placed, event_rows))
    first = tried(sites, probe)
    able = sites.where("kappa_min <= kappa_max")
    known = able.join(settle(_radius(first)), N.KEYS)
    found = _within_radius(first, known, weighted, placed, table, probe, settle, event_rows)
    rest = settle(sites.join(known.select(*N.KEYS), N.KEYS, "left_anti"))
    # Some curves near are similar, but too few: a wider look costs less than meeting all curves, of which very many may be similar.
    wide = _WIDER * probe
    some = first.groupBy(*N.KEYS).agg(F.sum("sim_here").alias("_n")).where(F.col("_n") >= _SOME).select(*N.KEYS)
    again = rest.where((F.col("kappa_min") <= F.col("kappa_max")) & (F.col("kappa_max") * (wide * _WIDER) <= int(table["n"].sum()))).join(some, N.KEYS)
    again = settle(again)
    if not again.isEmpty():
        second = tried(again, wide)
        more = again.join(settle(_radius(second)), N.KEYS)
        found = found.unionByName(_within_radius(second, more, weighted, placed, table, wide, settle, event_rows))
        rest = settle(rest.join(more.select(*N.KEYS), N.KEYS, "left_anti"))
    left = settle(weighted.join(rest.select(*N.KEYS), N.KEYS, "left_semi"))
    return found.unionByName(N.near_all(left, placed))


#: How many times more curves an event tries that has found so many similar ones at least, but not enough.
_WIDER, _SOME = 8, 2


def _radius(tried: DataFrame) -> DataFrame:
    """KEYS and radius of the events for which the near blocks hold more than kappa_max similar curves, and so many in season:
    no curve beyond the last of them is kept."""
    season = tried.where((F.col("w") >= F.col("xi")) & (F.col("d_p") <= F.col("big_gamma")) & F.col("d_h").isNotNull())
    at = season.withColumn("_r", F.row_number().over(Window.partitionBy(*N.KEYS).orderBy("d_h", "curve_id"))).where(F.col("_r") == F.col("kappa_max")).select(*N.KEYS, F.col("d_h").alias("radius"))
    sure = tried.groupBy(*N.KEYS).agg(F.sum("sim_here").alias("n_sim"), F.max("kappa_max").alias("kappa_max")).join(at, N.KEYS)
    return sure.where((F.col("n_sim") > F.col("kappa_max")) & F.col("radius").isNotNull()).select(*N.KEYS, "radius")


def _within_radius(tried: DataFrame, known: DataFrame, weighted: DataFrame, placed: DataFrame, table: pd.DataFrame, probe: int, settle: Callable[[DataFrame], DataFrame], event_rows: int) -> DataFrame:
    """Of the events known, the rows tried and those of the blocks left within their radius: similar ones of the season no
    further than that, as all others can't be chosen, and those that carry a count of similar ones."""
    rest = settle(known.mapInPandas(_choose(table, probe, False), "event_id long, param_id int, block int, part int"))
    rows = tried.unionByName(_score(weighted, rest, placed, event_rows)).join(known.select(*N.KEYS, "radius"), N.KEYS)
    chosen = (F.col("w") >= F.col("xi")) & (F.col("d_p") <= F.col("big_gamma")) & F.coalesce(F.col("d_h") <= F.col("radius"), F.lit(True))
    return rows.where(chosen | (F.col("sim_here") > 0)).drop("radius")
