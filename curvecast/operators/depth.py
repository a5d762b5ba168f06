"""Functional depths over sets of curves in long form (set_id, curve_id, tau, v).

All rank by set and slot, so the sets spread over the cluster; nothing but the three pair depths
looks at pairs. Those are quadratic (band depth: cubic) by definition; they go over pairs of blocks
of a set's curves, whose partial sums alone are shuffled on, so a set may be of any size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvecast.operators import ranks
from curvecast.plans.workdir import settle

#: Curves in a block of the pair depths, and bins in which their quantile is looked for.
BLOCK, BINS = 500, 4096
SLOT = ["set_id", "tau"]
CURVE = ["set_id", "curve_id"]
EPS = 2.220446049250313e-16


def _ranked(x: DataFrame) -> DataFrame:
    """below, above and n at each slot, ties counted on neither side."""
    up = Window.partitionBy(*SLOT).orderBy("v")
    down = Window.partitionBy(*SLOT).orderBy(F.col("v").desc())
    return x.withColumns({"below": F.rank().over(up) - 1, "above": F.rank().over(down) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*SLOT))})


def mbd(x: DataFrame) -> DataFrame:
    """Modified band depth over pairs, in closed form: 1 - (C(b,2) + C(a,2)) / C(n,2), averaged."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    return _ranked(x).groupBy(*CURVE).agg(F.avg(1 - (pairs("below") + pairs("above")) / pairs("n")).alias("depth"))


def _slot_quantiles(x: DataFrame, probs: list[float], bounded: bool) -> DataFrame:
    """SLOT, mu and q of each slot. bounded: sets are known to be small (scenario sets), so that one buffer may hold a slot."""
    if bounded:
        return x.groupBy(*SLOT).agg(F.avg("v").alias("mu"), F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q"))
    return x.groupBy(*SLOT).agg(F.avg("v").alias("mu")).join(ranks.quantiles(x, SLOT, "v", probs), SLOT)


def directional_quantile(x: DataFrame, q: float, bounded: bool = False) -> DataFrame:
    """Largest distance from the slot's mean in units of its side's quantile gap (outlyingness)."""
    return directional_quantiles(x, (q,), bounded).withColumnRenamed("dq_1", "depth")


def directional_quantiles(x: DataFrame, qs: tuple[float, ...], bounded: bool = False) -> DataFrame:
    """directional_quantile at several levels in one pass: columns dq_1, dq_2, ..."""
    stats = _slot_quantiles(x, [*qs, *[1 - q for q in qs]], bounded).withColumnRenamed("q", "p")
    j = x.join(stats, SLOT)
    out = []
    for i in range(len(qs)):
        gap = F.when(F.col("v") >= F.col("mu"), F.col("p")[i + len(qs)] - F.col("mu")).otherwise(F.col("mu") - F.col("p")[i])
        out.append(F.max(F.abs(F.col("v") - F.col("mu")) / F.when(gap == 0, F.lit(EPS)).otherwise(gap)).alias(f"dq_{i + 1}"))
    return j.groupBy(*CURVE).agg(*out)


def extreme_rank_length(x: DataFrame) -> DataFrame:
    """Share of curves whose sorted pointwise two-sided ranks are lexicographically at most as large."""
    two = F.least(F.col("below") + 1, F.col("above") + 1)
    own = _ranked(x).groupBy(*CURVE).agg(F.sort_array(F.collect_list(two)).alias("ranks"))
    at = ranks.cumulated(own, ["set_id"], F.col("ranks"))
    return at.select(*CURVE, ((F.col("_upto") - F.col("_own") + 1) / F.col("_all")).alias("depth"))


def extremal(x: DataFrame) -> DataFrame:
    """Share of curves that are at most as deep in the left-tail order of pointwise depths."""
    deep = _ranked(x).withColumn("p", 1 - F.abs(F.col("above") - F.col("below")) / F.col("n"))
    tails = deep.groupBy(*CURVE).agg(F.sort_array(F.collect_list(F.round("p", 12))).alias("tail"))
    return ranks.cumulated(tails, ["set_id"], F.col("tail")).select(*CURVE, (F.col("_upto") / F.col("_all")).alias("depth"))


def integrated(x: DataFrame) -> DataFrame:
    """Fraiman-Muniz: mean over slots of 1 - |1/2 - F(x)|."""
    share = F.cume_dist().over(Window.partitionBy(*SLOT).orderBy("v"))
    return x.withColumn("_p", 1 - F.abs(0.5 - share)).groupBy(*CURVE).agg(F.avg("_p").alias("depth"))


def outliergram(x: DataFrame) -> DataFrame:
    """(mbd, mei): modified band depth and mean share of curves that lie at or above."""
    up = _ranked(x).groupBy(*CURVE).agg(F.avg((F.col("n") - F.col("below")) / F.col("n")).alias("mei"))
    return mbd(x).withColumnRenamed("depth", "mbd").join(up, CURVE)


def magnitude_shape(x: DataFrame) -> DataFrame:
    """Mean and variance over slots of the directional outlyingness (v - median) / MAD."""
    half = lambda rows, c: ranks.quantiles(rows, SLOT, c, [0.5])
    med = half(x, "v").select(*SLOT, F.col("q")[0].alias("med"))
    dev = x.join(med, SLOT).withColumn("d", F.col("v") - F.col("med"))
    mad = half(dev.select(*SLOT, F.abs("d").alias("d")), "d").select(*SLOT, (1.4826 * F.col("q")[0]).alias("mad"))
    out = dev.join(mad, SLOT).withColumn("o", F.when(F.col("mad") > 0, F.col("d") / F.col("mad")))
    return out.groupBy(*CURVE).agg(F.avg("o").alias("magnitude"), F.var_pop("o").alias("shape"))


def _blocks(x: DataFrame, block: int) -> DataFrame:
    """set_id, curve_id, v (array over the sorted slots), n (curves of the set), at (block), blocks."""
    packed = x.groupBy(*CURVE).agg(F.transform(F.sort_array(F.collect_list(F.struct("tau", "v"))), lambda p: p["v"]).alias("v"))
    size = packed.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    return packed.join(size, "set_id").withColumn("at", F.pmod(F.xxhash64("curve_id"), "blocks").cast("int"))


def _over_pairs(x: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """run(left, right) for every pair of blocks of each set, in both orders."""
    return _over_blocks(_blocks(x, block), run, schema)


def _gaps(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest and squared L2 distances of the curves of two blocks, and which pairs are of two curves."""
    x, y = np.stack(left["v"]), np.stack(right["v"])
    sup, l2 = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        d = np.abs(x[:, k, None] - y[None, :, k])
        sup = np.maximum(sup, d)
        l2 += d * d
    return sup, l2, left["curve_id"].to_numpy()[:, None] != right["curve_id"].to_numpy()[None, :]


def _set_type(x: DataFrame) -> str:
    return x.schema["set_id"].dataType.simpleString()


def _set_of(pdf: pd.DataFrame, n: int) -> list:
    return [pdf["set_id"].iloc[0]] * n


def curve_pairs(x: DataFrame, block: int = BLOCK) -> DataFrame:
    """set_id, a, b, sup and squared L2 distance of each ordered pair."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"set_id": [], "a": [], "b": [], "sup": [], "l2": []})
        sup, l2, differ = _gaps(left, right)
        i, j = np.nonzero(differ)
        return pd.DataFrame({"set_id": _set_of(left, len(i)), "a": left["curve_id"].to_numpy()[i], "b": right["curve_id"].to_numpy()[j], "sup": sup[i, j], "l2": l2[i, j]})

    return _over_pairs(x, run, f"set_id {_set_type(x)}, a long, b long, sup double, l2 double", block)


def _summed(x: DataFrame, value: Callable[[np.ndarray, np.ndarray, pd.DataFrame], np.ndarray], block: int) -> DataFrame:
    """set_id, curve_id, total, others: a function of each pair's distances added up by curve."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"set_id": [], "curve_id": [], "part": [], "m": []})
        sup, l2, differ = _gaps(left, right)
        part = np.where(differ, value(sup, l2, left), 0).sum(axis=1)
        return pd.DataFrame({"set_id": _set_of(left, len(left)), "curve_id": left["curve_id"].to_numpy(), "part": part, "m": differ.sum(axis=1)})

    parts = _over_pairs(x, run, f"set_id {_set_type(x)}, curve_id long, part double, m long", block)
    return parts.groupBy(*CURVE).agg(F.sum("part").alias("total"), F.sum("m").alias("others")).where("others > 0")


def l_infinity(x: DataFrame, block: int = BLOCK) -> DataFrame:
    return _summed(x, lambda sup, l2, left: sup, block).select(*CURVE, (1 / (1 + F.col("total") / F.col("others"))).alias("depth"))


def _pair_quantile(base: DataFrame, q: float) -> DataFrame:
    """set_id, h: the q-quantile (between ranks linearly) of the L2 distances of a set's pairs; base:
    settled blocks with tops, a bound of the set's distances.

    A first pass counts distances in bins up to that bound; a second one counts the different
    distances of the bins that hold the two ranks, so that ties are a row and not one a pair.
    """
    key = _set_type(base)

    def distances(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair its distance and bin."""
        _, l2, differ = _gaps(left, right)
        r, most = np.sqrt(l2[differ]), left["tops"].iloc[0]
        return r, np.minimum((r / most * BINS).astype(int), BINS - 1) if most > 0 else np.zeros(len(r), dtype=int)

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"set_id": [], "bin": [], "c": []})
        c = np.bincount(distances(left, right)[1], minlength=BINS)
        at = np.flatnonzero(c)
        return pd.DataFrame({"set_id": _set_of(left, len(at)), "bin": at, "c": c[at]})

    def listed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"set_id": [], "r": [], "c": []})
        r, b = distances(left, right)
        r, c = np.unique(r[(b >= left["low"].iloc[0]) & (b <= left["high"].iloc[0])], return_counts=True)
        return pd.DataFrame({"set_id": _set_of(left, len(r)), "r": r, "c": c})

    upto = F.sum("c").over(Window.partitionBy("set_id").orderBy("bin"))
    counts = _over_blocks(base, count, f"set_id {key}, bin int, c long").groupBy("set_id", "bin").agg(F.sum("c").alias("c"))
    run = counts.withColumns({"upto": upto, "all": F.sum("c").over(Window.partitionBy("set_id"))})
    rank = q * (F.col("all") - 1)  # from 0
    hold = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("c") <= k)
    spot = settle(run.groupBy("set_id").agg(
        F.max(F.when(hold(F.floor(rank)), F.col("bin"))).alias("low"), F.max(F.when(hold(F.ceil(rank)), F.col("bin"))).alias("high"),
        F.max(rank).alias("rank"), F.max(F.when(hold(F.floor(rank)), F.col("upto") - F.col("c"))).alias("before"),
    ))
    values = _over_blocks(base, listed, f"set_id {key}, r double, c long", spot.select("set_id", "low", "high")).groupBy("set_id", "r").agg(F.sum("c").alias("c"))
    order = values.withColumn("upto", F.sum("c").over(Window.partitionBy("set_id").orderBy("r"))).join(spot, "set_id").withColumn("upto", F.col("upto") + F.col("before"))
    ends = order.where(hold(F.floor("rank")) | hold(F.ceil("rank"))).groupBy("set_id").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.max("rank").alias("rank"))
    return ends.select("set_id", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias("h"))


def _over_blocks(base: DataFrame, run, schema: str, marks: DataFrame | None = None) -> DataFrame:
    """run(left, right) for every pair of blocks of each set, in both orders; marks: columns of the set for the left side."""
    rows = base.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    left = rows.withColumnsRenamed({"at": "i", "other": "j"})
    if marks is not None:
        left = left.join(marks, "set_id")
    # The right side's columns have names of their own, as both sides come of one table.
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in (*CURVE, "v", "n")], F.col("at").alias("r_j"), F.col("other").alias("r_i"))
    pair = lambda a, b: run(a, b.rename(columns=lambda c: c[2:]))
    return left.groupBy("set_id", "i", "j").cogroup(right.groupBy("r_set_id", "r_i", "r_j")).applyInPandas(pair, schema)


def modal(x: DataFrame, q: float = 0.15, block: int = BLOCK) -> DataFrame:
    """Sum of Gaussian kernels of L2 distances; the width is a low quantile of all of the set's.

    Three passes over the pairs of settled blocks: two find the width, one adds up."""
    key = _set_type(x)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"set_id": [], "curve_id": [], "part": []})
        _, l2, differ = _gaps(left, right)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(differ, np.exp(-0.5 * l2 / left["h"].iloc[0] ** 2), 0).sum(axis=1)
        return pd.DataFrame({"set_id": _set_of(left, len(left)), "curve_id": left["curve_id"].to_numpy(), "part": part})

    top = x.groupBy(*SLOT).agg((F.max("v") - F.min("v")).alias("g")).groupBy("set_id").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("tops"))
    base = settle(_blocks(x, block).join(top, "set_id"))
    width = settle(_pair_quantile(base, q))
    parts = _over_blocks(base, run, f"set_id {key}, curve_id long, part double", width)
    return parts.groupBy(*CURVE).agg(F.sum("part").alias("depth"))


def band(x: DataFrame, block: int = 200) -> DataFrame:
    """Band depth: share of pairs of curves whose band holds the whole curve.

    A pair holds a curve where no slot has both strictly on the same side of it. For each curve of a
    block that is a product of two blocks' side matrices, so each task has three blocks of a set.
    """
    base = _blocks(x, block)
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(name)
    cols = [*CURVE, "v", "n"]
    held = base.select(*cols, F.col("at").alias("h"), "blocks", every("i")).select(*cols, "h", "i", every("j"), F.lit(0).alias("role"))
    first = base.select(*cols, "blocks", F.col("at").alias("i"), every("h")).select(*cols, "h", "i", every("j"), F.lit(1).alias("role"))
    second = base.select(*cols, "blocks", F.col("at").alias("j"), every("h")).select(*cols, "h", every("i"), "j", F.lit(2).alias("role"))
    dealt = held.union(first).union(second).where("i <= j")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, a, b = (pdf[pdf["role"] == k] for k in range(3))
        if not (len(c) and len(a) and len(b)):
            return pd.DataFrame({"set_id": [], "curve_id": [], "n": [], "part": []})
        x, y = np.stack(a["v"]), np.stack(b["v"])
        ids = a["curve_id"].to_numpy()[:, None] < b["curve_id"].to_numpy()[None, :] if pdf["i"].iloc[0] == pdf["j"].iloc[0] else np.ones((len(a), len(b)), dtype=bool)
        part = []
        for v in c["v"]:
            both = (x > v).astype(np.float32) @ (y > v).T.astype(np.float32) + (x < v).astype(np.float32) @ (y < v).T.astype(np.float32)
            part.append(int(((both == 0) & ids).sum()))
        return pd.DataFrame({"set_id": _set_of(c, len(c)), "curve_id": c["curve_id"].to_numpy(), "n": c["n"].to_numpy(), "part": part})

    parts = dealt.groupBy("set_id", "h", "i", "j").applyInPandas(run, f"set_id {_set_type(x)}, curve_id long, n long, part long")
    return parts.where("n > 1").groupBy(*CURVE).agg((F.sum("part") / (F.max("n") * (F.max("n") - 1) / 2)).alias("depth"))


def _projected(x: DataFrame, n: int, seed: int) -> DataFrame:
    """Projections on n seeded Gaussian directions, a function of (seed, direction, slot) alone."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "j", "tau"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    gauss = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))
    return x.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(n)))).groupBy(*CURVE, "j").agg(F.sum(F.col("v") * gauss).alias("p"))


def _tukey(x: DataFrame, n: int, seed: int) -> DataFrame:
    share = F.cume_dist().over(Window.partitionBy("set_id", "j").orderBy("p"))
    back = F.cume_dist().over(Window.partitionBy("set_id", "j").orderBy(F.col("p").desc()))
    return _projected(x, n, seed).withColumn("_d", F.least(share, back))


def random_projection(x: DataFrame, n: int = 20, seed: int = 1) -> DataFrame:
    return _tukey(x, n, seed).groupBy(*CURVE).agg(F.avg("_d").alias("depth"))


def random_tukey(x: DataFrame, n: int = 20, seed: int = 1) -> DataFrame:
    return _tukey(x, n, seed).groupBy(*CURVE).agg(F.min("_d").alias("depth"))


#: Depths by name; a larger value is deeper (dq is negated outlyingness).
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "MBD": mbd, "BD": band, "ERL": extreme_rank_length, "ED": extremal, "ID": integrated, "LD": l_infinity, "MD": modal, "RP": random_projection, "RT": random_tukey,
    "DQ": lambda x: directional_quantile(x, 0.05).withColumn("depth", -F.col("depth")),
}


def order_by_depth(depths: DataFrame) -> DataFrame:
    """place: 1 for the deepest curve of each set, ties by curve_id."""
    first = F.struct(F.col("depth").isNull(), ~F.isnan("depth"), -F.col("depth"), F.col("curve_id"))  # as descending order has it: NaN first, nulls last
    return ranks.cumulated(depths, ["set_id"], first).withColumn("place", F.col("_upto").cast("int")).drop("_upto", "_own", "_all")
