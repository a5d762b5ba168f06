"""The focal curve's envelope: curves that jointly surround the deepest one, and smoothing.

The greedy cover is sequential by nature, but its unit is one event's scenario set of at most
kappa_max curves; the sets spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvecast.operators import depth as D

SET = "set_id long, param_id int"
KEYS = ["event_id", "param_id"]


def mbd_matrix(y: np.ndarray) -> np.ndarray:
    """Modified band depth of the rows of y, in closed form."""
    n = len(y)
    if n < 2:
        return np.zeros(n)
    order = np.sort(y, axis=0)
    below = np.stack([np.searchsorted(order[:, j], y[:, j], "left") for j in range(y.shape[1])], axis=1)
    above = n - np.stack([np.searchsorted(order[:, j], y[:, j], "right") for j in range(y.shape[1])], axis=1)
    return (1 - (below * (below - 1) + above * (above - 1)) / (n * (n - 1))).mean(axis=1)


def integrated_matrix(y: np.ndarray) -> np.ndarray:
    """Fraiman-Muniz depth of the rows of y: the mean of 1 - |1/2 - F(x)|."""
    order = np.sort(y, axis=0)
    share = np.stack([np.searchsorted(order[:, j], y[:, j], "right") for j in range(y.shape[1])], axis=1) / len(y)
    return (1 - np.abs(0.5 - share)).mean(axis=1)


def l_infinity_matrix(y: np.ndarray) -> np.ndarray:
    """1 / (1 + the mean largest distance to the other rows)."""
    if len(y) < 2:
        return np.zeros(len(y))
    return 1 / (1 + np.abs(y[:, None] - y[None]).max(axis=2).sum(axis=1) / (len(y) - 1))


#: Depths of the few curves of one set; each is the depth of that name over whole tables.
DEPTHS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"MBD": mbd_matrix, "ID": integrated_matrix, "LD": l_infinity_matrix}


def focal_distances(scen: DataFrame, depths: DataFrame) -> DataFrame:
    """curve_id with sup and squared L2 distance to its set's deepest curve."""
    first = Window.partitionBy("set_id").orderBy(F.col("depth").desc(), "curve_id")
    focal = depths.withColumn("_p", F.row_number().over(first)).where("_p = 1").select(F.col("set_id.event_id").alias("event_id"), F.col("set_id.param_id").alias("param_id"), F.col("curve_id").alias("focal_id"))
    f = scen.join(focal, KEYS).where("curve_id = focal_id").select(*KEYS, "s", "focal_id", F.col("m").alias("fm"))
    d = F.col("m") - F.col("fm")
    return scen.join(f, [*KEYS, "s"]).groupBy(*KEYS, "curve_id", "focal_id").agg(F.max(F.abs(d)).alias("sup"), F.sum(d * d).alias("l2"))


def greedy_envelope(y: np.ndarray, distance: np.ndarray | None, kind: str, most: int = 100, depth: Callable[[np.ndarray], np.ndarray] = mbd_matrix) -> list[int]:
    """Row numbers of the envelope, deepest first by `depth`.

    Each round walks the pool by distance. The nearest curve opens the round's sample unchecked and
    stays in the pool until another is accepted; a curve is accepted if, with the sample, it has
    the focal curve strictly between at some slot that isn't surrounded yet. The sample joins the
    envelope if the focal curve is no less deep in it than in any round before.
    """
    focal = int(np.argsort(-depth(y), kind="stable")[0])
    gap = y - y[focal]
    if distance is None:
        distance = np.abs(gap).max(axis=1) if kind == "sup" else (gap**2).sum(axis=1)
    sign = np.sign(gap)
    pool, chosen, best = [i for i in range(len(y)) if i != focal], [], 0.0
    for _ in range(most):
        if len(pool) <= 1:
            break
        walk = sorted(pool, key=lambda i: (distance[i], i))
        sample, open_slots = [walk[0]], np.ones(y.shape[1], dtype=bool)
        total = sign[walk[0]].copy()
        left = walk[1:]
        while open_slots.any() and left:
            c = left.pop(0)
            surrounded = np.abs(total + sign[c]) < len(sample) + 1
            if (surrounded & open_slots).any():
                open_slots &= ~surrounded
                sample.append(c)
                total += sign[c]
                pool = [p for p in pool if p not in sample]
        group = [focal, *chosen, *sample]
        order = np.argsort(-depth(y[group]), kind="stable")
        place = 1 - int(np.flatnonzero(order == 0)[0]) / (len(group) - 1)
        if best <= place:
            chosen += sample
        best = max(best, place)
        if not left:
            break
    group = [focal, *chosen]
    return [group[i] for i in np.argsort(-depth(y[group]), kind="stable")]


def focal_envelope(scen: DataFrame, kind: str = "l2", depth: str | Callable[[np.ndarray], np.ndarray] = "MBD") -> DataFrame:
    """event_id, param_id, curve_id, place (0: the deepest) of each set's envelope.

    kind: "sup", "l2", or "similarity" (1 - w of column `w`, the most similar first).
    depth: a name in DEPTHS, or a function from a set's curves (a row each) to their depths.
    """
    measure = DEPTHS[depth] if isinstance(depth, str) else depth

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="curve_id", columns="s", values="m")
        given = 1 - pdf.groupby("curve_id")["w"].first().reindex(wide.index).to_numpy() if kind == "similarity" else None
        order = greedy_envelope(wide.to_numpy(), given, kind, depth=measure)
        return pd.DataFrame({"event_id": pdf["event_id"].iloc[0], "param_id": pdf["param_id"].iloc[0], "curve_id": wide.index.to_numpy()[order], "place": range(len(order))})

    return scen.groupBy(*KEYS).applyInPandas(run, "event_id long, param_id int, curve_id long, place int")


def functional_bands(scen: DataFrame, envelope: DataFrame, sizes: DataFrame, fractions: list[float]) -> DataFrame:
    """For each fraction the deepest curve as centre and the range of places 1 to k - 1; k is
    floor(fraction n), n the set's n_scenarios in sizes; no range if k <= 1."""
    every = F.explode(F.array(*[F.lit(x) for x in fractions])).alias("fraction")
    rows = scen.join(envelope.join(sizes, KEYS), [*KEYS, "curve_id"]).select(*KEYS, "s", "m", "place", "n_scenarios", every)
    inside = (F.col("place") >= 1) & (F.col("place") < F.floor(F.col("fraction") * F.col("n_scenarios")))
    return rows.groupBy(*KEYS, "fraction", "s").agg(F.max(F.when(F.col("place") == 0, F.col("m"))).alias("center"), F.min(F.when(inside, F.col("m"))).alias("lower"), F.max(F.when(inside, F.col("m"))).alias("upper"))


def spline_smoother(points: int, at: np.ndarray, n_basis: int) -> np.ndarray:
    """The matrix that fits a least-squares cubic B-spline to `points` even samples and reads it at `at`."""
    inner = np.linspace(0, points - 1, n_basis - 2)
    knots = np.concatenate([[inner[0]] * 3, inner, [inner[-1]] * 3])

    def basis(x: np.ndarray) -> np.ndarray:
        b = ((x[:, None] >= knots[:-1]) & (x[:, None] < knots[1:])).astype(float)
        b[x >= knots[-1], n_basis - 1] = 1  # the last span is closed
        for d in range(1, 4):
            up, down = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
            left = np.divide(x[:, None] - knots[: -d - 1], up, out=np.zeros((len(x), len(up))), where=up > 0)
            right = np.divide(knots[d + 1 :] - x[:, None], down, out=np.zeros((len(x), len(down))), where=down > 0)
            b = left * b[:, :-1] + right * b[:, 1:]
        return b[:, :n_basis]

    return basis(np.asarray(at, dtype=float)) @ np.linalg.pinv(basis(np.arange(points, dtype=float)))


def smooth_grid(leads: int, step: int) -> np.ndarray:
    """Where smoothed curves are read: from the first lead to the last, one for each `step` of them."""
    return np.linspace(1, leads, max(1, leads // step))


def smooth(scen: DataFrame, last: DataFrame, leads: int, step: int, n_basis: int = 6) -> DataFrame:
    """event_id, param_id, curve_id, s, m: each curve with the last observation before it, smoothed
    and read at every `step`-th lead. The smoother depends on the grid alone and is broadcast."""
    spark = scen.sparkSession
    matrix = spline_smoother(leads + 1, smooth_grid(leads, step), n_basis)
    table = spark.createDataFrame([(int(i), int(j) - 1, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)], "i int, s int, c double")
    begun = scen.select(*KEYS, "curve_id", "s", "m").unionByName(scen.select(*KEYS, "curve_id").distinct().join(last, "event_id").select(*KEYS, "curve_id", F.lit(-1).alias("s"), F.col("v").alias("m")))
    return begun.join(F.broadcast(table), "s").groupBy(*KEYS, "curve_id", F.col("i").alias("s")).agg(F.sum(F.col("c") * F.col("m")).alias("m"))


def depth_of(scen: DataFrame, name: str = "MBD") -> DataFrame:
    from curvecast.operators.bands import as_sets

    return D.REGISTRY[name](as_sets(scen))
