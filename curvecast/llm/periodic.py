"""Periodic runs of words by string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q, at least max(LEAST, 2 q) long, that no
neighbouring word extends. Scale t (1, 2, 4, ...) finds the periods in [3 t, 6 t): position i is in
its synchronising set if, of the hashes of the t-grams at i..i+t, the least is that at i or at i+t.
Whether it is depends on the 2 t words from i alone, so a run that holds i and those words one
period on holds both positions; pairs of positions with equal 2 t words, 3 t to 6 t apart, propose
their distance as a period. t-grams inside regions with a period of at most t/3, known from smaller
scales, don't compete (else nearly all of their positions would be chosen); every run still has a
position in the set, or else its first period lies in such a region G and its second in the
adjoining one G', and then G and G' propose the periods that shift one onto the other. Periods 1
and 2, which no scale covers, are read off neighbouring words. Every proposal is extended word by
word in both directions, so hashes decide nothing but where to look.

Documents of a batch are laid end to end with a word of its own between any two. Words are runs of
bytes other than space and \\t-\\r. A null or empty text has no words and no runs; repeated rows come
out alike; an empty table stays empty; texts are read whole (a slice holds SLICE words or one
text). Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: The least length of a run in words, and the words laid end to end at a time.
LEAST, SLICE = 12, 400_000
_DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal stretch of True."""
    edge = np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class _Runs:
    """Runs found so far, (begin, end) to smallest period."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, int], int] = {}

    def add(self, begin: int, end: int, period: int) -> None:
        self.of[begin, end] = min(period, self.of.get((begin, end), period))

    def regions(self, most: int, least: int) -> np.ndarray:
        """period, begin, end of the runs of period <= most and length >= least, sorted."""
        found = sorted((p, a, b) for (a, b), p in self.of.items() if p <= most and b - a >= least)
        return np.array(found, dtype=np.int64).reshape(-1, 3)


def _matching(x: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The maximal stretch of places y around `at` with x[y] == x[y + p]."""
    n, right, step = len(x) - p, at, 64
    while right < n:
        stop = min(n, right + step)
        odd = x[right:stop] != x[right + p : stop + p]
        k = int(odd.argmax())
        if odd[k]:
            right += k
            break
        right, step = stop, 2 * step
    left, step = at, 64
    while left > 0:
        begin = max(0, left - step)
        odd = (x[begin:left] != x[begin + p : left + p])[::-1]
        k = int(odd.argmax())
        if odd[k]:
            left -= k
            break
        left, step = begin, 2 * step
    return left, right


def _settle_seeds(x: np.ndarray, at: np.ndarray, period: np.ndarray, runs: _Runs, least: int) -> None:
    """Extend each proposal (x[at] == x[at + period]); what is long enough is a run."""
    done, of = -1, -1
    order = np.lexsort((at, period))
    for i, p in zip(at[order].tolist(), period[order].tolist(), strict=True):
        if p == of and i < done:  # within the stretch of the one before
            continue
        left, right = _matching(x, i, p)
        done, of = right, p
        if right - left >= p and right - left + p >= least:
            runs.add(left, right + p, p)


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of `width` values, by doubling."""
    out, size = h, 1
    while size < width:
        step = min(size, width - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return out


def _synchronising(h: np.ndarray, t: int, regions: np.ndarray) -> np.ndarray:
    """Positions of the set at scale t; h: hashes of the t-grams."""
    if len(regions):  # t-grams of a period of at most t/3 don't compete
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(edge, regions[:, 1], 1)
        np.add.at(edge, regions[:, 2] - t + 1, -1)
        h = np.where(np.cumsum(edge[:-1]) > 0, _NONE, h)
    if len(h) <= t:
        return np.zeros(0, dtype=np.int64)
    least = _least_of(h, t + 1)
    return np.flatnonzero((least != _NONE) & ((h[:-t] == least) | (h[t:] == least)))


def _adjoining(x: np.ndarray, regions: np.ndarray, t: int) -> tuple[list[int], list[int]]:
    """Proposals of regions of one period q that touch: the periods in [3 t, 6 t) that shift one's root onto the other's."""
    at, period = [], []
    for (q, a, b), (q2, a2, b2) in zip(regions[:-1].tolist(), regions[1:].tolist(), strict=True):
        if q != q2 or a2 > b or min(b - a, b2 - a2) < 3 * t:
            continue
        root, hay = x[b - q : b].tobytes(), x[a2 : a2 + 2 * q].tobytes()
        k = hay.find(root)
        while k >= 0 and k % x.itemsize:
            k = hay.find(root, k + 1)
        shift = (a2 + k // x.itemsize - (b - q)) % q if k >= 0 else 0
        if shift:
            low = 3 * t + (shift - 3 * t) % q
            proposed = [p for p in range(low, min(6 * t, min(b - a, b2 - a2) + q + 1), q) if a2 - 1 + p < len(x) and x[a2 - 1] == x[a2 - 1 + p]]
            at += [a2 - 1] * len(proposed)
            period += proposed
    return at, period


def find_runs(x: np.ndarray, owner: np.ndarray | None = None, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of x (int64), sorted by start, then period.

    owner: hashes (uint64) that differ where grams needn't be compared, as between documents.
    """
    runs, n = _Runs(), len(x)
    for p in (1, 2):
        for a, b in zip(*_stretches(x[:-p] == x[p:]), strict=True) if n > p else ():
            if b - a >= p:
                runs.add(int(a), int(b) + p, p)
    owner = np.zeros(n, dtype=np.uint64) if owner is None else owner
    t, h, alive = 1, mix64(x.view(np.uint64)), np.arange(max(0, n - 1))
    while 6 * t <= n:
        double = mix64(h[:-t] * _ODD + h[t:])  # of the 2 t words from each position
        alive = alive[alive < len(double)]
        grams = double[alive] ^ owner[alive]
        _, which, often = np.unique(grams, return_inverse=True, return_counts=True)
        alive = alive[often[which] > 1]  # a run of this scale or a larger one repeats its 2 t words
        if not len(alive):
            break
        regions = runs.regions(t // 3, t)
        chosen = np.intersect1d(_synchronising(h, t, regions), alive, assume_unique=True)
        at, period = [], []
        for k in range(1, len(chosen)):
            apart = chosen[k:] - chosen[:-k]
            if not (apart < 6 * t).any():
                break
            pair = np.flatnonzero((apart >= 3 * t) & (apart < 6 * t) & (double[chosen[k:]] == double[chosen[:-k]]))
            at.append(chosen[pair])
            period.append(apart[pair])
        extra = _adjoining(x, regions, t)
        at, period = np.concatenate([*at, np.array(extra[0], dtype=np.int64)]), np.concatenate([*period, np.array(extra[1], dtype=np.int64)])
        _settle_seeds(x, at, period, runs, least)
        t, h = 2 * t, double
    return sorted((a, b - a, p) for (a, b), p in runs.of.items() if b - a >= max(least, 2 * p))


def _numbered(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all documents end to end, a number of its own after each; owners; where each document starts."""
    ids: dict[bytes, int] = {}
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    x = np.empty(starts[-1], dtype=np.int64)
    fresh = count()
    for k, words in enumerate(parts):
        x[starts[k] : starts[k + 1] - 1] = np.fromiter(map(ids.setdefault, words, fresh), dtype=np.int64, count=len(words))
        x[starts[k + 1] - 1] = -1 - k
    owner = np.repeat(mix64(np.arange(len(parts), dtype=np.uint64)), np.diff(starts))
    return x, owner, starts


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that come after the first period of a run."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]) if runs else b" ".join(words)


def runs_of_texts(texts: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs, and the collapsed text of each."""
    parts = [t.split() for t in texts]  # bytes.split() cuts at space and \t-\r only
    x, owner, starts = _numbered(parts)
    per: list[list] = [[] for _ in parts]
    found = find_runs(x, owner, least)
    for k, (a, length, p) in zip(np.searchsorted(starts, [f[0] for f in found], side="right") - 1, found, strict=True):
        per[k].append((a - int(starts[k]), length, p))
    return [(len(w), r, collapse(w, r)) for w, r in zip(parts, per, strict=True)]


def detect_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the text without repeats) of each document."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batch(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        found = runs_of_texts(texts, least)
        runs = [[{"start": a, "length": n, "period": p} for a, n, p in f[1]] for f in found]
        cols = [pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array(runs, run_type), pa.array([f[2] for f in found], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                raw = t.as_py() or b""
                if ids and size + len(raw) > 4 * SLICE:
                    yield batch(ids, texts)
                    ids, texts, size = [], [], 0
                ids, texts, size = [*ids, i], [*texts, raw], size + len(raw)
            yield batch(ids, texts)

    text = F.make_valid_utf8(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, _DDL)
