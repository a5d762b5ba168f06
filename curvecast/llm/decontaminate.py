"""Benchmark decontamination by template canonicalisation.

Numbers, quantities, names and units become typed placeholders; windows of eight template tokens
with at least four literal ones are hashed and joined with those of the benchmark items. Windows of
fewer literals are hashed with their slot values and only match verbatim (but for case). An item
leaks into a text when half of its template windows are matched, or half of all its windows.

The join is a hash join of two tables of windows. As half of an item's windows must match, its
rarest half (and one more) are joined first; so a phrase that very many items and texts share
brings no pair together unless a rarer window does too. Matched windows lie on diagonals (text
position minus item position). All diagonals that count together must map the item's slot values to
the text's one to one, so copies with other numbers don't lend each other windows; each set of
diagonals that fit together is judged by itself.

An item of five to eight tokens is one window of its length; a shorter one can't identify a leak
(short_items lists those). Null and empty texts match nothing, repeated rows are judged alike, and
empty tables give empty results. Texts are read whole. Letters fold A-Z only. Further columns of
any name stay as they are (drop_leaks) or are not read (find_leaks).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, U64, bitmap_of, ensure, mix64, release, settle, unsent, without_texts

WINDOW, MIN_LITERAL, MIN_ITEM = 8, 4, 5
MIN_COVERAGE = 0.5
CHUNK_BYTES = 1 << 20

#: Unit words that turn a following placeholder when they stand after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent degrees celsius fahrenheit kelvin hz khz mhz ghz w kw kwh v volts j joules n newtons pa kb mb gb tb bytes mph kmh"
).split()

_SPACE, _PUNCT, _DIGIT, _UPPER, _LOWER = range(5)
_CLASS = np.full(256, _LOWER, dtype=np.uint8)
_CLASS[:128] = [_SPACE if c in (9, 10, 11, 12, 13, 32) else _DIGIT if 48 <= c < 58 else _UPPER if 65 <= c < 91 else _LOWER if 97 <= c < 123 else _PUNCT for c in range(128)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = mix64(np.arange(256, dtype=U64))
_PLACE = mix64(np.arange(4096, dtype=U64) + U64(1 << 20)) | U64(1)
_STEP = mix64(np.arange(WINDOW, dtype=U64) + U64(1 << 21)) | U64(1)
_BREAK = np.zeros(256, dtype=np.int32)
_BREAK[[ord(c) for c in ".!?\n"]] = 1
#: An odd number and its inverse modulo 2^64, for rolling hashes.
_ODD_POWERS = (U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
_NUM, _NAME, _UNIT, _QTY, _EXACT = (mix64(np.arange(5, dtype=U64) + U64(1 << 22)).tolist())


def _sum_hash(values: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
    return total[ends] - total[firsts]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: each token's template hash, its slot value's hash (0 for a literal),
    and for each text the index of its first token and the one after its last."""
    a = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    kind = _CLASS[a]
    word = kind >= _DIGIT
    full = kind > _SPACE
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    at = np.flatnonzero(word)
    tid = np.cumsum(begins, dtype=np.int32)[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = tid[1:] != tid[:-1]
    firsts = at[new]
    if not len(firsts):
        none = np.zeros(0, U64)
        zero = np.zeros(len(texts), dtype=np.int64)
        return none, none, zero, zero
    lasts = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    ends = lasts + 1
    sizes = ends - firsts
    core = np.repeat(firsts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    inside = core - np.repeat(firsts, sizes)
    with np.errstate(over="ignore"):
        parts = _BYTE[_FOLD[a[core]]] * _PLACE[inside & 4095]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        h = _sum_hash(parts, bounds[:-1], bounds[1:])
    ck = kind[core]
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[bounds])
    letters, upper = count(ck >= _UPPER), count(ck == _UPPER)
    digit_first = kind[firsts] == _DIGIT
    number, quantity = digit_first & (letters == 0), digit_first & (letters > 0)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[a])])
    previous_end = np.concatenate([[0], ends[:-1]])
    starts_sentence = breaks[firsts] > breaks[previous_end]
    lo = np.searchsorted(firsts, edges[:-1])
    starts_sentence[lo[lo < len(firsts)]] = True
    name = (kind[firsts] == _UPPER) & (upper == 1) & (sizes > 1) & ~starts_sentence
    after_number = np.concatenate([[False], number[:-1]]) & ~starts_sentence
    unit = after_number & np.isin(h, _UNIT_HASHES)
    out = np.where(number, U64(_NUM), np.where(quantity, U64(_QTY), np.where(unit, U64(_UNIT), np.where(name, U64(_NAME), h))))
    slot = np.where(number | quantity | unit | name, h | U64(1), U64(0))
    return out, slot, lo, np.searchsorted(firsts, edges[1:])


def _word_hash(word: str) -> int:
    b = word.encode()
    with np.errstate(over="ignore"):
        return int((_BYTE[np.frombuffer(b, np.uint8)] * _PLACE[: len(b)]).sum(dtype=U64))


_UNIT_HASHES = np.array(sorted({_word_hash(w) for w in UNITS}), dtype=U64)


def windows(template: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of so many tokens."""
    n = len(template) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for k in range(size):
            out += template[k : k + n] * _STEP[k]
        return mix64(out ^ U64(size))


def _literal(slot: np.ndarray, size: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(slot == 0)])
    return total[size:] - total[:-size]


def exact(template: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Each token's own hash, whether it is a slot or not; apart from those of templates."""
    with np.errstate(over="ignore"):
        return mix64(np.where(slot != 0, slot, template | U64(1)) ^ U64(_EXACT))


def item_windows(template: np.ndarray, slot: np.ndarray, size: int, verbatim: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window, and whether it has literals enough to match as a template; others are
    hashed with their slot values (verbatim: whether those are wanted at all)."""
    ok = _literal(slot, size) >= min(MIN_LITERAL, size - 1)
    h = windows(template, size)
    return (h if ok.all() or not verbatim else np.where(ok, h, windows(exact(template, slot), size))), ok


_ITEM = ["item_id", "item_hash"]
_WINDOWS = "item_id long, item_hash long, pos int, size int, h long, ok boolean, item_slots array<long>, n_ok int, n_all int"


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """Every window of every different item: where it is, its hash and slot values (0 for a literal),
    and how many windows the item has, with literals enough (n_ok) and in all."""
    bench = ensure(bench, item_id="long", text="string").select("item_id", F.xxhash64("text").alias("item_hash"), "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, own, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                t, s, _, _ = tokens([(text or "").encode()])
                if len(t) >= MIN_ITEM:
                    size = min(WINDOW, len(t))
                    h, ok = item_windows(t, s, size)
                    s = s.view(np.int64)
                    rows += [(item, own, p, size, x, y, s[p : p + size].tolist(), int(ok.sum()), len(ok)) for p, (x, y) in enumerate(zip(h.view(np.int64).tolist(), ok.tolist(), strict=True))]
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in _WINDOWS.split(", ")])

    return bench.mapInArrow(run, _WINDOWS)


def short_items(bench: DataFrame) -> DataFrame:
    """item_id of the items of fewer than MIN_ITEM tokens, which are not matched."""
    rows = ensure(bench, item_id="long", text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [len(tokens([(t or "").encode()])[0]) < MIN_ITEM for t in b.column(1).to_pylist()]
            yield b.select(["item_id"]).filter(pa.array(short, pa.bool_()))

    return rows.mapInArrow(run, "item_id long")


def _chunks(nodes: list[int], texts: list) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    own, part, size = [], [], 0
    for node, t in zip(nodes, texts, strict=True):
        own.append(node)
        part.append((t or "").encode())
        size += len(part[-1])
        if size >= CHUNK_BYTES:
            yield np.array(own, dtype=np.int64), part
            own, part, size = [], [], 0
    if part:
        yield np.array(own, dtype=np.int64), part


def _text_windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """th, p, h, text_slots: the windows of the texts that pass a filter of the benchmark's hashes."""
    sizes = [(r[0], r[1]) for r in found.groupBy("size").agg(F.min("ok")).collect()]  # at most WINDOW rows
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(found.select("h").distinct(), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            b = b.filter(pa.array(unsent(b.column(0).to_pylist(), sent), pa.bool_()))
            for own, texts in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                template, slot, _, hi = tokens(texts)
                slots = slot.view(np.int64)
                for size, all_ok in sizes:
                    h = item_windows(template, slot, size, not all_ok)[0].view(np.int64)
                    at = np.arange(len(h))
                    if shared.value is not None:
                        bit = h & (FILTER_BITS - 1)
                        at = np.flatnonzero((shared.value[bit >> 5] >> (bit & 31)) & 1)
                    doc = np.searchsorted(hi, at, side="right")
                    inside = at + size <= hi[doc] if len(at) else np.zeros(0, dtype=bool)
                    at, doc = at[inside], doc[inside]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(at) + 1, size), pa.int32()), pa.array(slots[at[:, None] + np.arange(size)].ravel(), pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(own[doc]), pa.array(at - np.concatenate([[0], hi])[doc], pa.int64()), pa.array(h[at]), lists], names=["th", "p", "h", "text_slots"])

    texts = docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "th long, p long, h long, text_slots array<long>").distinct()


def _fits(pairs: list[tuple[int, int]], there: dict, back: dict) -> bool:
    return all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs)


def _diagonals(text: list[dict], item: list[dict]) -> list[tuple[list[dict], list[dict]]]:
    """Matched windows (of the item, of the text) by diagonal, most first, then by place; of diagonals
    that look alike in every window and value (as in periodic texts) the first alone.

    text and item: windows with their places (p, pos), hashes and slot values. Nothing here grows with
    the product of their lengths but for diagonals that differ: alike ones are told by a rolling hash.
    """
    text, item = sorted({x["p"]: x for x in text}.values(), key=lambda x: x["p"]), sorted(item, key=lambda x: x["pos"])
    ids = {x["h"]: i for i, x in enumerate(item, 1)}
    pos, own = np.array([x["pos"] for x in item]), np.array([ids[x["h"]] for x in item])
    span = int(pos[-1]) + 1
    p = np.array([x["p"] for x in text])
    place = np.cumsum(np.append(0, np.minimum(np.diff(p), span + 1))) + span - 1  # wide gaps hold no diagonal
    at, seen = np.full(int(place[-1]) + span, -1), np.zeros(int(place[-1]) + span, dtype=np.int64)
    at[place], seen[place] = np.arange(len(text)), [ids[x["h"]] for x in text]
    looks: dict[tuple, int] = {}
    look = np.array([looks.setdefault((x["h"], *x["text_slots"]), len(looks)) for x in text], dtype=U64)
    with np.errstate(over="ignore"):
        base, back = _ODD_POWERS
        power, inverse = (np.cumprod(np.append(U64(1), np.full(len(at), x, dtype=U64)), dtype=U64) for x in (base, back))
        value = np.zeros(len(at), dtype=U64)
        value[place] = mix64(look) | U64(1)
        total = np.append(U64(0), np.cumsum(value * power[:-1], dtype=U64))
        rolled = (total[span:] - total[:-span]) * inverse[: len(at) - span + 1]
    _, first = np.unique(rolled, return_index=True)
    out = []
    for k in range(0, len(first), rows := max(1, (1 << 20) // len(item))):
        d = first[k : k + rows]
        match = seen[d[:, None] + pos[None, :]] == own[None, :]
        for i in np.flatnonzero(match.any(axis=1)).tolist():
            which = np.flatnonzero(match[i])
            out.append((len(which), int(d[i]), which, at[d[i] + pos[which]]))
    return [([item[i] for i in which], [text[j] for j in there]) for _, _, which, there in sorted(out, key=lambda x: (-x[0], x[1]))]


def judge(text: list[dict], item: list[dict], n_ok: int, n_all: int) -> tuple[int, int, bool] | None:
    """(windows matched, windows that count, all slot values equal) if the item leaks by these windows
    of the text (p, h, text_slots) and of the item (pos, h, ok, item_slots)."""
    verbatim, groups = set(), []
    for own, there in _diagonals(text, item):
        verbatim.update(x["pos"] for x in own if not x["ok"])
        pairs = sorted({(a, b) for x, y in zip(own, there, strict=True) if x["ok"] for a, b in zip(x["item_slots"], y["text_slots"], strict=True) if a})
        places = {x["pos"] for x in own if x["ok"]}
        if places and _fits(pairs, dict(pairs), {b: a for a, b in pairs}):
            groups.append((pairs, places))
    sets: list[tuple[dict, dict, set]] = []
    for pairs, places in groups:
        whole = len(places) >= MIN_COVERAGE * n_ok  # enough by itself: need not look for company
        for there, back, covered in [] if whole else sets:
            if _fits(pairs, there, back):
                there.update(pairs)
                back.update({b: a for a, b in pairs})
                covered |= places
                break
        else:
            sets.append((dict(pairs), {b: a for a, b in pairs}, set(places)))
    there, _, covered = max(sets, key=lambda s: len(s[2]), default=({}, {}, set()))
    same = all(a == b for a, b in there.items())
    if covered and len(covered) >= MIN_COVERAGE * n_ok:
        return len(covered), n_ok, same
    if len(covered) + len(verbatim) >= MIN_COVERAGE * n_all:
        return len(covered) + len(verbatim), n_all, same
    return None


def text_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """th (hash of a text), item_id, n_matched, n_windows, same_slots for each text and item that leaks into it.

    A text and an item meet with one row for each of their windows, never for a pair of windows."""
    found = settle(benchmark_windows(bench))
    common = found.select("h", *_ITEM).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    need = F.greatest(F.lit(1), F.ceil(MIN_COVERAGE * F.when(F.col("n_ok") > 0, F.col("n_ok")).otherwise(F.col("n_all"))))
    rarest = Window.partitionBy(*_ITEM).orderBy("items", "h", "pos")  # an item's windows: as many as it has words
    probes = found.join(common, "h").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= F.col("n_all") - need + 1).select("h", *_ITEM).distinct()
    seen = settle(_text_windows(docs, found))
    pairs = seen.join(probes, "h").select("th", *_ITEM).distinct()
    same_item = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in _ITEM]
    held = found.select("h", *_ITEM).distinct()
    hits = seen.join(pairs, "th").alias("s").join(held.alias("f"), [F.col("s.h") == F.col("f.h"), *same_item("f", "s")])
    of_text = hits.groupBy("th", "s.item_id", "s.item_hash").agg(F.collect_list(F.struct("p", "s.h", "text_slots")).alias("text"))
    of_item = found.groupBy(*_ITEM).agg(F.collect_list(F.struct("pos", "h", "ok", "item_slots")).alias("own"), F.max("n_ok").alias("n_ok"), F.max("n_all").alias("n_all"))
    met = of_text.alias("t").join(of_item.alias("i"), same_item("t", "i")).select("th", "t.item_id", "text", "own", "n_ok", "n_all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("th", "item_id", "text", "own", "n_ok", "n_all")]
            rows = [(t, i, *x) for t, i, *both, k, n in zip(*cols, strict=True) if (x := judge(*both, k, n))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["th", "item_id", "n_matched", "n_windows", "same_slots"])

    out = settle(met.mapInArrow(run, "th long, item_id long, n_matched long, n_windows long, same_slots boolean"))
    release(found, seen)
    return out


def find_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """A row for each document row and item that leaks into it: doc_id, item_id, n_matched, n_windows, same_slots."""
    docs = ensure(docs, doc_id="long", text="string")
    return docs.select("doc_id", F.xxhash64("text").alias("th")).join(text_leaks(docs, bench), "th").drop("th")


def drop_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents into which no item leaks, with their own columns."""
    return without_texts(docs, text_leaks(docs, bench).select("th").distinct())
