"""Repeated passages by a run-length index.

A window is LENGTH bytes of one text; it is repeated if the same bytes start anywhere else, and all
bytes that repeated windows cover are marked. Windows whose least k-gram hash is the same share a
run of text, a stretch; only stretches whose k-gram occurs elsewhere can hold repeated windows, and
equal windows lie in stretches of the same k-gram. So each bucket of k-grams is indexed by itself:
suffixes of its distinct stretches are sorted, the Burrows-Wheeler transform is kept as runs, and
matches are sampled at the ends of its runs only (RunIndex). Inside a run a match grows by one byte
with each step to the left; so one pass along the samples streams the matching statistics, and what
reaches LENGTH marks its bytes.

Stretches with the same bytes are counted before any index is built: all are marked, and one of
them goes on. A k-gram of which more than HOT_BYTES of different stretches are left isn't brought
together: its stretches are cut again by a longer k-gram (GRAMS), in the end by the window itself.

Copies of a whole text of at least LENGTH bytes are marked whole; they are found by SHA-256 and
only one of them is indexed. Matches never cross texts. Null texts count as empty; shorter texts
keep all; repeated rows are copies; an empty table stays empty; of the input only doc_id and text
are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bitmap_of, likely, mix64, partitions, release, settle

LENGTH = 400
#: k-grams by which stretches are cut: the first for all, the next ones for what is too frequent.
GRAMS = (128, 384, 400)
#: Bytes of different stretches of one k-gram, and of k-grams together, that one index takes.
HOT_BYTES, INDEX_BYTES = 4 << 20, 1 << 20
#: Windows in one indexed stretch at most; longer stretches (periodic text) are cut, no window is lost.
STRETCH = 1024
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPREAD = U64(0xD6E8FEB86659FD93)
_BYTE = mix64(np.arange(256, dtype=U64) + U64(1 << 50))
_DIGITS = 7  # bytes in a first sort key: 9 bits each, so that an end differs from every byte
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers, kept for the next call."""
    if len(_POWERS.get(base, ())) < n:
        with np.errstate(over="ignore"):
            _POWERS[base] = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, CHUNK_BYTES * 3 // 2), U64(base))]), dtype=U64)
    return _POWERS[base][:n]


def gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k bytes from each place on."""
    n = len(a)
    if n < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[a] * _powers(n, _BASE), dtype=U64, out=total[1:])
        h = total[k:] - total[:-k]
        h *= _powers(n - k + 1, _INVERSE)
        h ^= h >> U64(29)
        h *= _SPREAD
        return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


def stretches(texts: list[bytes], length: int = LENGTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """k-gram hash, text number, first window, number of windows, and whether the k-gram occurs in
    the stretch more than once."""
    a = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(size)
    h = gram_hashes(a, gram)
    width = length - gram + 1
    low = _least(h, width) if len(a) >= length else np.zeros(0, U64)
    inside = np.ones(len(low), dtype=bool)
    for end in ends[:-1].tolist():  # windows that cross into the next text
        inside[max(0, end - length + 1) : end] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))
    value = low[at]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    value, begin, count = value[first], at[first], last - first + 1
    # A k-gram is there again if the first window has it twice or a later window ends with it.
    enters = h[at + width - 1] == low[at]
    enters[first] = False
    several = np.add.reduceat(enters, first) > 0
    for i in range(0, len(begin), 4096):
        several[i : i + 4096] |= (h[begin[i : i + 4096, None] + np.arange(width)] == value[i : i + 4096, None]).sum(axis=1) > 1
    doc = np.searchsorted(ends, begin, side="right")
    return value, doc, begin - (ends - size)[doc], count, several


def _text_chunks(nodes: list[int], texts: list) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, part, size = [], [], 0
    for i, t in zip(nodes, texts, strict=True):
        ids.append(i)
        part.append((t or "").encode())
        size += len(part[-1])
        if size >= CHUNK_BYTES:
            yield ids, part
            ids, part, size = [], [], 0
    if part:
        yield ids, part


def _batch(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], names=list(types))


def _anchors(texts: DataFrame) -> DataFrame:
    """gram, node, start, windows, several: the stretches of every text; a task sends a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            ids, body = b.column(0).to_pylist(), b.column(1).to_pylist()
            fresh = [i for i, node in enumerate(ids) if not (node in sent or sent.add(node))]
            if len(sent) > 1_000_000:
                sent.clear()
            for own, part in _text_chunks([ids[i] for i in fresh], [body[i] for i in fresh]):
                h, doc, start, count, several = stretches(part)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(own, dtype=np.int64)[doc]), pa.array(start), pa.array(count.astype(np.int32)), pa.array(several)], names=["gram", "node", "start", "windows", "several"])

    return texts.select("node", "text").mapInArrow(run, "gram long, node long, start long, windows int, several boolean")


def suffix_order(text: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes, each up to its own end, by doubling; only ties are sorted again.

    room: bytes from each place to its stretch's end; depth: the longest of them.
    """
    n = len(text)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([text, np.zeros(_DIGITS, np.uint8)])
    for k in range(_DIGITS):
        key <<= 9
        key |= np.where(room > k, padded[k : k + n].astype(np.int64) + 1, 0)
    order, length = np.argsort(key), _DIGITS
    key = key[order]
    rank = np.zeros(n, dtype=np.int64)  # where the place's group of ties begins in the order
    slots = np.arange(n)
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[slots]] = np.maximum.accumulate(np.where(first, slots, 0))
        alone = first & np.append(first[1:], True)
        slots = slots[~alone]
        if not len(slots) or length >= depth:
            return order
        own = order[slots]
        key = rank[own] << 32
        more = np.flatnonzero(room[own] > length)
        key[more] |= rank[own[more] + length] + 1
        again = np.argsort(key)
        order[slots], key, length = own[again], key[again], length * 2


def common_lengths(i: np.ndarray, j: np.ndarray, text: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the suffixes at i and j."""
    most = np.minimum(room[i], room[j])
    done = np.zeros(len(i), dtype=np.int64)
    padded = np.concatenate([text, np.zeros(256, np.uint8)])
    for low in range(0, len(i), 16_384):
        alive, step = np.arange(low, min(low + 16_384, len(i))), 16
        while len(alive):
            differ = padded[(i[alive] + done[alive])[:, None] + np.arange(step)] != padded[(j[alive] + done[alive])[:, None] + np.arange(step)]
            same = ~differ.any(axis=1)
            done[alive] += np.where(same, step, differ.argmax(axis=1))
            alive, step = alive[same & (done[alive] < most[alive])], 256
    return np.minimum(done, most)


class RunIndex:
    """The run-compressed transform of some parts: the byte and the length of each run, and, for the
    places sampled at the ends of runs, the place that follows or precedes them in the order.

    Nothing as long as the text is kept but the text itself; the order is dropped when the runs are known.
    """

    def __init__(self, parts: list[bytes]):
        self.text = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts], dtype=np.int64)
        n = len(self.text)
        self.edges = np.concatenate([[0], np.cumsum(size)])
        room = np.repeat(self.edges[1:], size) - np.arange(n)
        order = suffix_order(self.text, room, int(size.max()))
        # The byte before each suffix; the first places of parts have one each of their own.
        before = np.empty(n, dtype=np.int32)
        before[1:] = self.text[:-1]
        before[self.edges[:-1]] = 256 + np.arange(len(parts))
        transform = before[order]
        begins = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
        self.heads, self.lengths = transform[begins], np.diff(np.append(begins, n))
        tops, bottoms = begins[1:], begins[1:] - 1  # each inner border is a run's first and another one's last row
        self.at = np.concatenate([order[tops], order[bottoms]])
        self.beside = np.concatenate([order[bottoms], order[tops]])

    def _room(self, at: np.ndarray) -> np.ndarray:
        return self.edges[np.searchsorted(self.edges, at, side="right")] - at

    def samples(self, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The sampled places, in the order of the text, and their match lengths, where at least so long."""
        i, j = self.at, self.beside
        for k in {0, least - 1}:
            fits = np.flatnonzero(np.minimum(self._room(i), self._room(j)) >= least)
            i, j = i[fits], j[fits]
            same = self.text[i + k] == self.text[j + k]
            i, j = i[same], j[same]
        room = np.repeat(self.edges[1:], np.diff(self.edges)) - np.arange(len(self.text))
        length = common_lengths(i, j, self.text, room)
        keep = length >= least
        i, length = i[keep], length[keep]
        order = np.argsort(i, kind="stable")
        return i[order], length[order]

    def long_matches(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each run of places whose matching statistic is at least so much:
        a sample's match loses one byte with each step to the right."""
        at, length = self.samples(least)
        last = np.maximum.accumulate(at + length - least) if len(at) else at
        begins = np.flatnonzero(np.concatenate([[True], at[1:] > last[:-1] + 1])) if len(at) else at
        return at[begins], last[np.append(begins[1:], len(at)) - 1] if len(at) else at


def matching_statistics(parts: list[bytes]) -> np.ndarray:
    """For each byte of the parts, end to end: the longest match from there that also starts at
    another place of them (matches end with their part)."""
    index = RunIndex(parts)
    at, length = index.samples()
    n = len(index.text)
    best = np.zeros(n, dtype=np.int64)
    np.maximum.at(best, at, length)
    return np.minimum(np.maximum.accumulate(best + np.arange(n)) - np.arange(n), index._room(np.arange(n)))


def _index_bucket(table: pa.Table) -> pa.Table:
    """node, first, last of the repeated windows in one bucket of stretches, k-gram by k-gram or
    several small ones together."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("gram", "node", "start", "open", "body")), strict=True))
    out: list[tuple[int, int, int]] = []
    group: list[tuple] = []
    size = 0
    for k, row in enumerate(rows):
        group.append(row)
        size += len(row[-1])
        whole = k + 1 == len(rows) or rows[k + 1][0] != row[0]
        if whole and (size >= INDEX_BYTES or k + 1 == len(rows)):
            index = RunIndex([r[-1] for r in group])
            for first, last in zip(*(x.tolist() for x in index.long_matches(LENGTH)), strict=True):
                part = int(np.searchsorted(index.edges, first, side="right")) - 1  # matches end with their part
                _, node, start, is_open, _ = group[part]
                if is_open:
                    out.append((node, start + first - int(index.edges[part]), start + last - int(index.edges[part])))
            group, size = [], 0
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("node", "first", "last"), cols, strict=True)})


def _pieces(raw: bytes, own: list[dict], gram: int | None) -> Iterator[tuple[int, int, int, bool, bool]]:
    """k-gram, start, windows, several, open of a text's stretches: as they are but for long ones, or
    (gram) cut again by longer k-grams."""
    if gram is None:
        for x in own:
            for s in range(x["start"], x["start"] + x["windows"], STRETCH):
                yield x["gram"], s, min(STRETCH, x["start"] + x["windows"] - s), x["several"] or x["windows"] > STRETCH, True
    else:
        found = stretches([raw[x["start"] : x["start"] + x["windows"] + LENGTH - 1] for x in own], LENGTH, gram)
        for h, i, start, windows, several in zip(found[0].view(np.int64).tolist(), *(c.tolist() for c in found[1:]), strict=True):
            yield h, own[i]["start"] + start, windows, several, own[i]["open"]


def _places(held: DataFrame, own: DataFrame, gram: int | None) -> DataFrame:
    """gram, b1, b2 (128 bits of the body), node, start, windows, several, open: every stretch of own
    (node, own: array of its stretches), or (gram) what longer k-grams cut it into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for node, text, parts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode()
                for key, start, windows, several, is_open in _pieces(raw, parts, gram):
                    digest = hashlib.blake2b(raw[start : start + windows + LENGTH - 1], digest_size=16).digest()
                    rows.append((key, int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True), node, start, windows, several, is_open))
            yield _batch(rows, gram=pa.int64(), b1=pa.int64(), b2=pa.int64(), node=pa.int64(), start=pa.int64(), windows=pa.int32(), several=pa.bool_(), open=pa.bool_())

    return held.join(own, "node").select("node", "text", "own").mapInArrow(run, "gram long, b1 long, b2 long, node long, start long, windows int, several boolean, open boolean")


def _bodies(held: DataFrame, own: DataFrame) -> DataFrame:
    """bucket, gram, node, start, open, body of the stretches that go to an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for node, text, parts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode()
                rows += [(x["bucket"], x["gram"], node, x["start"], x["open"], raw[x["start"] : x["start"] + x["windows"] + LENGTH - 1]) for x in parts]
            yield _batch(rows, bucket=pa.int32(), gram=pa.int64(), node=pa.int64(), start=pa.int64(), open=pa.bool_(), body=pa.binary())

    return held.join(own, "node").select("node", "text", "own").mapInArrow(run, "bucket int, gram long, node long, start long, open boolean, body binary")


def _by_node(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("node").agg(F.collect_list(F.struct(*columns)).alias("own"))


def _union(spans: list) -> list[tuple[int, int]]:
    """Runs (start, end) of the bytes that repeated windows (first, last) cover."""
    out: list[list[int]] = []
    for x in sorted(spans, key=lambda x: x["first"]):
        if out and x["first"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["last"] + LENGTH)
        else:
            out.append([x["first"], x["last"] + LENGTH])
    return [(a, b) for a, b in out]


def _cut(marked: DataFrame) -> DataFrame:
    """node, spans (start and end of each removed run), kept (the bytes left) of marked texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept = [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode()
                own = _union(found)
                spans.append([{"start": s, "end": e} for s, e in own])
                kept.append(b"".join(raw[s:e] for s, e in zip([0] + [e for _, e in own], [s for s, _ in own] + [len(raw)], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["node", "spans", "kept"])

    return marked.select("node", "text", "found").mapInArrow(run, "node long, spans array<struct<start:long,end:long>>, kept binary")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """node (hash of a text), spans, kept for each different text with bytes to remove, copies of
    whole texts left aside."""
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64("text").alias("node"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= LENGTH)
    anchors = settle(_anchors(texts))
    place = F.struct("node", "start")
    grams = anchors.groupBy("gram").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("several").alias("several")).where((F.col("low") != F.col("high")) | F.col("several"))
    shared = settle(grams.select("gram"))  # a table of its own, so that the join can split a frequent k-gram
    own = settle(anchors.join(shared, "gram").groupBy("node").agg(F.collect_set(F.struct("gram", "start", "windows", "several")).alias("own")))
    release(anchors, shared)
    # Copies of a text share its node; a task sends one of them, and the filter spares most other texts the shuffle.
    held = settle(likely(texts, bitmap_of(own.select("node"), "node"), "node", once=True).dropDuplicates(["node"]).join(own.select("node"), "node"))
    marks, spent, gram = None, [], None
    for longer in (*GRAMS[1:], None):
        places = settle(_places(held, own, gram))
        bodies = settle(places.groupBy("gram", "b1", "b2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "start", "windows", "open")).alias("p"), F.max("several").alias("several")))
        again = bodies.where("n > 1").select("gram", "b1", "b2")
        direct = places.where("open").join(again, ["gram", "b1", "b2"], "left_semi").groupBy("node").agg(F.collect_list(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last"))).alias("found"))
        load = settle(bodies.groupBy("gram").agg(F.sum(F.col("p.windows") + LENGTH - 1).alias("bytes"), F.count(F.lit(1)).alias("m"), F.max("several").alias("several")).where("m > 1 or several"))
        one = bodies.select("gram", "p.node", "p.start", "p.windows", (F.col("p.open") & (F.col("n") == 1)).alias("open"))
        few = load if longer is None else load.where(F.col("bytes") <= HOT_BYTES)
        total = few.agg(F.sum("bytes")).first()[0] or 0
        buckets = max(4 * partitions(spark), total // INDEX_BYTES)
        bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket")
        dealt = one.join(few.select("gram"), "gram").select("node", bucket, "gram", "start", "windows", "open")
        indexed = _bodies(held, _by_node(dealt, "bucket", "gram", "start", "windows", "open")).groupBy("bucket").applyInArrow(_index_bucket, "node long, first long, last long")
        merged = indexed.groupBy("node").agg(F.collect_list(F.struct("first", "last")).alias("found"))
        new = settle(direct.union(merged))
        marks = new if marks is None else marks.union(new)
        spent += [places, bodies, load]
        hot = load.where(F.col("bytes") > HOT_BYTES)
        if longer is None or hot.isEmpty():
            break
        own, gram = settle(_by_node(one.join(hot.select("gram"), "gram"), "start", "windows", "open")), longer
    release(*spent)
    found = marks.groupBy("node").agg(F.flatten(F.collect_list("found")).alias("found"))
    return _cut(held.join(found, "node"))


def _recurring(narrow: DataFrame) -> DataFrame:
    """sha of the texts that more than one row of narrow has.

    It is settled: a join with counts made in its own stage would keep all rows of one text in one
    task, a join with a table lets Spark split them.
    """
    return settle(narrow.groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans ("start:end" of each removed run, comma
    between) and text (what is left; bytes of a cut character show as U+FFFD) of every document row.

    Only the rows of texts with something to remove are shuffled by text; others pass.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.select("doc_id", "text", F.xxhash64("text").alias("th"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    narrow = settle(own.where(F.octet_length("text") >= LENGTH).select("doc_id", "th", size, F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    cut = settle(repeated_passages(docs).withColumnRenamed("node", "th"))
    copies = _recurring(narrow)
    copied = settle(narrow.join(copies, "sha", "left_semi").select("doc_id", "th", "n_bytes"))
    partly = settle(narrow.join(copies, "sha", "left_anti").join(cut, "th").select("doc_id", "th", "n_bytes", "spans", "kept"))
    release(copies)
    join_spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    whole = copied.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.concat(F.lit("0:"), "n_bytes").alias("spans"), F.lit("").alias("text"))
    part = partly.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), join_spans.alias("spans"), _readable("kept").alias("text"))
    touched = settle(copied.select("th").union(partly.select("th")).distinct())
    bitmap = bitmap_of(touched, "th")
    rest = likely(own, bitmap, "th", keep=False).unionByName(likely(own, bitmap, "th").join(touched, "th", "left_anti").select("doc_id", "text", "th"))
    kept = rest.select("doc_id", size, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.lit("").alias("spans"), "text")
    return whole.unionByName(part).unionByName(kept)


def _readable(column: str):
    """UTF-8 bytes as text, U+FFFD for what a cut through a character left."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: b.decode("utf-8", "replace"))

    return decoded(column)
