"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word shingles. In a sketch every member flips one
bit, so the Hamming distance of two sketches never exceeds the sets' symmetric difference; at the
asked similarity that is at most (a + b) / 7 for sets of a and b members (for 0.75). A size band's
sketch is cut into more parts than that: some part that is not blank is then the same in both,
unless all common members fall into parts that others spoil. In small sets that happens, so there
each member is a part of its own, and linked sets always share one; in larger ones (the larger set
has 32 members or more) its chance is below 1e-11 a pair. So
documents meet by equal parts (the pigeonhole join), candidates are sifted by size and by the
Hamming distance of a short sketch, and what is left is verified on the whole sets.

A part that very many documents share (a common passage) would bring all of them together. Parts
in groups of up to SMALL documents are enough for every document that has more of them than errors
are allowed. For the others ("thin" documents, mostly made of shared parts) only their rarest
shared parts are needed, and there each compares with the group's leader: as the Jaccard distance
is a metric, what is not even half similar to the leader links with none of the leader's partners;
a leader's half-similar family, and what is far from every leader, is compared in blocks by matrix
products. Candidate pairs that hang together are verified together, so a text travels once to where
its pairs are; a unit of more than UNIT_BYTES is split by its first documents, those with most
partners first. No cap is set, and no link between different sets is lost but by that chance;
equal sets are one node and never expand into pairs.

Null and empty texts have no set and link with nothing; repeated rows are copies and share a
class; ids may be null or repeat (a class without any id has none). Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, bitmap_of, fresh, likely, mix64, partitions, release, settle

SHINGLE, NUMER, DENOM = 5, 75, 100
#: Groups of so many documents compare all with all; larger ones go by leaders.
SMALL = 8
#: Up to this band (sets of up to 31 members) each member is a part.
MEMBER_BAND = 4
#: Documents and bytes of text on a side of the blocks in which families are compared, at most.
BLOCK, BLOCK_BYTES = 2000, 8 << 20
#: Bytes of text whose pairs are verified as one unit, and rounds by which larger ones are thinned out.
UNIT_BYTES, ROUNDS = 16 << 20, 2
#: Members of a group that meet its leader in one task.
SALTED = 5000
CHUNK_BYTES = 1 << 20
#: Part keys that a task packs at once.
PACK = 1_500_000
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = mix64(np.arange(256, dtype=U64) + U64(1 << 40))
_PLACE = mix64(np.arange(1 << 16, dtype=U64) + U64(1 << 41)) | U64(1)
_STEP = mix64(np.arange(64, dtype=U64) + U64(1 << 42)) | U64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and where each text's words begin and end."""
    a = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    full = ~_SPACES[a]
    change = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]]).view(np.int8)))
    firsts, ends = change[::2], change[1::2]
    sizes = ends - firsts
    with np.errstate(over="ignore"):
        at = np.flatnonzero(full)
        k = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        value = _BYTE[_FOLD[a[at]]] * (_PLACE[k & 0xFFFF] + (k >> 16).astype(U64) * U64(2))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(value, dtype=U64)])
        top = np.cumsum(sizes)
        h = mix64(total[top] - total[top - sizes] + sizes.astype(U64))
    return h, np.searchsorted(firsts, edges[:-1]), np.searchsorted(firsts, edges[1:])


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer words are one shingle, no words none."""
    w, lo, hi = word_hashes(texts)
    with np.errstate(over="ignore"):
        n = max(0, len(w) - width + 1)
        s = np.zeros(n, U64)
        for k in range(width):
            s += w[k : k + n] * _STEP[k]
        s = mix64(s)
        out = []
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(s[a : b - width + 1]))
            elif b > a:
                out.append(mix64(np.array([(w[a:b] * _STEP[: b - a]).sum(dtype=U64) + U64(b - a)])))
            else:
                out.append(np.zeros(0, U64))
    return out


def node_id(h: np.ndarray) -> int:
    """A set's id: 63 hashed bits, the lowest bit free."""
    with np.errstate(over="ignore"):
        x = mix64(np.array([np.bitwise_xor.reduce(mix64(h)) + U64(len(h)) * _STEP[0] + h.sum(dtype=U64)], dtype=U64))[0]
    return int(x.astype(np.int64)) & ~1


def most_errors(a: int, b: int, numer: int = NUMER, denom: int = DENOM) -> int:
    """The largest symmetric difference of linked sets of a and b members."""
    # I >= t (a + b) / (1 + t) with t = numer / denom; the difference is a + b - 2 I.
    least = -(-numer * (a + b) // (numer + denom))
    return a + b - 2 * least


def errors_within(n: int, largest: int) -> int:
    """The most errors of a set of n members and partners of up to so many: a sum less by one may
    allow one error more, one less by two never does."""
    return max(most_errors(n, largest), most_errors(n, largest - 1))


def band_of(n: int) -> int:
    """Band j holds sizes from 2^j up to, not including, 2^(j+1)."""
    return n.bit_length() - 1


def parts_in(band: int) -> int:
    """Parts of a band's sketch: well over the errors its largest sets may have."""
    top = (2 << band) - 1
    return (5 * (most_errors(top, top) + 1)) // 4 + 6


def bands(n: int) -> list[tuple[int, int]]:
    """(band, most errors) in which a set of n members takes part: its own, and the next one if it
    is the smaller partner of sets there."""
    own, widest = band_of(n), DENOM * n // NUMER
    out = [(own, errors_within(n, min(widest, (2 << own) - 1)))]
    if band_of(widest) > own:
        out.append((own + 1, errors_within(n, widest)))
    return out


def part_keys(h: np.ndarray, band: int) -> np.ndarray:
    """The keys of a set's parts that are not blank: the part's number with the parity of its bits;
    in small bands, of its members.

    A member's bit is its hash; a part's word, most of whose bits are nought, is known by the XOR
    of a hash of each of its set bits, in which a bit that flips twice cancels out.
    """
    if band <= MEMBER_BAND:
        return mix64(h ^ mix64(np.array([band << 32], dtype=U64)))
    m = parts_in(band)
    part = ((h >> U64(32)) * U64(m)) >> U64(32)
    new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    word = np.bitwise_xor.reduceat(mix64(h), new)
    return mix64(word ^ mix64(part[new] + U64(band << 32)))


def sketch(h: np.ndarray) -> bytes:
    """A short parity sketch: 64 bits or, for larger sets, two to four for each member. With fewer, bits
    of unlike sets differ half the time whatever the sets, and the bound sifts nothing out."""
    bits = min(1 << 17, max(64, 2 << max(0, len(h) - 1).bit_length()))
    return np.packbits((np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """The distance of two sketches; the longer one folds, which keeps every parity."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        half = len(a) // 2
        a = (int.from_bytes(a[:half]) ^ int.from_bytes(a[half:])).to_bytes(half)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def linked(common: int, a: int, b: int) -> bool:
    return DENOM * common >= NUMER * (a + b - common)


def _chunked(texts: list) -> Iterator[list[np.ndarray]]:
    part, size = [], 0
    for t in texts:
        part.append((t or "").encode())
        size += len(part[-1])
        if size >= CHUNK_BYTES:
            yield from shingle_sets(part)
            part, size = [], 0
    if part:
        yield from shingle_sets(part)


def nodes_of(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), bytes, n, node and short sketch of each document row."""
    named = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.octet_length("text").alias("bytes"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, short = [], [], []
            for h in _chunked(b.column(3).to_pylist()):
                n.append(len(h))
                node.append(node_id(h) if len(h) else None)
                short.append(sketch(h) if len(h) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(short, pa.binary())], names=["doc_id", "th", "bytes", "n", "node", "sketch"])

    return named.mapInArrow(run, "doc_id long, th long, bytes int, n long, node long, sketch binary")


def _shares(narrow: DataFrame, least: int) -> dict[int, tuple[int, int]]:
    """Of each size band (a few dozen at most): its first bucket and how many it gets, in proportion
    to its parts; so a set only goes to the buckets of its own bands."""
    own, wide = F.length(F.bin("n")) - 1, F.length(F.bin(F.expr(f"{DENOM} * n div {NUMER}"))) - 1
    both = F.explode(F.when(wide > own, F.array(own, own + 1)).otherwise(F.array(own)))
    load = {r[0]: r[1] for r in narrow.where("n > 0").select(both.alias("band"), "n").groupBy("band").agg(F.sum("n")).collect()}
    unit = max(1, min(2_000_000, sum(load.values()) // least))
    out, first = {}, 0
    for band in sorted(load):
        out[band] = (first, -(-load[band] // unit))
        first += out[band][1]
    return out


def _emit(docs: DataFrame, shares: dict[int, tuple[int, int]]) -> DataFrame:
    """bucket, keys, nodes, counts, parts: the part keys of all sets by bucket, packed; a task sends a
    set once. nodes, counts: whose the keys are, in order; parts: how many keys each node has in all.

    A bucket is known by a key's top bits, so four bytes of the rest are kept of each: a chance
    match of the rest is sifted out like any other candidate.
    """

    def packed(k: np.ndarray, to: np.ndarray, w: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        parts = np.bincount(w, minlength=len(nodes)).astype(np.int32)
        order = np.argsort(to, kind="stable")  # the keys of a node stay together
        k, w, to = k[order].astype(np.uint32), w[order], to[order]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        ends = np.append(cut[1:], len(to))
        own = [np.unique(w[x:y], return_counts=True) for x, y in zip(cut, ends, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(to[cut].astype(np.int32)),
                pa.array([k[x:y].tobytes() for x, y in zip(cut, ends, strict=True)], pa.binary()),
                pa.array([nodes[u].tobytes() for u, _ in own], pa.binary()),
                pa.array([c.astype(np.int32).tobytes() for _, c in own], pa.binary()),
                pa.array([parts[u].tobytes() for u, _ in own], pa.binary()),
            ],
            names=["bucket", "keys", "nodes", "counts", "parts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        held: tuple[list, list, list, list] = ([], [], [], [])
        load = 0
        for b in batches:
            for h in _chunked(b.column(0).to_pylist()):
                if not len(h) or (node := node_id(h)) in sent:
                    continue
                sent.add(node)
                for up, (band, _) in enumerate(bands(len(h))):
                    k = part_keys(h, band)
                    first, n = shares[band]
                    held[0].append(k)
                    held[1].append(first + ((k >> U64(40)) * U64(n) >> U64(24)).astype(np.int64))
                    held[2].append(np.full(len(k), len(held[3])))
                    held[3].append(node | up)
                    load += len(k)
                if load >= PACK:
                    yield packed(*(np.concatenate(x) for x in held[:3]), np.array(held[3], dtype=np.int64))
                    held, load = ([], [], [], []), 0
            if len(sent) > 1_000_000:
                sent.clear()
        if load:
            yield packed(*(np.concatenate(x) for x in held[:3]), np.array(held[3], dtype=np.int64))

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, keys binary, nodes binary, counts binary, parts binary")


def _meet(table: pa.Table, small: int) -> pa.Table:
    """Of one bucket: all pairs of groups up to small (key null), and the members of large ones."""
    joined = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    count = joined("counts", np.int32)
    w, e = np.repeat(joined("nodes", np.int64), count), np.repeat(joined("parts", np.int32), count)
    k = joined("keys", np.uint32).astype(U64) | U64(table.column("bucket")[0].as_py()) << U64(32)
    order = np.argsort(k)
    k, w, e = k[order], w[order], e[order]
    twin = np.zeros(len(k), dtype=bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= twin[1:]
    k, w, e = k[twin], w[twin], e[twin]  # a key that occurs once joins nothing
    order = np.lexsort((w, k))
    k, w, e = k[order], w[order], e[order]
    if len(k):
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])  # several tasks may have sent a set
        k, w, e = k[new], w[new], e[new]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(k)))
    left, right = [], []
    for g in range(2, small + 1):
        at = start[size == g]
        for i in range(g):
            for j in range(i + 1, g):
                left.append(w[at + i] & ~1)
                right.append(w[at + j] & ~1)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    a, b = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([a, b], axis=1)[a != b], axis=0) if len(a) else np.zeros((0, 2), np.int64)
    big = np.repeat(size > small, size)
    none = pa.nulls(len(pairs), pa.int64())
    return pa.table({
        "a": pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(w[big] & ~1)]),
        "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.array(w[big] & 1)]),
        "key": pa.concat_arrays([none, pa.array(k[big].view(np.int64))]),
        "size": pa.concat_arrays([none, pa.array(np.repeat(size, size)[big].astype(np.int64))]),
        "parts": pa.concat_arrays([none, pa.array(e[big].astype(np.int64))]),
    })


def _sift(pairs: DataFrame, nodes: DataFrame, share: int = NUMER) -> DataFrame:
    """Of the candidate pairs those that size and sketches allow to be similar by `share` hundredths."""
    info = nodes.select("node", "n", "sketch").hint("merge")  # grows with the documents: never broadcast
    one = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(one, "a").join(two, "b").where(DENOM * F.least("na", "nb") >= share * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            keep = [hamming(x, y) <= most_errors(m, n, share) for m, n, x, y in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(4), b.column(5)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near.select("na", "nb", "sa", "sb", "a", "b").mapInArrow(run, "a long, b long")


def _with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members (th and more columns) with the text of each th; a task sends a text once.

    A bitmap of fixed size keeps most other texts out of the shuffle; the join is exact without it.
    """
    texts = docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return likely(texts, bitmap_of(members.select("th").distinct(), "th"), "th", once=True).dropDuplicates(["th"]).join(members, "th")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


class _Trees:
    """A growing forest over nodes."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the edge joined two trees."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _verify(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """a, b, star, grade (2: linked, 1: half similar): of the stars all of those, of the other
    pairs enough links to connect what is linked."""
    own = dict(zip(texts.column("node").to_pylist(), texts.column("text").to_pylist(), strict=True))
    sets = dict(zip(own, _chunked(list(own.values())), strict=True))
    trees, out = _Trees(), []
    rows = zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), pairs.column("star").to_pylist(), strict=True)
    for a, b, star in sorted(rows, key=lambda r: not r[2]):  # stars first: they join the most
        if star or trees.root(a) != trees.root(b):
            x, y = sets[a], sets[b]
            both = _common(x, y)
            grade = 2 if linked(both, len(x), len(y)) else 1 if DENOM * both >= 50 * (len(x) + len(y) - both) else 0
            if (grade == 2 and (trees.join(a, b) or star)) or (star and grade):
                out.append((a, b, star, grade))
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int32()), strict=True)], names=["a", "b", "star", "grade"])


def _verified(docs: DataFrame, units: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, star, grade: what _verify finds among candidate pairs (a, b, star, unit), unit by unit."""
    units = settle(units)
    both = F.explode(F.array("a", "b")).alias("node")
    load = units.select("unit", both).distinct().join(nodes.select("node", "bytes"), "node").agg(F.sum("bytes")).first()[0] or 0
    buckets = max(2 * partitions(docs.sparkSession), load // (UNIT_BYTES // 4))
    dealt = units.withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(buckets)).cast("int")).drop("unit")
    members = settle(dealt.select("bucket", both).distinct().join(nodes.select("node", "th"), "node"))
    texts = _with_texts(docs, members).select("bucket", "node", "text")
    found = settle(dealt.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(_verify, "a long, b long, star boolean, grade int"))
    release(units, members)
    return found


def _split_units(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs with a unit: those of one first document, UNIT_BYTES of its partners at a time."""
    fan = pairs.join(nodes.select(F.col("node").alias("b"), "bytes"), "b").groupBy("a").agg(F.ceil(F.sum("bytes") / UNIT_BYTES).cast("int").alias("fan"))
    return pairs.join(fan, "a").select("a", "b", "star", F.xxhash64("a", F.pmod(F.xxhash64("b"), "fan")).alias("unit"))


def _measured(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, star, grade: what the candidate pairs (a, b, star) hold.

    All pairs that hang together are a unit. Where that is more than UNIT_BYTES of text, each
    document first meets the partner that has most pairs, so its text travels once; pairs which
    that has connected need no more (a star counts as half similar), and after ROUNDS of this what
    is left goes out first document by first document.
    """
    reached = components(pairs)
    label = settle(reached.join(nodes.select("node", "bytes"), "node"))
    release(reached)
    wide = settle(label.groupBy("label").agg(F.sum("bytes").alias("load")).where(F.col("load") > UNIT_BYTES).select("label"))
    at = pairs.join(label.select(F.col("node").alias("a"), "label"), "a")
    found = _verified(docs, at.join(wide, "label", "left_anti").select("a", "b", "star", F.col("label").alias("unit")), nodes)
    if wide.isEmpty():
        release(label, wide)
        return found
    parts = [found]
    rest = settle(at.join(wide, "label", "left_semi").select("a", "b", "star"))
    release(label, wide)
    for _ in range(ROUNDS):
        degree = rest.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
        best = rest.join(degree, "a").groupBy("b").agg(F.max(F.struct("star", "d", "a"))["a"].alias("a"))
        chosen = settle(rest.join(best, ["a", "b"], "left_semi"))
        parts.append(_verified(docs, _split_units(chosen, nodes), nodes))
        linked_now = components(_all_of(parts).where("grade = 2").select("a", "b"))
        others = settle(_apart(rest.join(best, ["a", "b"], "left_anti"), linked_now))
        release(rest, chosen, linked_now)
        parts.append(settle(others.where("star and not apart").select("a", "b", "star", F.lit(1).alias("grade"))))
        rest = settle(others.where("apart").select("a", "b", "star"))
        release(others)
        if rest.isEmpty():
            break
    else:
        parts.append(_verified(docs, _split_units(rest, nodes), nodes))
    found = settle(_all_of(parts))
    release(rest, *parts)
    return found


def _all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """pairs with whether the links so far leave the two in different components."""
    x, y = label.select(F.col("node").alias("a"), F.col("label").alias("_x")), label.select(F.col("node").alias("b"), F.col("label").alias("_y"))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return both.select("a", "b", "star", (F.coalesce("_x", "a") != F.coalesce("_y", "b")).alias("apart"))


def _thin_members(large: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node, size, score: for each thin document the rarest of its widely shared parts that it
    needs; size: of the part's group; score: how many documents share its parts, the most for what copies were made from.

    With e parts, of which s widely shared, and at most d errors, partners that don't meet in a
    small group share at least e - d of the s; so they meet in one of the s - (e - d) + 1 rarest.
    """
    widest = F.expr(f"{DENOM} * n div {NUMER}")
    other = F.when(F.col("up") == 0, F.least(widest, F.expr("shiftleft(1L, length(bin(n))) - 1"))).otherwise(widest)
    both = F.col("n") + other
    errors = lambda x: x - 2 * F.ceil(NUMER * x / (NUMER + DENOM))
    shared = large.select(F.col("a").alias("node"), F.col("b").alias("up"), "key", "size", "parts")
    counted = shared.groupBy("node", "up").agg(F.count(F.lit(1)).alias("s"), F.max("parts").alias("e"), F.sum("size").alias("score"))
    need = (
        counted.join(nodes.select("node", "n"), "node")
        .withColumn("d", F.greatest(errors(both), errors(both - 1)))  # as bands() has it
        .where(F.col("e") - F.col("s") <= F.col("d"))  # else enough parts are in small groups
        .withColumn("take", F.col("s") - F.greatest(F.col("e") - F.col("d"), F.lit(1)) + 1)
        .where(F.col("take") > 0)
        .select("node", "up", "take", "score")
    )
    rarest = Window.partitionBy("node", "up").orderBy("size", "key")
    return shared.join(need, ["node", "up"]).withColumn("_r", F.row_number().over(rarest)).where(F.col("_r") <= F.col("take")).groupBy("key", "node").agg(F.max("size").alias("size"), F.max("score").alias("score"))


def _families(led: DataFrame, measured: DataFrame) -> DataFrame:
    """key (a leader), node, led: what may still hold links that no star has shown.

    A family are those that are half similar to a leader; two of them are to be compared unless both
    link with the leader. What is less than half similar to it can't link with the leader's
    partners; so it remains, with those that don't link with the leader themselves: what remains is
    one family for each leader it would have, and parts with the same leader meet once.
    """
    graded = measured.where("star").groupBy(F.col("a").alias("leader"), F.col("b").alias("node")).agg(F.max("grade").alias("grade"))
    family = graded.select(F.col("leader").alias("key"), "node", (F.col("grade") == 2).alias("led"))
    rest = led.where(F.col("node") != F.col("leader")).join(graded, ["leader", "node"], "left").withColumn("grade", F.coalesce("grade", F.lit(0))).where("grade < 2")
    far = rest.groupBy("key").agg(F.min("grade").alias("least")).where("least = 0")
    again = _with_leaders(rest.join(far, "key", "left_semi").select("key", "node", "size", "score"))
    remains = again.select(F.col("leader").alias("key"), "node", F.lit(False).alias("led"))
    return family.union(remains).groupBy("key", "node").agg(F.min("led").alias("led"))


def _divided(families: DataFrame, label: DataFrame) -> DataFrame:
    """The families whose members aren't all in one component yet."""
    at = families.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = at.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi")
    return at.join(split.select("key"), "key", "left_semi").select("key", "node", "led")


def _with_leaders(members: DataFrame) -> DataFrame:
    """key, node, size, score, leader (that of most score); groups of one member fall away. Members
    of a large group meet their leader in several tasks."""
    salts = F.ceil(F.col("size") / SALTED).cast("int")
    groups = members.groupBy("key").agg(F.max(F.struct("score", "node"))["node"].alias("leader"), F.max("size").alias("size"), F.count(F.lit(1)).alias("g")).where("g > 1")
    spread = groups.select("key", "leader", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return members.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).join(spread, ["key", "salt"]).drop("salt")


def _block_links(rows: pa.Table) -> pa.Table:
    """Links between two blocks of a family (a forest of them), by a product of membership matrices."""
    own = {n: i for i, n in enumerate(rows.column("node").to_pylist())}
    rows = rows.take(list(own.values()))
    sets = list(_chunked(rows.column("text").to_pylist()))
    size = np.array([len(s) for s in sets])
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    side, led = rows.column("side").to_numpy(), rows.column("led").to_numpy()
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side != 0)
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(value), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, len(shared), 4096):  # 4096 members at a time, all of them in the end
        first, last = np.searchsorted(column, [at, at + 4096])
        x = np.zeros((len(sets), min(4096, len(shared) - at)), dtype=np.float32)
        x[row[first:last], column[first:last] - at] = 1
        common += x[left] @ x[right].T
    link = (DENOM * common >= NUMER * (size[left][:, None] + size[right][None, :] - common)) & ~(led[left][:, None] & led[right][None, :])
    node = rows.column("node").to_numpy()
    i, j = np.nonzero(link)
    trees = _Trees()
    out = [(a, b) for a, b in zip(node[left[i]].tolist(), node[right[j]].tolist(), strict=True) if trees.join(a, b)]
    cols = list(zip(*out, strict=True)) or [[], []]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _in_blocks(members: DataFrame) -> DataFrame:
    """members (key, node, led, bytes) dealt out so that each pair of blocks of a family has a task:
    x, y and side (-1: both, where x = y; 0: of x; 1: of y). Blocks of those that link with the leader
    only meet the others' blocks, so a family costs its size times that of its doubtful part."""
    own = lambda led, value: F.when(F.col("led") == led, value)
    blocks = lambda led: F.greatest(F.ceil(F.count(own(led, F.lit(1))) / BLOCK), F.ceil(F.coalesce(F.sum(own(led, F.col("bytes"))), F.lit(0)) / BLOCK_BYTES)).cast("int")
    size = members.groupBy("key").agg(blocks(F.lit(False)).alias("_kb"), blocks(F.lit(True)).alias("_kl"))
    spread = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")
    of = F.when(F.col("led"), F.col("_kb") + spread(F.greatest("_kl", F.lit(1)))).otherwise(spread(F.greatest("_kb", F.lit(1))))
    last = F.when(F.col("led"), F.col("_kb") - 1).otherwise(F.col("_kb") + F.col("_kl") - 1)
    dealt = members.join(size.where("_kb > 0"), "key").withColumn("_x", of).withColumn("_y", F.explode(F.sequence(F.lit(0), last)))
    side = F.when(F.col("_x") == F.col("_y"), -1).when(F.col("_x") < F.col("_y"), 0).otherwise(1)
    return dealt.withColumns({"x": F.least("_x", "_y"), "y": F.greatest("_x", "_y"), "side": side}).drop("_kb", "_kl", "_x", "_y")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that links reach, by repeated minima and jumps."""
    edges = settle(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("new")))
    while True:
        old = label.select("node", F.col("new").alias("label"))
        seen = edges.join(old.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = old.join(seen, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = lower.alias("l").join(old.select(F.col("node").alias("at"), F.col("label").alias("far")), F.col("l.new") == F.col("at"), "left")
        stepped = settle(jump.select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        release(label)
        label = stepped
        if stepped.where(F.col("label") != F.col("new")).isEmpty():
            release(edges)
            out = stepped.select("node", F.col("new").alias("label"))
            out.settled_at = stepped.settled_at
            return out


def links_of(docs: DataFrame, narrow: DataFrame) -> DataFrame:
    """a, b: links between different sets, enough of them to connect all that are linked."""
    spark = docs.sparkSession
    nodes = settle(narrow.where("n > 0").groupBy("node").agg(*[F.min(F.struct("th", "bytes", "n", "sketch"))[c].alias(c) for c in ("th", "bytes", "n", "sketch")]))
    small = SMALL
    met = settle(_emit(docs, _shares(nodes, 2 * partitions(spark))).groupBy("bucket").applyInArrow(lambda t: _meet(t, small), "a long, b long, key long, size long, parts long"))
    pairs = settle(_sift(met.where("key is null").select("a", "b").distinct(), nodes))
    thin = settle(_thin_members(met.where("key is not null"), nodes))
    release(met)
    led = settle(_with_leaders(thin))
    stars = _sift(led.where(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), nodes, 50)
    candidates = settle(pairs.withColumn("star", F.lit(False)).union(stars.withColumn("star", F.lit(True))))
    measured = _measured(docs, candidates, nodes)
    release(pairs, thin, candidates)
    links = settle(measured.where("grade = 2").select("a", "b"))
    families = settle(_families(led, measured))
    label = components(links)
    divided = settle(_divided(families, label).join(nodes.select("node", "th", "bytes"), "node"))
    release(measured, led, families, label, nodes)
    dealt = settle(_in_blocks(divided))
    found = settle(_with_texts(docs, dealt).groupBy("key", "x", "y").applyInArrow(_block_links, "a long, b long"))
    both = settle(links.union(found))
    release(divided, dealt, links, found)
    return both


def classes(docs: DataFrame, narrow: DataFrame | None = None) -> DataFrame:
    """doc_id, th, n_shingles, component_id, label (the class's least node) of every document row."""
    narrow = settle(nodes_of(docs)) if narrow is None else narrow
    links = links_of(docs, narrow)
    label = components(links)
    narrow = narrow.select("doc_id", "th", "n", "node")
    least = narrow.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(label, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    heads = least.groupBy("label").agg(F.min("least").alias("component_id"))
    named = settle(least.join(heads, "label").select("node", "label", "component_id"))
    release(links, label)
    return narrow.join(named, "node", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "label")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class: that of the least (doc_id, text hash); those without words stay.

    Only texts of classes of several rows are shuffled to find their heads; others pass.
    """
    th = fresh("th", *docs.columns)
    found = settle(classes(docs).where("n_shingles > 0"))
    heads = settle(found.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("_h"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("label", "_h.doc_id", "_h.th"))
    several = settle(found.select("label", "th").join(heads.select("label"), "label", "left_semi").select(F.col("th").alias(th)).distinct())
    release(found)
    bitmap, marked = bitmap_of(several.withColumnRenamed(th, "th"), "th"), docs.withColumn(th, F.xxhash64("text"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    out_of_class = likely(marked, bitmap, th, keep=False).select(*own)
    maybe = likely(marked, bitmap, th)
    alone = maybe.join(several, th, "left_anti").select(*own)
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col(f"d.{th}") == F.col("h.th"))
    kept = maybe.alias("d").join(heads.alias("h"), same, "left_semi").dropDuplicates(["doc_id", th]).select(*own)
    return out_of_class.unionByName(alone).unionByName(kept)
