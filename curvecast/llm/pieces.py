"""SentencePiece encoding by forward filtering and backward sampling, and its lossless decoding.

The vocabulary is a public piece file; its path is a parameter. A text gets a leading space, and
spaces are the pieces' space sign. No piece holds a space or line feed but at its start, so the text
falls into units (spaces and the letters that follow, each line feed alone); the pieces inside a
unit, however long, form a lattice. The vocabulary has ranks but no probabilities, so a piece of rank
r weighs 1 / (r + RANK_0) to the power `alpha` (Zipf's law); a code point without a piece of its own
becomes its UTF-8 bytes' pieces. Forward sums over the lattice are kept for each distinct unit; each
occurrence then draws its pieces from the end to the start with numbers that only the seed, the
row's key, the unit's place and the step decide, so a row always gets the same pieces. Of a unit of
more than LONG code points (a text without spaces) forward sums are kept at the starts of blocks
alone, and each block's are formed again when the drawing comes to it.

A null or empty text has no pieces; a null key counts as 0; equal rows get equal pieces; a literal
space sign in a text is kept by byte pieces; texts of any length are encoded whole. Further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of a unit that is encoded block by block, and of a block.
LONG, BLOCK = 4096, 1 << 15
RANK_0 = 10.0
#: Code points encoded at once; bounds the lattices in memory, not the text.
SEGMENT = 1 << 18
_SIGN, _SPACE, _LINE = 0x2581, 32, 10
_PER_CHAR = 6.0  # log weight that each code point adds, the same for every path: keeps sums in range
_RESCALE = 32  # places after which sums are scaled back
_STEP = U64(0x9E3779B97F4A7C15)
_PLACE = mix64(np.arange(LONG, dtype=U64) + U64(1 << 30)) | U64(1)
_MUL = U64(0xD6E8FEB86659FD93)
_SHIFT = U64(44)  # the top 20 bits of a prefix's hash choose its bucket


class Pieces:
    """A piece vocabulary with its prefixes in a bucketed hash table."""

    def __init__(self, path: str, alpha: float = 1.0):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        self.bytes = [b""] * n
        self.byte_id = np.full(256, -1, dtype=np.int32)
        prefixes: dict[str, int] = {}
        weights = np.zeros(n)
        self.longest = 1
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.bytes[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                self.bytes[i] = text.encode()
                self.longest = max(self.longest, len(text))
                weights[i] = np.exp(alpha * -np.log(max(0.0, -sp.get_score(i)) + RANK_0) + _PER_CHAR * len(text))
                for k in range(1, len(text)):
                    prefixes.setdefault(text[:k], -1)
                prefixes[text] = i
        self.weights = weights
        self.fallback = float(np.exp(alpha * -np.log(n + RANK_0) + _PER_CHAR))
        keys = np.array([self._hash(p) for p in prefixes], dtype=U64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.full(16, ~U64(0)))
        self.ids = np.append(np.array(list(prefixes.values()), dtype=np.int32)[order], np.full(16, -1, np.int32))
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two prefixes share a hash")
        per = np.bincount((keys >> _SHIFT).astype(np.int64), minlength=1 << 20)
        self.starts = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
        self.deepest = int(per.max())
        lengths = np.array([len(b) for b in self.bytes])
        self.blob, self.lengths, self.offsets = np.frombuffer(b"".join(self.bytes), np.uint8), lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])

    @staticmethod
    def _hash(text: str) -> int:
        h = np.zeros(1, U64)
        for c in text:
            h = Pieces.extend(h, np.array([ord(c)], dtype=np.uint32))
        return int(h[0])

    @staticmethod
    def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ (c.astype(U64) + U64(1))) * _MUL
            return h ^ (h >> U64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The table's row of each hash, or -1."""
        b = (h >> _SHIFT).astype(np.int64)
        at = self.starts[b]
        out = np.where(self.keys[at] == h, at, -1)
        for k in range(1, self.deepest):
            out = np.where(self.keys[at + k] == h, at + k, out)
        return out


@lru_cache(maxsize=2)
def pieces_at(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


def _unit_starts(c: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """True where a unit begins; docs: where texts begin."""
    new = np.zeros(len(c), dtype=bool)
    new[docs] = True
    space, line = c == _SPACE, c == _LINE
    new[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    return new


def _matches(p: Pieces, c: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length (1 first): the places where a piece of that length begins, and those pieces. left:
    how many code points each place's unit still has."""
    found = []
    act, h = np.arange(len(c)), np.zeros(len(c), U64)
    for k in range(p.longest):
        h = p.extend(h, c[act + k])
        row = p.find(h)
        ids = p.ids[row]
        hit = (row >= 0) & (ids >= 0)
        if k == 0:
            hit &= c != _SIGN
        found.append((act[hit], ids[hit]))
        on = (row >= 0) & (left[act] > k + 1)
        act, h = act[on], h[on]
        if not len(act):
            break
    while len(found) > 1 and not len(found[-1][0]):
        found.pop()
    return found


def _weigh(p: Pieces, c: np.ndarray, found: list, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row (place) the weights and the pieces that end there, by length."""
    weight = np.zeros((len(c), len(found)))
    piece = np.full((len(c), len(found)), -1, dtype=np.int32)
    weight[:, 0] = p.fallback
    piece[row_of, 0] = c.astype(np.int32) + p.size
    for k, (at, ids) in enumerate(found):
        weight[row_of[at + k], k] = p.weights[ids]
        piece[row_of[at + k], k] = ids
    return weight, piece


def _lattice(p: Pieces, c: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct units, longest first, that lie end to end in c: for each place (all units' first
    places, then all second ones, ...; the last result has where each starts) the running sums over
    the lengths of pieces that end there of forward weight times piece weight, and those pieces."""
    n = len(c)
    tops = np.cumsum(sizes)
    unit = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    off = np.arange(n) - np.repeat(tops - sizes, sizes)
    per = np.bincount(off)  # how many units have a place so far on: they are the first ones
    base = np.concatenate([[0], np.cumsum(per)])
    row_of = base[off] + unit
    found = _matches(p, c, np.repeat(tops, sizes) - np.arange(n))
    most = len(found)  # the longest piece that occurs here
    weight, piece = _weigh(p, c, found, row_of)
    # Columns are sums over paths that end with a place: the last `most` places, then those to come.
    # Scaling a unit's columns alike changes no draw, and keeps long units in range.
    forward = np.zeros((len(sizes), most + _RESCALE))
    forward[:, most - 1] = 1.0
    for t, m in enumerate(per.tolist()):
        j = t % _RESCALE
        if t and not j:
            forward[:m, :most] = forward[:m, _RESCALE:] / forward[:m, _RESCALE:].max(axis=1, keepdims=True)
        sums = weight[base[t] : base[t + 1]]
        sums *= forward[:m, j : j + most][:, ::-1]
        np.cumsum(sums, axis=1, out=sums)
        forward[:m, most + j] = sums[:, -1]
    return weight, piece, base


def _forward_block(p: Pieces, c: np.ndarray, first: int, last: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one unit's places first to last - 1: the running sums, the pieces, and the sums over paths
    that end with each of the last p.longest places. before: the latter at `first`."""
    low = max(0, first - p.longest + 1)
    part = c[low:last]
    weight, piece = _weigh(p, part, _matches(p, part, len(part) - np.arange(len(part))), np.arange(len(part)))
    weight, piece = weight[first - low :], piece[first - low :]
    most, window = weight.shape[1], before.tolist()
    for t in range(last - first):
        sums = np.cumsum(weight[t] * window[: -most - 1 : -1])
        weight[t] = sums
        window.append(float(sums[-1]))
        if t % _RESCALE == _RESCALE - 1:
            top = max(window[-p.longest :])
            window = [x / top for x in window[-p.longest :]]
    return weight, piece, np.array(window[-p.longest :])


def _sample_long(p: Pieces, c: np.ndarray, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_sample of one long unit, in memory of one block."""
    edges = [*range(0, len(c), BLOCK), len(c)]
    states = [np.concatenate([np.zeros(p.longest - 1), [1.0]])]
    for a, b in zip(edges[:-2], edges[1:-1], strict=True):
        states.append(_forward_block(p, c, a, b, states[-1])[2])
    with np.errstate(over="ignore"):
        stream = mix64(key + place.astype(U64) * U64(0x632BE59BD9B4E019))
    drawn, at, step = [], len(c) - 1, 0
    for a, b, state in zip(edges[-2::-1], edges[:0:-1], states[::-1], strict=True):
        sums, piece, _ = _forward_block(p, c, a, b, state)
        with np.errstate(over="ignore"):
            u = ((mix64(stream + np.arange(step, step + b - a, dtype=U64) * _STEP) >> U64(11)).astype(np.float64) * 2.0**-53).tolist()
        began = step
        while at >= a:
            row = sums[at - a]
            k = int(np.searchsorted(row, u[step - began] * row[-1], side="right"))
            drawn.append(piece[at - a, k])
            at -= k + 1
            step += 1
    return np.array(drawn[::-1], dtype=np.int32), np.array([len(drawn)])


def _sample(p: Pieces, c: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of all units of c in order, and how many each unit has."""
    size = ends - starts
    off = np.arange(len(c)) - np.repeat(starts, size)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum((c.astype(U64) + U64(1)) * _PLACE[off], dtype=U64)])
        name = mix64((total[ends] - total[starts]) + size.astype(U64))
    _, first, same = np.unique(name, return_index=True, return_inverse=True)
    order = np.argsort(-size[first], kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    first, which = first[order], rank[same]
    sizes = size[first]
    tops = np.cumsum(sizes)
    own = np.repeat(starts[first] - (tops - sizes), sizes) + np.arange(tops[-1])
    sums, piece, base = _lattice(p, c[own], sizes)
    who, at = np.arange(len(starts)), size - 1
    with np.errstate(over="ignore"):
        stream = mix64(key + place.astype(U64) * U64(0x632BE59BD9B4E019))
    taken, drawn = [], []
    step = 0
    count = np.zeros(len(starts), dtype=np.int64)
    while len(who):
        with np.errstate(over="ignore"):
            u = (mix64(stream[who] + U64(step) * _STEP) >> U64(11)).astype(np.float64) * 2.0**-53
        row = base[at] + which[who]
        rows = sums[row]
        k = (rows <= (u * rows[:, -1])[:, None]).sum(axis=1)
        taken.append(who)
        drawn.append(piece[row, k])
        count[who] += 1
        at = at - k - 1
        on = at >= 0
        who, at = who[on], at[on]
        step += 1
    last = np.cumsum(count)
    out = np.empty(last[-1], dtype=np.int32)
    for s, (w, d) in enumerate(zip(taken, drawn, strict=True)):
        out[last[w] - 1 - s] = d
    return out, count


def _spell(p: Pieces, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points without a piece become the pieces of their bytes."""
    bare = np.flatnonzero(ids >= p.size)
    if not len(bare):
        return ids, count
    raw = [chr(x).encode() for x in (ids[bare] - p.size).tolist()]
    width = np.ones(len(ids), dtype=np.int64)
    width[bare] = [len(b) for b in raw]
    out = np.repeat(ids, width)
    begin = np.cumsum(width) - width
    more = np.repeat(begin[bare], width[bare]) + np.arange(width[bare].sum()) - np.repeat(np.cumsum(width[bare]) - width[bare], width[bare])
    out[more] = p.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.add.reduceat(width, np.cumsum(count) - count)


def encode(texts: list[str], keys: np.ndarray, p: Pieces, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of all texts end to end, and how many each text has. keys: one number a text."""
    full = [i for i, t in enumerate(texts) if t]
    number = np.zeros(len(texts), dtype=np.int64)
    if not full:
        return np.zeros(0, np.int32), number
    c = np.frombuffer("".join(f" {texts[i]}" for i in full).encode("utf-32-le"), np.uint32)
    docs = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in full])[:-1]])
    starts = np.flatnonzero(_unit_starts(c, docs))
    ends = np.append(starts[1:], len(c))
    doc = np.searchsorted(docs, starts, side="right") - 1
    place = np.arange(len(starts)) - np.searchsorted(starts, docs)[doc]
    key = mix64(np.asarray(keys, dtype=np.int64).astype(U64)[full] ^ mix64(np.array([seed], dtype=U64)))[doc]
    long = np.append(np.flatnonzero(ends - starts > LONG), len(starts))
    out = []
    i = 0
    while i < len(starts):
        base = starts[i]
        if ends[i] - base > LONG:
            j = i + 1
            drawn = _sample_long(p, c[base : ends[i]], place[i:j], key[i:j])
        else:
            j = min(max(i + 1, int(np.searchsorted(starts, base + SEGMENT))), int(long[np.searchsorted(long, i)]))
            drawn = _sample(p, c[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base, place[i:j], key[i:j])
        ids, count = _spell(p, *drawn)
        out.append(ids)
        number += np.bincount(np.array(full)[doc[i:j]], weights=count, minlength=len(texts)).astype(np.int64)
        i = j
    return np.concatenate(out), number


def decode_bytes(ids: np.ndarray, count: np.ndarray, p: Pieces) -> list[bytes]:
    """Each text's UTF-8 bytes, from the pieces end to end; the leading space goes."""
    size = p.lengths[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    raw = p.blob[np.repeat(p.offsets[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
    edge = total[np.concatenate([[0], np.cumsum(count)])]
    return [raw[a:b][1:] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def encode_documents(docs: DataFrame, model: str = MODEL, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """doc_id, pieces, n_pieces, lossless (decoding gives the text again) of every document."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_at(model, alpha)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            keys = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            ids, count = encode(texts, keys, p, seed)
            same = [x == t.encode() for x, t in zip(decode_bytes(ids, count, p), texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(count, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "pieces", "n_pieces", "lossless"])

    return narrow.mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long, lossless boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of encoded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_at(model, 1.0)
        for b in batches:
            lists = b.column(1)
            count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = decode_bytes(lists.flatten().to_numpy(zero_copy_only=False), count, p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
