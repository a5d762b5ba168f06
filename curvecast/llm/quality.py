"""Quality rules: zstandard ratios over whole documents and fixed chunks, with limits by length.

A document whose compressed share of its bytes lies below its length's band is repetitive, above
it incompressible; so is one of which too many fixed chunks lie outside the chunk band. Words are
runs of bytes other than space and \\t-\\r. A null or empty text has no words and fails the base
rule; repeated rows are judged alike; an empty table stays empty. Texts are judged whole: what is
left after the last fixed chunk counts in the ratio of the whole. An input column named like a
measure is replaced (judge); keep_good leaves all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits by length: (documents shorter than so many bytes, least ratio, largest ratio). The ratio
#: of clean prose goes on falling until texts are several times zstandard's window (2 MB at level 3).
BANDS = [
    (100, 0.30, 9.00),
    (200, 0.55, 1.05),
    (400, 0.54, 0.90),
    (800, 0.50, 0.80),
    (1600, 0.465, 0.72),
    (3200, 0.445, 0.66),
    (6400, 0.420, 0.62),
    (12800, 0.400, 0.60),
    (25600, 0.385, 0.60),
    (51200, 0.375, 0.60),
    (102400, 0.368, 0.60),
    (204800, 0.363, 0.60),
    (409600, 0.352, 0.60),
    (819200, 0.345, 0.60),
    (1638400, 0.335, 0.60),
    (3276800, 0.325, 0.60),
    (6553600, 0.315, 0.60),
    (1 << 62, 0.305, 0.60),
]
CHUNK = 4096
#: Chunk band, and the largest share of whole chunks that may lie outside it.
CHUNK_BAND, MAX_CHUNK_SHARE = (0.40, 0.62), 0.5
LEVEL, WINDOW = 3, 8
MIN_WORDS, MAX_REPEAT = 20, 30

_SPACES = " \t\n\v\f\r"
_RESULT = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("ratio", pa.float64()), ("chunk_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
RESULT_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, chunk_share double, base_failed boolean, kept boolean"
_SYMBOLS = bytes(range(256)).translate(None, b"#*$%&|<>")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found at least twice; exact, by doubling."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if len(ids) == n:
        return 0
    size = 1
    while size < window:
        step = min(size, window - size)
        _, x = np.unique(x[:-step] * (int(x.max()) + 1) + x[step:], return_inverse=True)
        size += step
    twice = np.bincount(x)[x] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def ratios(raw: bytes, compress) -> tuple[float, float]:
    """Compressed share of the whole, and the share of whole chunks outside the chunk band."""
    if not raw:
        return 0.0, 0.0
    whole = len(raw) // CHUNK
    low, high = CHUNK_BAND
    out = sum(not low <= len(compress(raw[i * CHUNK : (i + 1) * CHUNK])) / CHUNK <= high for i in range(whole))
    return len(compress(raw)) / len(raw), out / whole if whole else 0.0


def in_bands(n_bytes: int, ratio: float, chunk_share: float) -> bool:
    low, high = next((a, b) for most, a, b in BANDS if n_bytes < most)
    return low <= ratio <= high and chunk_share <= MAX_CHUNK_SHARE


def measure(text: str, compress) -> tuple:
    raw = text.encode()
    words = raw.split()  # bytes.split() cuts at space and \t-\r only
    n = len(words)
    repeated = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT * n
    ratio, share = ratios(raw, compress)
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    return n, chars, len(raw.translate(None, _SYMBOLS)), dup_lines(text), repeated, ratio, share, failed, not failed and in_bands(len(raw), ratio, share)


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus the measures, base_failed and kept; input columns of those names are replaced."""
    df = df.drop(*[c for c, _ in _RESULT])
    kept = df.columns
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            rows = [measure(t or "", compress) for t in b.column(at).to_pylist()]
            new = zip(*rows, strict=True) if rows else [[] for _ in _RESULT]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(list(v), type=t) for v, (_, t) in zip(new, _RESULT, strict=True)]], names=[*kept, *[c for c, _ in _RESULT]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *T.StructType.fromDDL(RESULT_DDL).fields]))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their own columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            yield b.filter(pa.array([measure(t or "", compress)[-1] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
