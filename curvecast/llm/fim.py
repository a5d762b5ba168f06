"""Fill-in-middle transformation as a pyarrow.compute pipeline over batches.

Texts are cut into units (a run of ASCII letters, or any other single character): every unit gets a
byte after it that no UTF-8 text holds, and the marked texts are split there into list arrays. The
flattened units keep their parent's index; an ordinal within the parent and two cut points give
each its role (prefix, middle, suffix). Units are filtered by role, rebuilt into lists of the
lengths that the cut points give, and joined; the pieces and their markers are joined per row.

Cuts and form follow from a hash of the seed and doc_id, so that they depend neither on partitions
nor on order. A null or empty text is plain and stays empty; so is a text that holds a marker, which
keeps every output reversible (:func:`restored`). A null doc_id hashes as an empty string. Repeated
rows come out alike; an empty table stays empty; texts are read whole, however long (a slice holds
SLICE bytes or one text). Bytes that are no UTF-8 become U+FFFD. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers, and a unit in UTF-8 bytes (a run of letters, another ASCII character, a longer code point).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = rb"([A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC2-\xF4][\x80-\xBF]+)"
_END = b"\xff"
#: Bytes of text that go through the pipeline at a time.
SLICE = 4 << 20
_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def units(text: pa.Array) -> pa.Array:
    """The units of each text as a list array, one empty value after the last."""
    marked = pc.replace_substring_regex(text.cast(pa.large_binary()), pattern=_UNIT, replacement=rb"\1" + _END)
    return pc.split_pattern(marked, pattern=_END)


def _rest(x: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def _pieces(flat: pa.Array, chosen: pa.Array, lengths: pa.Array) -> pa.Array:
    """Chosen units of all rows, rebuilt into one list a row and joined."""
    ends = pc.cumulative_sum(lengths).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, chosen)), pa.scalar(b"", flat.type)).cast(pa.large_string())


def rearrange(text: pa.Array, h: list[pa.Array], plain_percent: int = 10, spm_percent: int = 20) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts (large_string, no nulls), given four
    hashes (int64, not negative) a row: two for the cuts, one for plain, one for the order."""
    lists = units(text)
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)
    cuts = [_rest(x, pc.add(n, 1)) for x in h[:2]]
    first, last = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(lists.offsets.cast(pa.int64()), parent))
    in_prefix, before_suffix = pc.less(ordinal, pc.take(first, parent)), pc.less(ordinal, pc.take(last, parent))
    in_suffix = pc.and_not(pc.less(ordinal, pc.take(n, parent)), before_suffix)
    prefix = _pieces(flat, in_prefix, first)
    middle = _pieces(flat, pc.and_not(before_suffix, in_prefix), pc.subtract(last, first))
    suffix = _pieces(flat, in_suffix, pc.subtract(n, last))
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_rest(h[2], pa.scalar(100)), 100 - plain_percent))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(text, mark))
    spm = pc.less(_rest(h[3], pa.scalar(100)), spm_percent)
    mark = {m: pa.scalar(m, pa.large_string()) for m in (PREFIX, SUFFIX, MIDDLE, "")}
    joined = [pc.binary_join_element_wise(mark[a], x, mark[b], y, mark[MIDDLE], middle, mark[""]) for a, x, b, y in ((SUFFIX, suffix, PREFIX, prefix), (PREFIX, prefix, SUFFIX, suffix))]
    none = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, none, pc.utf8_length(prefix)),
        "middle_chars": pc.if_else(plain, none, pc.utf8_length(middle)),
        "output": pc.if_else(plain, text, pc.if_else(spm, *joined)),
    }


def _slices(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most SLICE bytes of text, or one row."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)), 0
    while start < b.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        yield b.slice(start, stop - start)
        start = stop


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and output of each document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    text = F.make_valid_utf8(F.coalesce(F.col("text").cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 1):
                found = rearrange(part.column(1).cast(pa.large_string()), part.columns[2:], plain_percent, spm_percent)
                found["output"] = found["output"].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *found.values()], names=["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *hashes).mapInArrow(run, _DDL)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: markers are unique, as texts that hold one stay plain."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    head, rest = F.split_part(body, second, F.lit(1)), F.split_part(body, second, F.lit(2))
    tail, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
