"""Chat formatting: cumulative snapshots of one conversation collapse before rendering.

A log may hold a conversation again after each turn. Rolling hashes of turn prefixes (128 bits of
XOR-combined, position-keyed turn hashes) identify the ones that are a prefix of a longer one; an
anti-join leaves the maximal ones, and of equal conversations the one with the least conv_id.
Turns are ordered by (turn, role, text); null roles and texts count as empty; a repeated turn row
stays a turn. An empty table gives an empty result. Texts are hashed and rendered whole; one
rendered conversation must fit a row. Further columns are not read, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure, settle

#: Turns (by position) hashed together before the blocks of a conversation are chained.
BLOCK = 64
_ORDER = ["turn", "role", "text"]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, k (turns so far), h1, h2: the rolling hash of each conversation's first k turns.

    Positions and hashes run within blocks of turn numbers and then over block totals, so that a
    conversation with very many turns is not chained in one task row by row.
    """
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK)
    inside = Window.partitionBy("conv_id", "_b").orderBy(*[F.col(c).asc_nulls_first() for c in _ORDER])
    narrow = turns.select("conv_id", "turn", block.alias("_b"), F.xxhash64("role", "text").alias("role"), F.xxhash64(F.lit(7), "text", "role").alias("text"))
    # Positions first: each turn's place in its block, after the number of turns in blocks before it.
    sizes = narrow.groupBy("conv_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = (F.col("l.conv_id").eqNullSafe(F.col("r.conv_id"))) & (F.col("l._b") == F.col("r._b"))

    def with_blocks(left: DataFrame, right: DataFrame, *add: str) -> DataFrame:
        return left.alias("l").join(right.alias("r"), same).select("l.*", *[f"r.{c}" for c in add])

    placed = with_blocks(narrow.withColumn("_i", F.row_number().over(inside)), sizes, "_start")
    k = F.col("_start") + F.col("_i")
    placed = placed.select("conv_id", "_b", k.alias("k"), F.xxhash64(k, "role").alias("t1"), F.xxhash64(k, "text").alias("t2"))
    running = Window.partitionBy("conv_id", "_b").orderBy("k")
    totals = placed.groupBy("conv_id", "_b").agg(F.bit_xor("t1").alias("_x1"), F.bit_xor("t2").alias("_x2"))
    chained = totals.select("conv_id", "_b", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(y) for x, y in (("_x1", "_p1"), ("_x2", "_p2"))])
    own = placed.select("conv_id", "_b", "k", F.bit_xor("t1").over(running).alias("h1"), F.bit_xor("t2").over(running).alias("h2"))
    return with_blocks(own, chained, "_p1", "_p2").select("conv_id", "k", F.col("h1").bitwiseXOR(F.col("_p1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("_p2")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies (equal conversations, itself included) of those to keep."""
    hashes = settle(prefix_hashes(turns))
    ends = hashes.groupBy("conv_id").agg(F.max_by(F.struct("k", "h1", "h2"), "k").alias("e")).select("conv_id", "e.*")
    whole = ends.groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    marked = hashes.alias("a").join(ends.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.k") < F.col("b.k")), "left_semi")
    prefixes = marked.select("k", "h1", "h2").distinct()  # a very common first turn is one row here
    return whole.join(prefixes, ["k", "h1", "h2"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """kept plus each conversation's text in the chat markup."""
    piece = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    parts = turns.alias("t").join(kept.alias("q"), F.col("t.conv_id").eqNullSafe(F.col("q.conv_id")), "left_semi").select("conv_id", "turn", "role", "text", piece.alias("piece"))
    texts = parts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), "role", "text", "piece"))), lambda s: s["piece"]), "").alias("text"))
    return kept.alias("q").join(texts.alias("t"), F.col("q.conv_id").eqNullSafe(F.col("t.conv_id"))).select("q.*", "t.text")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text of every maximal conversation."""
    turns = ensure(conversations, conv_id="long", turn="long", role="string", text="string").fillna({"role": "", "text": ""})
    return render(turns, settle(maximal(turns)))
