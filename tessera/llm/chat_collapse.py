"""Chat formatting with cumulative-snapshot collapse.

Chat systems log a conversation again after every turn, so a log holds many
snapshots that are prefixes of a longer one. Every turn gets a rolling prefix
hash: the exclusive-or of the hashes of (position, role, text) of all turns up
to it, kept in two independent 64-bit lanes. A conversation whose last hash is
the hash of an inner turn of another one is a proper prefix of it and goes; of
equal conversations the one with the least id stays. What is left is rendered.

Only DataFrame functions are used. Exclusive-or can be regrouped, so a
conversation of any length is hashed in pieces of ``piece`` turn numbers, each
a window of its own, with the pieces before carried in. Hashes are made
distinct before they are joined: a first turn that a third of all
conversations share is one row on either side of the anti-join.

Defined results: turns are ordered by (turn, role, text), NULL first;
repeated rows count as further turns; a NULL role renders as "user" and a NULL
text as nothing (both hash apart from the empty string); rows with a NULL
conversation id form one conversation; an empty table gives an empty result; other columns are
ignored. A rendered conversation comes in parts of ``part_turns`` turns, so a row stays
bounded: ``part`` counts from 0 and the texts join without a separator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_dir

#: Turn numbers per hashing piece, and turns per rendered row.
PIECE = 4096
PART_TURNS = 256


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys with NULL equal to NULL; the keys of the left side are kept."""
    b = b.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return a.join(b, on, how).drop(*[f"__right_{k}" for k in keys])


def positions(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """``conv_id, role, text, pos, __piece``: pos counts a conversation's turns from 0."""
    t = turns.select("conv_id", "turn", "role", "text",
                     F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / piece).cast("bigint").alias("__piece"))
    sizes = t.groupBy("conv_id", "__piece").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("conv_id").orderBy("__piece")
    sizes = sizes.select("conv_id", "__piece", (F.sum("__n").over(w) - F.col("__n")).alias("__before"))
    inside = Window.partitionBy("conv_id", "__piece").orderBy("turn", "role", "text")
    t = t.withColumn("__at", F.row_number().over(inside).cast("bigint"))
    return (_same(t, sizes, ["conv_id", "__piece"], "inner")
            .select("conv_id", "role", "text", "__piece", (F.col("__before") + F.col("__at") - 1).alias("pos")))


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """``conv_id, pos, h1, h2``: the rolling hash of turns 0 to pos."""
    def lane(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    h = placed.select("conv_id", "__piece", "pos", lane(17).alias("a"), lane(71).alias("b"))
    whole = h.groupBy("conv_id", "__piece").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("conv_id", "__piece",
                           F.coalesce(F.bit_xor("a").over(before), F.lit(0).cast("bigint")).alias("ca"),
                           F.coalesce(F.bit_xor("b").over(before), F.lit(0).cast("bigint")).alias("cb"))
    rolling = Window.partitionBy("conv_id", "__piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("conv_id", "__piece", "pos", F.bit_xor("a").over(rolling).alias("a"), F.bit_xor("b").over(rolling).alias("b"))
    return _same(h, carried, ["conv_id", "__piece"], "inner").select(
        "conv_id", "pos", F.col("a").bitwiseXOR(F.col("ca")).alias("h1"), F.col("b").bitwiseXOR(F.col("cb")).alias("h2"))


def maximal(placed: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the conversations to keep, from their placed turns."""
    hashes = prefix_hashes(placed)
    ends = hashes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("e"))
    finals = (ends.groupBy("e.pos", "e.h1", "e.h2")
              .agg(F.min(F.struct(F.col("conv_id").isNull().alias("n"), "conv_id")).alias("c"),
                   F.count(F.lit(1)).alias("n_copies")))
    last = ends.select("conv_id", F.col("e.pos").alias("last"))
    inner = _same(hashes, last, ["conv_id"], "inner").where("pos < last").select("pos", "h1", "h2").distinct()
    return finals.join(inner, ["pos", "h1", "h2"], "left_anti").select(
        F.col("c.conv_id").alias("conv_id"), (F.col("pos") + 1).alias("n_turns"), "n_copies")


def render(placed: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, part, rendered``: turns as ``<|role|>\\ntext<|end|>\\n`` in order."""
    line = F.concat(F.lit("<|"), F.coalesce(F.col("role"), F.lit("user")), F.lit("|>\n"),
                    F.coalesce(F.col("text"), F.lit("")), F.lit("<|end|>\n"))
    parts = placed.select("conv_id", F.floor(F.col("pos") / part_turns).cast("bigint").alias("part"), "pos", line.alias("s"))
    return parts.groupBy("conv_id", "part").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"])).alias("rendered"))


def collapse_and_render(turns: DataFrame, piece: int = PIECE, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, part, n_turns, n_copies, rendered`` of every maximal conversation.

    ``n_copies`` counts the logged conversations equal to the kept one, itself included."""
    scratch_dir(turns.sparkSession)
    placed = positions(turns, piece).checkpoint()  # read three times below
    keep = maximal(placed)
    kept = _same(placed, keep.select("conv_id"), ["conv_id"], "left_semi")
    return _same(render(kept, part_turns), keep, ["conv_id"], "inner").select(
        "conv_id", "part", "n_turns", "n_copies", "rendered")
