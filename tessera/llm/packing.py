"""Sequence packing as vector bin packing.

Texts become token ids, one closing id is added, and the ids are laid into
sequences under three simultaneous limits: tokens, segments, and loss-bearing
tokens. Whole stretches of a full sequence's length are cut off first. The
rests are items with a size vector (tokens, 1 segment, loss tokens); a
sequence is filled by the dot-product heuristic: of the items that fit, take
the one with the largest inner product of its size vector and the room left,
each side divided by its limit. When no whole item fits and two limits still
have room, an item is cut to fill the token room exactly, since documents may
be cut freely; examples that must stay whole are packed with ``cut=False``.

A partition is packed on its own, from its rows in the order they come, with at most ``pool``
items waiting, so memory does not grow with the input and nothing
is shuffled. What a partition has left at its end is cut at powers of two,
which need no padding. A sequence is named by partition and number.

Defined results: NULL text counts as empty (its closing id alone); equal rows
are packed each by itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import small_batches
from tessera.llm.tokens import CachedEncoder

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "`offset` long, segment long, loss_tokens long")


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass
class Piece:
    """A stretch of one document's ids; ``loss_at`` is the first loss-bearing one."""
    doc: int | None
    start: int
    ids: np.ndarray
    total: int
    loss_at: int = 0

    def loss(self) -> int:
        return max(0, len(self.ids) - max(0, self.loss_at - self.start))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:n], self.total, self.loss_at),
                Piece(self.doc, self.start + n, self.ids[n:], self.total, self.loss_at))


class Pool:
    """Pieces that wait, with their size vectors (tokens, 1 segment, loss tokens) as one array."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces
        self.sizes = np.array([(len(p.ids), 1, p.loss()) for p in pieces], float).reshape(-1, 3)
        self.free = np.ones(len(pieces), bool)
        self.left = len(pieces)

    def take(self, k: int) -> Piece:
        self.free[k] = False
        self.left -= 1
        return self.pieces[k]

    def give(self, k: int, p: Piece) -> None:
        """Put the rest of a cut piece back in its place."""
        self.pieces[k], self.sizes[k], self.free[k] = p, (len(p.ids), 1, p.loss()), True
        self.left += 1

    def waiting(self) -> list[Piece]:
        return [self.pieces[k] for k in np.flatnonzero(self.free)]

    def tokens(self) -> int:
        return int(self.sizes[self.free, 0].sum())


def fill(pool: Pool, limits: Limits, cut: bool = True) -> list[Piece]:
    """Take one sequence's pieces out of the pool by the dot-product heuristic."""
    cap = np.array([limits.tokens, limits.segments, limits.loss], float)
    room, taken, rests = cap.copy(), [], []
    share = pool.sizes / cap
    while room[0] > 0 and room[1] > 0:
        fits = pool.free & (pool.sizes <= room).all(1)
        if fits.any():
            k = int(np.argmax(np.where(fits, share @ (room / cap), -1.0)))
            room -= pool.sizes[k]
            taken.append(pool.take(k))
            continue
        if not cut or not pool.free.any() or room[2] < 1:
            break
        k = int(np.argmax(np.where(pool.free, pool.sizes[:, 0], -1.0)))
        p = pool.pieces[k]
        n = min(int(room[0]), max(0, p.loss_at - p.start) + int(room[2]), len(p.ids) - 1)
        if n < 1:
            break
        pool.take(k)
        head, tail = p.cut(n)
        taken.append(head)
        rests.append((k, tail))
        room -= (len(head.ids), 1, head.loss())
    for k, tail in rests:
        pool.give(k, tail)
    return taken


def pack(items: Iterator[Piece], limits: Limits, pool_size: int = 512, cut: bool = True) -> Iterator[list[Piece]]:
    """Sequences of pieces, in bounded memory.

    With ``cut=False`` an item beyond a limit is an error, since it can't stay whole."""
    waiting: list[Piece] = []
    for p in items:
        while cut and len(p.ids) >= limits.tokens and limits.loss >= limits.tokens:
            head, p = p.cut(limits.tokens)
            yield [head]
        if not cut and (len(p.ids) > limits.tokens or p.loss() > limits.loss):
            raise ValueError(f"document {p.doc} has {len(p.ids)} tokens, {p.loss()} with loss; a sequence takes {limits}")
        if len(p.ids):
            waiting.append(p)
        if len(waiting) >= pool_size:
            pool = Pool(waiting)
            while pool.left > pool_size // 2:
                yield fill(pool, limits, cut)
            waiting = pool.waiting()
    pool = Pool(waiting)
    while pool.left and (not cut or pool.tokens() >= limits.tokens or pool.left > limits.segments):
        yield fill(pool, limits, cut)
    while pool.left:  # the end: lengths that are powers of two
        n = min(limits.tokens, limits.loss, 1 << (pool.tokens().bit_length() - 1))
        yield fill(pool, Limits(n, limits.segments, n), cut)


def pack_documents(df: DataFrame, encoder: Callable[[], CachedEncoder], limits: Limits = Limits(), pool_size: int = 512,
                   end_id: int = 1, key: str = "doc_id", text: str = "text", loss_from: str | None = None) -> DataFrame:
    """One row per piece; see SCHEMA. ``loss_from`` names a column with the first loss-bearing token (0 if none)."""
    cols = [F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
            (F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")).alias("loss_at")]

    def run(batches):
        encode = encoder()

        def items():
            for b in batches:
                for doc, ids, loss_at in zip(b.column(0).to_pylist(), encode.many(b.column(1)), b.column(2).to_pylist(), strict=True):
                    ids = np.append(ids, np.uint32(end_id))  # a copy: waiting pieces do not hold their batch
                    yield Piece(doc, 0, ids, len(ids), loss_at)

        base, out = TaskContext.get().partitionId() << 32, []
        for n, sequence in enumerate(pack(items(), limits, pool_size)):
            at = 0
            for k, p in enumerate(sequence):
                out.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, base + n, at, k, p.loss()))
                at += len(p.ids)
            if len(out) >= 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return small_batches(df).select(*cols).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]):
    import pyarrow as pa
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
