"""SimHash near-duplicates found by Golay-code fuzzy keys.

A text's fingerprint has a bit set where over half of its shingle hashes have
it. Two fingerprints are linked at ``max_bits`` (3) or fewer differing bits;
a component is everything reachable by links.

Candidates. A 64-bit fingerprint has four segments of 16 bits. With three
errors some segment has none (pigeonhole). Of the 48 bits beside it, 23 are
decoded by the perfect binary Golay code: a word within two errors of another
shares with it a codeword among the "nearby" ones - its own codeword if that
is at distance two or less, else its own and the five at distance four. So each fingerprint
has, per error-free segment, one or six keys of 16 + 12 bits; if all three errors fall into
the 23 bits, the other 41 bits are equal and are a key of their own.
Fingerprints that share a key are joined and verified by their bits.

Equal fingerprints are one node before any join, so copies cost nothing. A
bucket with more than ``hot`` fingerprints is dealt anew by the
pigeonhole over its 48 free bits (four segments of 12), in as many tasks as there are
values. Inside a bucket links are followed breadth first, comparing a fingerprint only
with those not reached yet, and a spanning forest is returned instead of all pairs.

Defined results: NULL and empty texts, and texts of white space, have fingerprint zero and link like any other; a
NULL id counts only if all ids of a component are NULL; repeated rows are
returned each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import small_batches
from tessera.llm.components import components
from tessera.llm.textbytes import U64, parts, word_bounds
from tessera.session import scratch_dir

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                      0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Fixed value: generator polynomial of the [23, 12] binary Golay code.
GOLAY = 0xC75
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _turn(x, n):
    return (x << U64(n)) | (x >> U64(64 - n))


def _round(acc, lane):
    return _turn(acc + lane * P2, 31) * P1


def xxh64(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many stretches of one byte buffer, all stretches of a length at once."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    n = max(1, len(buffer))
    eight = np.ndarray((n,), "<u8", padded.data, strides=(1,))
    four = np.ndarray((n,), "<u4", padded.data, strides=(1,))
    out = np.zeros(len(starts), U64)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    with np.errstate(over="ignore"):
        for group in np.split(order, cuts):
            if not len(group):
                continue
            at, length = starts[group], int(lengths[group[0]])
            pos = 0
            if length >= 32:
                v = [np.full(len(group), (seed + int(c)) & (2 ** 64 - 1), U64) for c in (int(P1) + int(P2), int(P2), 0, -int(P1))]
                while pos + 32 <= length:
                    v = [_round(a, eight[at + (pos + 8 * i)]) for i, a in enumerate(v)]
                    pos += 32
                acc = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
                for a in v:
                    acc = (acc ^ _round(U64(0), a)) * P1 + P4
            else:
                acc = np.full(len(group), (seed + int(P5)) & (2 ** 64 - 1), U64)
            acc = acc + U64(length)
            while pos + 8 <= length:
                acc = _turn(acc ^ _round(U64(0), eight[at + pos]), 27) * P1 + P4
                pos += 8
            if pos + 4 <= length:
                acc = _turn(acc ^ (four[at + pos].astype(U64) * P1), 23) * P2 + P3
                pos += 4
            while pos < length:
                acc = _turn(acc ^ (buffer[at + pos].astype(U64) * P5), 11) * P1
                pos += 1
            acc = (acc ^ (acc >> U64(33))) * P2
            acc = (acc ^ (acc >> U64(29))) * P3
            out[group] = acc ^ (acc >> U64(32))
    return out


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """One 64-bit SimHash per text (unsigned)."""
    out = np.zeros(len(texts), U64)
    for first, data, offsets in parts(texts):
        data = _LOWER[data]
        starts, ends, rows = word_bounds(~_SPACE[data], offsets)
        if not len(starts):
            continue
        # words joined by single spaces, so a shingle is one stretch
        sizes = ends - starts
        joined = np.cumsum(sizes + 1) - sizes - 1
        buffer = np.full(int(joined[-1] + sizes[-1]), 32, np.uint8)
        inside = ~_SPACE[data]
        words = np.flatnonzero(inside)
        buffer[words - np.repeat(starts - joined, sizes)] = data[words]
        done = joined + sizes
        count = np.bincount(rows, minlength=len(offsets) - 1)
        begin = np.concatenate([[0], np.cumsum(count)])
        some = np.flatnonzero(count)
        n = np.maximum(count[some] - shingle + 1, 1)  # shingles of each text with words
        lead = np.repeat(begin[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        tail = np.minimum(lead + shingle, np.repeat(begin[some + 1], n)) - 1
        h = xxh64(buffer, joined[lead], done[tail] - joined[lead])
        at = np.concatenate([[0], np.cumsum(n)])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.stack([bits[a:b].sum(0, dtype=np.int64) for a, b in zip(at[:-1], at[1:], strict=True)])
        majority = (2 * votes > n[:, None]).astype(np.uint8)
        out[first + some] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return out


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of 12-bit heads, and per syndrome the six error patterns that lead to nearby codewords."""
    def rest(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GOLAY << (i - 11)
        return word

    heads = np.array([rest(x << 11) for x in range(1 << 12)], np.int64)
    one = [rest(1 << i) for i in range(23)]
    patterns: list[list[int]] = [[] for _ in range(2048)]
    patterns[0].append(0)
    for i in range(23):
        patterns[one[i]].append(1 << i)
        for j in range(i):
            patterns[one[i] ^ one[j]].append(1 << i | 1 << j)
            for k in range(j):
                three = 1 << i | 1 << j | 1 << k
                patterns[one[i] ^ one[j] ^ one[k]].append(three)
    leaders = [min(p, key=lambda x: x.bit_count()) for p in patterns]
    table = np.zeros((2048, 6), np.int64)
    for s, leader in enumerate(leaders):
        near = [leader]
        if leader.bit_count() == 3:
            # codewords at distance four: flip one more bit, decode, keep what is new
            near += sorted({(1 << i) ^ leaders[s ^ one[i]] for i in range(23)} - {leader})
        table[s] = (near * 6)[:6]
    return heads, table


def nearby(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the codewords near 23-bit words: n x 6, repeats for words with one."""
    heads, table = golay_tables()
    syndrome = heads[words >> 11] ^ (words & 0x7FF)
    return (words[:, None] ^ table[syndrome]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit keys of fingerprints; two within 3 bits share one at least."""
    prints = prints.astype(U64)
    segments = [(prints >> U64(16 * i)) & U64(0xFFFF) for i in range(4)]
    rows, keys = [], []
    for k in range(4):
        a, b, c = (segments[i] for i in range(4) if i != k)
        rest = a | b << U64(16) | c << U64(32)
        low, high = (rest & U64(0x7FFFFF)).astype(np.int64), rest >> U64(23)
        near = nearby(low)
        fresh = np.ones(near.shape, bool)
        for j in range(1, 6):
            fresh[:, j] = (near[:, j:j + 1] != near[:, :j]).all(1)
        row, col = np.nonzero(fresh)
        rows += [row, np.arange(len(prints))]
        keys += [U64(2 * k) << U64(60) | segments[k][row] << U64(12) | near[row, col].astype(U64),
                 U64(2 * k + 1) << U64(60) | segments[k] << U64(25) | high]
    return np.concatenate(rows), np.concatenate(keys)


#: Prints of a bucket that are compared with each other; more are dealt again by their bits.
COMPARED = 4096


def spanning(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (positions) that connect what is connected within ``max_bits``, of distinct prints.

    Up to COMPARED prints go breadth first over those not reached. Of more, at least 13 bits differ somewhere; these are
    dealt into one group more than bits may differ, so two prints within ``max_bits`` agree on a group at least,
    and the prints that agree on a group are a smaller case."""
    prints = prints.view(U64)  # the bits of a negative number are not those of its absolute value
    if len(prints) > COMPARED:
        varying = int(np.bitwise_or.reduce(prints ^ prints[0]))
        bits, out = [i for i in range(64) if varying >> i & 1], []
        for j in range(max_bits + 1):
            value = np.zeros(len(prints), U64)
            for n, i in enumerate(bits[j::max_bits + 1]):
                value |= (prints >> U64(i) & U64(1)) << U64(n)
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            for some in np.split(order, cuts):
                if len(some) > 1:
                    out += [(int(some[a]), int(some[b])) for a, b in spanning(prints[some], max_bits)]
        return out
    if len(prints) <= 512:  # most small groups hold no link
        near = np.bitwise_count(prints[:, None] ^ prints) <= max_bits
        if np.count_nonzero(near) == len(prints):
            return []
    left, out = np.arange(len(prints)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                out += [(int(at), int(x)) for x in found]
                queue += found.tolist()
    return out


def _links(max_bits: int):
    """Per run of rows (key, part, print) sorted by key and part: spanning links."""
    def run(batches):
        waiting: list[np.ndarray] = []
        last = None

        def close():
            prints = np.unique(np.concatenate(waiting))
            return [(int(prints[a]), int(prints[b])) for a, b in spanning(prints, max_bits)] if len(prints) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(key)]
            out = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                now = (int(key[lo]), int(part[lo]))
                if now != last and waiting:
                    out += close()
                    waiting = []
                last = now
                waiting.append(prints[lo:hi])
            if out:
                yield _edges(out)
        if waiting and (out := close()):
            yield _edges(out)
    return run


def _edges(pairs):
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _dealt(hot: int):
    """Rows (key, print, n) to (key, part, print): of a hot bucket once per segment of 12 of the 48 bits its key's segment leaves free."""
    def run(batches):
        for b in batches:
            key, prints, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cool = n <= hot
            cols = [(key[cool], np.zeros(int(cool.sum()), np.int32), prints[cool])]
            hot_prints = prints[~cool].view(U64)
            segment = key[~cool].view(U64) >> U64(61)
            below = (U64(1) << (segment * U64(16))) - U64(1)
            free = hot_prints & below | (hot_prints >> U64(16)) & ~below
            cols += [(key[~cool], (4096 * (j + 1) + (free >> U64(12 * j) & U64(0xFFF)).astype(np.int32)).astype(np.int32), prints[~cool])
                     for j in range(4)]
            for c in cols:
                if len(c[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=["key", "part", "print"])
    return run


def links(prints: DataFrame, max_bits: int = 3, hot: int = 20_000) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``print``, signed) that connect all within ``max_bits``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the Golay keys find up to 3 differing bits")

    def keyed(batches):
        for b in batches:
            p = b.column(0).to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(p.view(U64))
            for lo in range(0, len(rows), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:lo + 200_000].view(np.int64)),
                                                  pa.array(p[rows[lo:lo + 200_000]])], names=["key", "print"])

    keys = prints.select("print").mapInArrow(keyed, "key long, print long")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = keys.join(sizes, "key")
    dealt = held.mapInArrow(_dealt(hot), "key long, part int, print long")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_links(max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, hot: int = 20_000,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint, component_id, n_copies`` of every row; ``n_copies`` counts rows with its fingerprint."""
    scratch_dir(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), shingle).view(np.int64))],
                                             names=[key, "print"])

    rows = small_batches(docs).select(key, F.col(text).cast("string").alias("__text"))
    schema = rows.select(key).schema.add("print", "long")
    marked = rows.mapInArrow(run, schema).checkpoint()
    nodes = marked.groupBy("print").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n_copies")).checkpoint()
    roots = components(links(nodes, max_bits, hot))
    nodes = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "root").select("print", "component_id", "n_copies")
    return marked.join(nodes, "print").select(
        key, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")
