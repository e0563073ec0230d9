"""Benchmark decontamination by spaced seeds.

Texts are lower-cased and cut into words: runs of Unicode letters, digits and the marks
on them; in scripts written without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese and
their like) every character with its marks is a word. A mask
such as ``1101101`` hashes the words at its 1s and ignores those at its 0s, so
a replaced word does not break a seed that skips it. Seeds of all masks of the
benchmark are joined with those of the documents; a hit names an item
and a diagonal (shift of item against document). Around each hit the whole
diagonal is compared word by word, and the longest stretch with at least
``identity`` equal words is the overlap. It counts from ``min_words`` words. An item
of at most ``min_words`` words is compared as a whole, replaced first and last words included;
four more masks, only for such items, leave no choice of at most a fifth replaced words without a seed.

The benchmark is the small, stated side: it is taken in blocks of at most
``block_words`` words, each broadcast in turn, so the broadcast has a bound
at any benchmark size. Documents are read once a block and never shuffled.

Defined results: NULL and empty texts overlap nothing; items with fewer words
than five words say too little and match nothing; repeated rows are reported each;
of several places with one item the longest overlap is given, then the first;
an empty benchmark or table gives an empty result; extra columns pass through ``drop_contaminated`` and are ignored by ``overlaps``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import small_batches
from tessera.llm.textbytes import U64, mixed, parts, word_bounds, word_hashes

#: Fixed masks, five compared positions each.
MASKS = ("11111", "111011", "110111", "1101101", "1011011")
#: Four compared positions each, for items of at most ``min_words`` words.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
#: Words of the shortest item that is looked for.
LEAST = 5
_WORD = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
#: Names of characters of scripts without spaces between words.
_UNSPACED = ("CJK ", "HIRAGANA ", "KATAKANA ", "HALFWIDTH KATAKANA ", "IDEOGRAPHIC ", "THAI ", "LAO ", "KHMER ", "MYANMAR ", "TIBETAN ", "YI ", "TAI ", "NEW TAI ", "BOPOMOFO ",
             "JAVANESE ", "BALINESE ", "TANGUT ", "NUSHU ", "KHITAN ", "HENTAIGANA ")
_OUTSIDE, _INSIDE, _ALONE, _MARK = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """What each code point is: no part of a word, a letter or digit, a word of its own, a mark on the character before."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "M":
            out[c] = _MARK
        elif kind[0] in "LN":
            out[c] = _ALONE if c > 0x2000 or 0xE00 <= c < 0x1800 and kind[0] == "L" else _INSIDE
    for c in np.flatnonzero(out == _ALONE).tolist():
        if not unicodedata.name(chr(c), "").startswith(_UNSPACED):
            out[c] = _INSIDE
    return out


def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Which bytes of UTF-8 are inside words, and where words are cut besides."""
    inside = _WORD[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return inside, None
    first, last = data[lead].astype(np.int64), len(data) - 1
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & (0x7F >> size)
    for k in range(1, 4):
        code = np.where(size > k, code << 6 | data[np.minimum(lead + k, last)] & 0x3F, code)
    kind = _classes()[np.minimum(code, 0x10FFFF)]
    inside[lead] = kind != _OUTSIDE
    for k in range(1, 4):
        some = size > k
        inside[np.minimum(lead[some] + k, last)] = kind[some] != _OUTSIDE
    alone = kind == _ALONE
    if not alone.any():
        return inside, None
    after = lead + size  # a word ends after a character of its own and the marks on it
    cuts = np.zeros(len(data) + 1, bool)
    cuts[lead[alone]] = True
    cuts[np.minimum(after[alone], last + 1)] = True
    for at, end in zip(lead[kind == _MARK].tolist(), after[kind == _MARK].tolist(), strict=True):
        if cuts[at]:  # a mark goes with what it stands on
            cuts[at], cuts[min(end, last + 1)] = False, True
    return inside, np.flatnonzero(cuts[:-1])


@dataclass(frozen=True)
class Rule:
    """When an overlap counts."""
    masks: tuple[str, ...] = MASKS
    short_masks: tuple[str, ...] = SHORT_MASKS
    identity: float = 0.8
    min_words: int = 13


def words_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes and their rows, a run of rows at a time."""
    for first, data, offsets in parts(pc.utf8_lower(texts.cast(pa.large_string()))):
        inside, cuts = _cut(data)
        starts, _, rows = word_bounds(inside, offsets, cuts)
        yield first, word_hashes(data, inside, starts), rows


def seeds(words: np.ndarray, rows: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the mask's seeds inside single rows."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = np.full(n, U64(len(mask)))
    for j, one in enumerate(mask):
        if one == "1":
            h = h * U64(0xD6E8FEB86659FD93) + words[j:n + j]
    at = np.flatnonzero(rows[:n] == rows[len(mask) - 1:])
    return at, mixed(h[at])


def longest_stretch(equal: np.ndarray, identity: float) -> tuple[int, int]:
    """Start and end of the longest stretch that starts and ends on an equal word and has the identity; the first of equals."""
    hits = np.flatnonzero(equal)
    if not len(hits):
        return 0, 0
    # from hit a to hit b: (b - a + 1) equal words over hits[b] - hits[a] + 1 positions
    score = np.arange(len(hits)) - identity * hits
    need = identity - 1 - 1e-9
    least = np.minimum.accumulate(score)
    best = (0, 0)
    for b in range(len(hits) - 1, -1, -1):
        if hits[b] - hits[0] + 1 <= best[1] - best[0]:
            break
        a = int(np.searchsorted(-least, -(score[b] - need), "left"))  # first a whose score is low enough
        if a <= b and hits[b] + 1 - hits[a] > best[1] - best[0]:
            best = (int(hits[a]), int(hits[b]) + 1)
    return best


#: Candidates made and words compared at a time.
CANDIDATES, COMPARED = 1 << 20, 1 << 21


@dataclass
class Index:
    """Seeds of a block of items, ready to probe."""
    ids: list
    words: list[np.ndarray]
    rule: Rule
    keys: np.ndarray = field(init=False)
    item: np.ndarray = field(init=False)
    at: np.ndarray = field(init=False)
    maybe: np.ndarray = field(init=False)
    masks: tuple[str, ...] = field(init=False)
    flat: np.ndarray = field(init=False)
    begin: np.ndarray = field(init=False)
    lengths: np.ndarray = field(init=False)

    def __post_init__(self):
        lengths = np.array([len(w) for w in self.words], np.int64)
        short = (lengths >= LEAST) & (lengths <= self.rule.min_words)
        self.masks = self.rule.masks + (self.rule.short_masks if short.any() else ())
        rows = np.repeat(np.arange(len(self.words)), lengths)
        flat = np.concatenate([*self.words, np.zeros(0, U64)])
        begin = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        found = [seeds(flat, rows, m) for m in self.masks]
        for i in range(len(self.rule.masks), len(self.masks)):
            p, h = found[i]
            found[i] = p[short[rows[p]]], h[short[rows[p]]]
        at = np.concatenate([p for p, _ in found])
        keys = np.concatenate([h for _, h in found])
        order = np.argsort(keys, kind="stable")
        self.keys, at = keys[order], at[order]
        self.item = rows[at] if len(at) else at
        self.at = at - begin[self.item] if len(at) else at
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> U64(44)] = True
        self.flat, self.begin, self.lengths, self.words = flat, begin, lengths, []

    def _candidates(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and shift of every diagonal with a seed, in order. A seed that many items share is repeated as arrays, a bounded
        number at a time, and each diagonal is kept once."""
        longest = int(self.lengths.max(initial=0))
        span, items = len(words) + longest + 1, len(self.lengths)
        known = np.zeros(0, np.int64)
        for mask in self.masks:
            at, h = seeds(words, rows, mask)
            some = self.maybe[h >> U64(44)]
            at, h = at[some], h[some]
            lo, hi = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
            hit = hi > lo
            at, lo, count = at[hit], lo[hit], (hi - lo)[hit]
            upto = np.cumsum(count)
            a = 0
            while a < len(at):
                before = upto[a] - count[a]
                b = max(a + 1, int(np.searchsorted(upto, before + CANDIDATES, "right")))
                n = count[a:b]
                place = np.repeat(lo[a:b] - (upto[a:b] - n - before), n) + np.arange(upto[b - 1] - before)
                p = np.repeat(at[a:b], n)
                diagonal = (rows[p] * items + self.item[place]) * span + (p - self.at[place] + longest)
                known = np.union1d(known, diagonal)
                a = b
        pair, shift = known // span, known % span - longest
        return pair // items, pair % items, shift

    def overlaps(self, words: np.ndarray, rows: np.ndarray) -> list[tuple]:
        """(row, item id, document word, item word, length, equal words) of each row and item that overlap."""
        if not len(self.keys) or not len(words):
            return []
        row, item, shift = self._candidates(words, rows)
        first = np.searchsorted(rows, np.arange(int(rows[-1]) + 2))
        lo = np.maximum(0, first[row] - shift)
        size = np.minimum(self.lengths[item], first[row + 1] - shift) - lo
        rule, best, known = self.rule, {}, {}
        upto = np.cumsum(size)
        a = 0
        while a < len(row):  # whole diagonals, a bounded number of words at a time
            before = upto[a] - size[a]
            b = max(a + 1, int(np.searchsorted(upto, before + COMPARED, "right")))
            n = size[a:b]
            starts = upto[a:b] - n - before
            step = np.arange(upto[b - 1] - before) - np.repeat(starts, n)
            equal = words[np.repeat(lo[a:b] + shift[a:b], n) + step] == self.flat[np.repeat(self.begin[item[a:b]] + lo[a:b], n) + step]
            same = np.add.reduceat(equal, starts, dtype=np.int64)
            least = np.minimum(rule.min_words, self.lengths[item[a:b]])
            for c in np.flatnonzero(same >= rule.identity * least - 1e-9).tolist():
                r, k, s, at = int(row[a + c]), int(item[a + c]), int(shift[a + c]), int(lo[a + c])
                mine = equal[starts[c]:starts[c] + n[c]]
                if self.lengths[k] <= rule.min_words:
                    x, y = 0, len(mine)
                else:  # items that share a passage differ from the document alike
                    pattern = mine.tobytes()
                    if pattern not in known:
                        known[pattern] = longest_stretch(mine, rule.identity)
                    x, y = known[pattern]
                if y - x >= least[c]:
                    new = (r, self.ids[k], at + x + s - int(first[r]), at + x, y - x, int(mine[x:y].sum()))
                    if (r, k) not in best or new[4] > best[r, k][4]:
                        best[r, k] = new
            a = b
        return list(best.values())


def _blocks(benchmark: DataFrame, rule: Rule, block_words: int, key: str, text: str) -> Iterator[Index]:
    """The benchmark's blocks, one on the driver at a time."""
    rows = benchmark.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") / 2)).first()[0] or 0  # a word has at least a letter and a gap
    n = max(1, -int(-total * 1.5 // block_words))
    for i in range(n):
        block = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i) if n > 1 else rows
        table = block.toArrow()
        ids, words = [], []
        for first, h, at in words_of(table.column("t").combine_chunks() if table.num_rows else pa.array([], pa.string())):
            count = int(at[-1]) + 1 if len(at) else 0
            cuts = np.searchsorted(at, np.arange(count + 1))
            for r in range(count):
                ids.append(table.column("k")[first + r].as_py())
                words.append(h[cuts[r]:cuts[r + 1]].copy())
        yield Index(ids, words, rule)


def overlaps(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), block_words: int = 2_000_000,
             key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item, doc_word, item_word, n_words, n_equal, identity`` of every overlap that counts."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, benchmark.schema[item].dataType)]
                          + [T.StructField(c, T.LongType()) for c in ("doc_word", "item_word", "n_words", "n_equal")])
    rows = small_batches(docs).select(key, F.col(text).cast("string").alias("__text"))
    out = None
    for index in _blocks(benchmark, rule, block_words, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                kind = b.schema.field(0).type
                for first, words, at in words_of(b.column(1)):
                    found = shared.value.overlaps(words, at)
                    if found:
                        cols = list(zip(*found, strict=True))
                        keys = b.column(0).take(pa.array([first + r for r in cols[0]]))
                        yield pa.RecordBatch.from_arrays([keys.cast(kind), *(pa.array(c) for c in cols[1:])],
                                                         names=[key, item, "doc_word", "item_word", "n_words", "n_equal"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out.withColumn("identity", F.col("n_equal") / F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), block_words: int = 2_000_000,
                      text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without an overlap, all columns as they are."""
    where = small_batches(docs).columns.index(text)
    for index in _blocks(benchmark, rule, block_words, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for first, words, at in words_of(b.column(where)):
                    for found in shared.value.overlaps(words, at):
                        keep[first + found[0]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
