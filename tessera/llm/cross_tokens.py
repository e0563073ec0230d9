"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are grouped by their whole text with a count of copies; only distinct texts are tokenised by both
tokenizers and aligned. A pair of ids is linked where the byte ranges of two tokens overlap; the ranges are cut into
groups where tokens of both end. A pair's count is the number of documents that hold it linked, so each text counts as
often as it has copies. The pairs' counts then give each text its measures, which are joined to all its documents.

Where white space is only single spaces, neither tokenizer has a token across a space, and both have one ending
before it: words are aligned apart and remembered (a bounded cache), a text is the sequence of its words. Other texts
are encoded and aligned whole.

Joins stay even without a cap: of T rows to be joined, fewer than M keys have more than T / M rows each. These
are broadcast; the rest is joined by a shuffle in which no key has more (``join_by_count``).

Defined results: a text that is NULL, empty or not given back exactly by both tokenizers has no tokens; its numbers are 0
and its groups ``''``. Rows with one text have the same measures, whatever their ids; a NULL id is kept. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.batches import small_batches
from tessera.llm.tokens import byte_letters
from tessera.session import scratch_path

#: White space before a space or at the end: tokens can cross or end there in another way.
_WHOLE = re.compile(r"\s | \Z")
#: Longer stretches without a space are not remembered.
_LONG = 64
#: Keys that a broadcast holds at most.
MOST_PAIRS, MOST_TEXTS = 1_000_000, 100_000


def align(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> tuple[str, list[int]]:
    """Groups as ``a1,a2|b1;a3|b2`` and the linked pairs ``a << 32 | b`` in order; the sizes have one sum."""
    groups, links = [], []
    i = j = from_i = from_j = 0
    end_a, end_b = a_sizes[0], b_sizes[0]
    while True:
        links.append(a[i] << 32 | b[j])
        if end_a == end_b:
            groups.append(",".join(map(str, a[from_i:i + 1])) + "|" + ",".join(map(str, b[from_j:j + 1])))
            from_i = i = i + 1
            from_j = j = j + 1
            if i == len(a):
                return ";".join(groups), links
            end_a += a_sizes[i]
            end_b += b_sizes[j]
        elif end_a < end_b:
            i += 1
            end_a += a_sizes[i]
        else:
            j += 1
            end_b += b_sizes[j]


#: Of a stretch: tokens of A and of B, groups, links, the groups as text, the links' pairs as 8 bytes each.
Aligned = tuple[int, int, int, int, str, bytes]


class Aligner:
    """Aligns a byte-level BPE file of ``tokenizers`` (A) with a ``sentencepiece`` model that adds a space (B)."""

    def __init__(self, path_a: str, path_b: str, most: int = 150_000):
        import sentencepiece
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: n for n, c in byte_letters().items()}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, n in vocabulary.items():
            self.bytes_a[n] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes_b = [bytes([int(self.b.id_to_piece(n)[3:-1], 16)]) if self.b.is_byte(n) else self.b.id_to_piece(n).replace("▁", " ").encode()
                        for n in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.names = [str(n) for n in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.most, self.known, self.older = most, {}, {}

    def _aligned(self, spaced: str, a: list[int], b: list[int]) -> Aligned | None:
        raw = spaced.encode()
        parts_a, parts_b = [self.bytes_a[n] for n in a], [self.bytes_b[n] for n in b]
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return None
        groups, links = align(a, list(map(len, parts_a)), b, list(map(len, parts_b)))
        return len(a), len(b), groups.count(";") + 1, len(links), groups, np.array(links, np.int64).tobytes()

    def whole(self, text: str) -> Aligned | None:
        """A text aligned in one piece."""
        return self._aligned(" " + text, self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text))

    def _learn(self, words: list[str]) -> dict[str, Aligned | None]:
        """Words not yet known, aligned together: their tokens follow each other as those of one text, and both have an end at each word's."""
        spaced = [" " + w for w in words]
        a, b = [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)], self.b.encode(words)
        all_a, all_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        sizes = np.array([len(w.encode()) for w in spaced], np.int64)
        raw = "".join(spaced).encode()
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ids_a, ids_b = np.array(all_a, np.int64), np.array(all_b, np.int64)
        ends_a, ends_b, ends = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]), np.cumsum(sizes)
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        if not (n_a.all() and n_b.all() and np.array_equal(ends_a[last_a - 1], ends) and np.array_equal(ends_b[last_b - 1], ends)
                and b"".join([self.bytes_a[n] for n in all_a]) == raw and b"".join([self.bytes_b[n] for n in all_b]) == raw):
            half = len(words) // 2  # some word is not given back; the others are found together
            if half < 4:
                return {w: self._aligned(s, x, y) for w, s, x, y in zip(words, spaced, a, b, strict=True)}
            return self._learn(words[:half]) | self._learn(words[half:])
        # between two neighbouring ends lies one pair of tokens; where both end, a group
        cuts = np.union1d(ends_a, ends_b)
        pairs = (ids_a[np.searchsorted(ends_a, cuts)] << 32 | ids_b[np.searchsorted(ends_b, cuts)]).tobytes()
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        names = self.names
        text_a, text_b = [names[n] for n in all_a], [names[n] for n in all_b]
        upto_a, upto_b = (np.searchsorted(e, both, "right").tolist() for e in (ends_a, ends_b))
        groups = [(text_a[p] if q - p == 1 else ",".join(text_a[p:q])) + "|" + (text_b[r] if t - r == 1 else ",".join(text_b[r:t]))
                  for p, q, r, t in zip([0, *upto_a], upto_a, [0, *upto_b], upto_b)]
        links, of_groups = np.searchsorted(cuts, ends, "right").tolist(), np.searchsorted(both, ends, "right").tolist()
        return {w: (x, y, h - g, v - u, groups[g] if h - g == 1 else ";".join(groups[g:h]), pairs[8 * u:8 * v])
                for w, x, y, g, h, u, v in zip(words, n_a.tolist(), n_b.tolist(), [0, *of_groups], of_groups, [0, *links], links)}

    def texts(self, texts: list[str]) -> list[Aligned | None]:
        """All texts, in order; None for one without tokens."""
        split = [None if not t or _WHOLE.search(" " + t) else t.split(" ") for t in texts]
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, new = self.known, {}
        for words in split:
            for w in words or ():
                if w not in known:
                    if w in self.older:
                        known[w] = self.older[w]
                    else:
                        new[w] = None
        if new:
            new = self._learn(list(new))
            known.update((w, x) for w, x in new.items() if len(w) <= _LONG)
        out = []
        for text, words in zip(texts, split, strict=True):
            if not text:
                out.append(None)
            elif words is None:
                out.append(self.whole(text))
            else:
                got = [known[w] if w in known else new[w] for w in words]
                if None in got:
                    out.append(None)
                else:
                    n_a, n_b, n_groups, n_links, groups, pairs = zip(*got, strict=True)
                    out.append((sum(n_a), sum(n_b), sum(n_groups), sum(n_links), ";".join(groups), b"".join(pairs)))
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_for(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of two files, kept for its next tasks."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_TEXTS = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
#: Texts aligned at a time: bytes of a run.
_RUN = 1 << 21


def _runs(texts: list[str]):
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _RUN:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _aligned_rows(aligner: Callable[[], Aligner]):
    def run(batches):
        tool = aligner()
        for b in batches:
            whole = b.column(1).to_pylist()
            for lo, hi in _runs(whole):
                texts, copies = whole[lo:hi], b.column(0).slice(lo, hi - lo)
                numbers, groups, pairs, times, sizes = [], [], [], [], [0]
                for x in tool.texts(texts):
                    if x is None:
                        numbers.append((0, 0, 0, 0))
                        groups.append("")
                        sizes.append(sizes[-1])
                        continue
                    numbers.append(x[:4])
                    groups.append(sha256(x[4].encode()).hexdigest())
                    distinct, counts = np.unique(np.frombuffer(x[5], np.int64), return_counts=True)
                    pairs.append(distinct)
                    times.append(counts.astype(np.int32))
                    sizes.append(sizes[-1] + len(distinct))
                offsets = pa.array(sizes, pa.int32())
                pairs = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
                times = np.concatenate(times) if times else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sha256(t.encode()).digest() for t in texts], pa.binary()), copies, *(pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)),
                     pa.array(groups), pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times))],
                    names=[c.split()[0] for c in _TEXTS.split(", ")])
    return run


def join_by_count(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, most: int) -> DataFrame:
    """``rows`` joined to ``table``, whose column ``count`` says how many of the ``total`` rows have each key.

    Keys of more than ``total / most`` rows are fewer than ``most`` and are broadcast; no other key fills a task."""
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), key)
    hot = F.col(count) > total / most
    often = table.where(hot)
    return rows.join(F.broadcast(often), key).unionByName(
        rows.join(F.broadcast(often.select(key)), key, "left_anti").join(table.where(~hot), key))


@dataclass
class Alignment:
    """``texts``: one row per distinct text (key: SHA-256 of it); ``pairs``: ``pair, a_id, b_id, documents, texts, best``;
    ``documents``: measures of every row."""
    texts: DataFrame
    pairs: DataFrame
    documents: DataFrame


def align_documents(df: DataFrame, aligner: Callable[[], Aligner], key: str = "doc_id", text: str = "text",
                    most_pairs: int = MOST_PAIRS, most_texts: int = MOST_TEXTS) -> Alignment:
    """Align the texts of a table; ``best`` pairs have the highest count of their id of A, ties included."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    path = scratch_path(spark, "aligned-texts")
    (small_batches(docs).groupBy("__text").agg(F.count(F.lit(1)).alias("copies")).select("copies", "__text")
     .mapInArrow(_aligned_rows(aligner), _TEXTS).write.parquet(path))
    texts = spark.read.parquet(path)

    linked = texts.select("key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                          F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "*", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).drop("x")
    pairs = linked.groupBy("pair").agg(F.sum("copies").alias("documents"), F.count(F.lit(1)).alias("texts"))
    pairs = pairs.withColumn("a_id", F.shiftright("pair", 32))
    # an id of A has at most as many pairs as B has ids
    most = F.max("documents").over(Window.partitionBy("a_id"))
    pairs = pairs.select("pair", "a_id", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "documents", "texts",
                         (F.col("documents") == most).alias("best")).checkpoint()

    total = pairs.agg(F.sum("texts")).first()[0] or 0
    numbers = ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    weighed = join_by_count(linked, pairs.select("pair", "documents", "texts", "best"), "pair", "texts", total, most_pairs)
    measures = weighed.groupBy(*numbers).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("documents")).cast("long").alias("count_sum"))
    zero = F.lit(0).cast("long")
    measures = measures.unionByName(texts.where("n_a = 0").select(*numbers, zero.alias("n_best"), zero.alias("count_sum"))).checkpoint()

    keyed = docs.select(key, F.unhex(F.sha2("__text", 256)).alias("__key"))
    rows = df.sparkSession.read.parquet(_written(keyed, "document-texts"))
    total = texts.agg(F.sum("copies")).first()[0] or 0
    out = join_by_count(rows, measures.withColumnRenamed("key", "__key"), "__key", "copies", total, most_texts)
    return Alignment(texts, pairs, out.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def _written(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path
