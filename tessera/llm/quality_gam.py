"""Quality: a generalised additive model with pairwise interactions.

Every text becomes a few numbers (``FEATURES``). Each feature has a lookup table over
quantile bins; cyclic boosting visits the features in turn and adds a small step of a
shallow tree (at most four leaves) fitted to the current gradients, so each table stays a function
of one feature. The pairs whose coarse grids explain most of what is left get a table
of their own, boosted likewise with trees that cut one feature and then the
other on either side. A score is the logistic of a sum of table cells.

Defined results: NULL and empty texts have the features of no words; without labelled rows every
score is 0.5; with one class only, its smoothed share; repeated rows score
alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import small_batches
from tessera.llm.labelled import held_out, sample
from tessera.llm.textbytes import U64, parts, word_bounds, word_hashes

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "symbol", "stop_mark", "other_mark", "space", "line",
            "high_byte", "distinct_words", "repeated_words", "distinct_pairs", "distinct_lines", "line_bytes", "marked_words")

#: Fixed classes of bytes: 0 other, 1 upper, 2 lower, 3 digit, 4 symbol, 5 sentence mark, 6 other mark, 7 space, 8 line end, 9 above ASCII.
_KIND = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (9 if _b > 127 else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _c in "#$%&*+<=>@^_~|\\/{}[]"
                 else 5 if _c in ".,;:?" else 6 if _c in "!\"'()-`" else 8 if _c == "\n" else 7 if _c.isspace() else 0)


@dataclass(frozen=True)
class Params:
    """``most_rows`` bounds the labelled rows learned from."""
    most_rows: int = 20_000
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 6
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.15
    penalty: float = 5.0


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many different values each row has."""
    key = (rows.astype(U64) << U64(40)) | (values >> U64(24))
    return np.bincount((np.unique(key) >> U64(40)).astype(np.int64), minlength=n)[:n]


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, data, offsets in parts(texts):
        n, size = len(offsets) - 1, np.diff(offsets)
        kind = _KIND[data]
        row = np.repeat(np.arange(n), size)
        count = np.bincount(row * 10 + kind, minlength=10 * n).reshape(n, 10)
        inside = (kind != 7) & (kind != 8)
        starts, ends, rows = word_bounds(inside, offsets)
        h = word_hashes(data, inside, starts)
        words = np.bincount(rows, minlength=n)
        same = (rows[1:] == rows[:-1]) if len(rows) else np.zeros(0, bool)
        repeated = np.bincount(rows[1:][same & (h[1:] == h[:-1])], minlength=n) if len(rows) else np.zeros(n)
        marked = np.bincount(rows[(kind[ends - 1] == 4) | (kind[ends - 1] == 6)], minlength=n) if len(rows) else np.zeros(n)
        pairs = np.bincount(rows[1:][same], minlength=n) if len(rows) else np.zeros(n)
        pair_hash = (h[1:] * U64(0x9E3779B97F4A7C15) + h[:-1] * U64(0xBF58476D1CE4E5B9))[same] if len(rows) else h
        line_inside = kind != 8
        ls, _, lrows = word_bounds(line_inside, offsets)
        lh = word_hashes(data, line_inside, ls)
        lines = np.bincount(lrows, minlength=n)
        w, s, ln, pr = (np.maximum(x, 1) for x in (words, size, lines, pairs))
        share = count / s[:, None]
        out[first:first + n] = np.stack([
            np.log1p(size), np.log1p(words), (size - count[:, 7] - count[:, 8]) / w, share[:, 1], share[:, 2], share[:, 3], share[:, 4],
            share[:, 5], share[:, 6], share[:, 7], share[:, 8], share[:, 9],
            _distinct(rows, h, n) / w, repeated / w, (_distinct(rows[1:][same], pair_hash, n) if len(rows) else np.zeros(n)) / pr,
            _distinct(lrows, lh, n) / ln, size / ln, marked / w], axis=1)
    return out


def _leaf(g, h, penalty):
    return -g / (h + penalty)


def _cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """Best gain and place (bins before it go left) of one cut of a histogram."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    if not len(gl):
        return 0.0, 0
    gain = gl ** 2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt ** 2 / (ht + penalty)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    """A tree of depth two over the bins of one feature: the step for each bin."""
    step = np.full(len(g), _leaf(g.sum(), h.sum(), penalty))
    gain, k = _cut(g, h, penalty)
    if gain <= 0:
        return step
    for lo, hi in ((0, k), (k, len(g))):
        inner, j = _cut(g[lo:hi], h[lo:hi], penalty)
        spans = ((lo, lo + j), (lo + j, hi)) if inner > 0 else ((lo, hi),)
        for a, b in spans:
            step[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), penalty)
    return step


def pair_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and steps of a tree that cuts one feature of a grid, then the other on either side."""
    best = (0.0, np.zeros_like(g))
    base = g.sum() ** 2 / (h.sum() + penalty)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, a.shape[0]):
            step, gain = np.zeros_like(a), -base
            for lo, hi in ((0, k), (k, a.shape[0])):
                gs, hs = a[lo:hi].sum(0), b[lo:hi].sum(0)
                _, j = _cut(gs, hs, penalty)
                for x, y in ((0, j), (j, len(gs))):
                    if y > x:
                        step[lo:hi, x:y] = _leaf(gs[x:y].sum(), hs[x:y].sum(), penalty)
                        gain += gs[x:y].sum() ** 2 / (hs[x:y].sum() + penalty)
            if gain > best[0]:
                best = (float(gain), step.T if flip else step)
    return best


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            s += t[np.searchsorted(e, x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            s += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return np.clip(1 / (1 + np.exp(-np.clip(s, -700, 700))), 0, 1)


def fit(x: np.ndarray, y: np.ndarray, p: Params = Params()) -> Model:
    """Cyclic boosting of the tables on rows of features and 0/1 labels."""
    k = x.shape[1]

    def cuts(n):
        return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(k)]

    edges, coarse = cuts(p.bins), cuts(p.pair_bins)
    tables, pairs, pair_tables = [np.zeros(len(e) + 1) for e in edges], [], []
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(share / (1 - share))), edges, tables, coarse, pairs, pair_tables)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    s = np.full(len(y), bias)

    def slopes():
        q = 1 / (1 + np.exp(-s))
        return q - y, q * (1 - q)

    for _ in range(p.rounds):
        for j in range(k):
            g, h = slopes()
            n = len(tables[j])
            step = p.rate * tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), p.penalty)
            tables[j] += step
            s += step[at[j]]
    low = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    grid = {}

    def histogram(i, j):
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = grid.setdefault((i, j), low[i] * b + low[j])
        g, h = slopes()
        return np.bincount(cell, g, a * b).reshape(a, b), np.bincount(cell, h, a * b).reshape(a, b)

    gains = sorted(((pair_tree(*histogram(i, j), p.penalty)[0], i, j) for i, j in combinations(range(k), 2)), reverse=True)
    pairs = [(i, j) for gain, i, j in gains[:p.pairs] if gain > 0]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(p.pair_rounds):
        for t, (i, j) in zip(pair_tables, pairs, strict=True):
            step = p.rate * pair_tree(*histogram(i, j), p.penalty)[1]
            t += step
            s += step.ravel()[grid[i, j]]
    return Model(bias, edges, tables, coarse, pairs, pair_tables)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1,
          params: Params = Params(), key: str = "doc_id", text: str = "text") -> Model:
    """The model of at most ``params.most_rows`` labelled rows outside the held-out fold; features are made on the executors."""
    names = [f"f{j}" for j in range(len(FEATURES))]

    def run(batches):
        for b in batches:
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, j]) for j in range(x.shape[1])] + [b.column(1)], names=[*names, "label"])

    rows = sample(small_batches(docs), labels, label, folds, fold, params.most_rows, key, text).mapInArrow(
        run, ", ".join(f"{c} double" for c in names) + ", label int").toArrow()  # at most most_rows rows
    x = np.stack([rows.column(c).to_numpy() for c in names], axis=1)
    y = rows.column("label").to_numpy().astype(float)
    order = np.lexsort([y, *x.T])  # sums come out alike whatever order the rows arrive in
    return fit(x[order], y[order], params)


def score(docs: DataFrame, model: Model, folds: int = 3, fold: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""
    rows = small_batches(docs).select(key, held_out(F.col(key), folds, fold).alias("held_out"), F.col(text).cast("string").alias("__text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.scores(features(b.column(2))))],
                                             names=[key, "held_out", "score"])

    schema = rows.select(key, "held_out").schema.add("score", "double")
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
