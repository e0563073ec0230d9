"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and its character n-grams (3 to 6, with a space at either end) are
hashed to ``2 ** bits`` places; a place counts once however often it occurs.
Learning takes three steps: documents with each place are counted by class (a Spark
aggregation); the log ratio r of the smoothed class frequencies scales the
place, and places whose ratio is within ``z`` standard errors of none are
left out; a logistic regression with L2 penalty is fitted on the scaled places. The
model is one table of weights, and a score is the logistic of the sum over a text's places.

Defined results: NULL and empty texts score by the intercept; without labelled rows every
score is 0; with one class only, every score is its smoothed share;
repeated rows score alike; extra columns are ignored by ``score`` and pass through ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import small_batches
from tessera.llm.labelled import held_out, sample
from tessera.llm.textbytes import U64
from tessera.session import scratch_dir


@dataclass(frozen=True)
class Params:
    """``most_rows`` bounds the labelled rows learned from."""
    orders: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 20
    most_rows: int = 12_000
    alpha: float = 0.5
    z: float = 3.0
    penalty: float = 2e-4
    steps: int = 200


@dataclass
class Model:
    params: Params
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        s = np.array([self.weights[p].sum(dtype=np.float64) for p in places(texts, self.params)], float) + self.bias
        return np.clip(1 / (1 + np.exp(-np.clip(s, -700, 700))), 0, 1)


def places(texts: pa.Array, params: Params) -> Iterator[np.ndarray]:
    """The distinct places of each text."""
    slot = np.zeros(1 << params.bits, np.int32)
    runs = (texts.slice(i, 256) for i in range(0, len(texts), 256))
    for text in chain.from_iterable(pc.utf8_lower(r.cast(pa.large_string())).to_pylist() for r in runs):
        c = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
        found, h = [], np.zeros(len(c), U64)
        for n in range(1, max(params.orders) + 1):
            if n > len(c):
                break
            h = h[:len(c) - n + 1] * U64(0x9E3779B97F4A7C15) + c[n - 1:] + U64(n)
            if n in params.orders:
                found.append(((h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(64 - params.bits)).astype(np.int32))
        at = np.concatenate(found) if found else np.zeros(0, np.int32)
        order = np.arange(len(at), dtype=np.int32)
        slot[at] = order
        yield at[slot[at] == order]


def _counts(params: Params):
    def run(batches):
        n = np.zeros((2, 1 << params.bits), np.int64)
        rows = np.zeros(2, np.int64)
        for b in batches:
            for p, y in zip(places(b.column(0), params), b.column(1).to_pylist(), strict=True):
                n[y][p] += 1
                rows[y] += 1
        some = np.flatnonzero(n.any(0))
        place = np.append(some, -1)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(n[0][some], rows[0])),
                                          pa.array(np.append(n[1][some], rows[1]))], names=["place", "n0", "n1"])
    return run


def _kept(params: Params, useful: np.ndarray):
    def run(batches):
        for b in batches:
            ids = [p[useful[p]] for p in places(b.column(0), params)]
            yield pa.RecordBatch.from_arrays([pa.array([np.sort(x).tolist() for x in ids], pa.list_(pa.int32())), b.column(1)],
                                             names=["places", "label"])
    return run


def logistic(at: np.ndarray, sizes: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float, steps: int,
             block: int = 500_000) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised fit, by accelerated gradient steps. ``at``: the features of all rows, one row after the other."""
    k, ends = len(scale), np.cumsum(sizes)
    # a block of rows at a time, so that nothing as long as ``at`` is made
    cuts = np.unique(np.searchsorted(ends, np.arange(0, len(at) + block, block), "left"))
    cuts = np.unique(np.concatenate([[0], cuts, [len(sizes)]]))
    blocks = [(a, b, at[ends[a] - sizes[a]:ends[b - 1]], np.repeat(np.arange(b - a), sizes[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)
              if b > a] if len(sizes) else []

    def forward(w):
        u = scale * w
        return np.concatenate([np.bincount(r, u[i], minlength=b - a) for a, b, i, r in blocks])

    def back(g):
        out = np.zeros(k)
        for a, b, i, r in blocks:
            out += np.bincount(i, g[a:b][r], minlength=k)
        return scale * out

    v = np.ones(k)
    top = 1.0
    for _ in range(12):
        u = back(forward(v))
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    rate = 1 / ((top + len(y)) / (4 * len(y)) + penalty)
    w, b = np.zeros(k), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(forward(pw) + pb, -700, 700))) - y) / len(y)
        nw, nb = pw - rate * (back(g) + penalty * pw), pb - rate * float(g.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return w, b


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0,
          params: Params = Params(), key: str = "doc_id", text: str = "text") -> Model:
    """The model of at most ``params.most_rows`` labelled rows outside the held-out fold."""
    rows = sample(small_batches(docs), labels, label, folds, fold, params.most_rows, key, text)
    scratch_dir(docs.sparkSession)
    counts = rows.mapInArrow(_counts(params), "place long, n0 long, n1 long").groupBy("place").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).checkpoint()  # at most 2 ** bits + 1 rows
    total = counts.where("place = -1").first()
    rows0, rows1 = (total.n0, total.n1) if total else (0, 0)
    weights = np.zeros(1 << params.bits, np.float32)
    if not rows0 or not rows1:
        share = (rows1 + 0.5) / (rows0 + rows1 + 1) if rows0 + rows1 else 0.0
        return Model(params, weights, float(np.log(share / (1 - share))) if share else -1e9)
    n0, n1 = F.col("n0") + params.alpha, F.col("n1") + params.alpha
    ratio = F.log(n1 / (rows1 + 2 * params.alpha)) - F.log(n0 / (rows0 + 2 * params.alpha))
    good = counts.where("place >= 0 and n0 + n1 >= 3").where(F.abs(ratio) > params.z * F.sqrt(1 / n1 + 1 / n0)).select(
        "place", ratio.alias("ratio")).toArrow()
    place, scale = good.column("place").to_numpy(), good.column("ratio").to_numpy()
    order = np.argsort(place)
    place, scale = place[order], scale[order]
    useful = np.zeros(1 << params.bits, bool)
    useful[place] = True
    kept = rows.mapInArrow(_kept(params, useful), "places array<int>, label int").toArrow()  # at most most_rows rows, useful places only
    lists = kept.column("places").combine_chunks()
    number = np.zeros(1 << params.bits, np.int32)
    number[place] = np.arange(len(place))
    at = number[lists.flatten().to_numpy(zero_copy_only=False)]
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    w, b = logistic(at, sizes, scale, kept.column("label").to_numpy().astype(float), params.penalty, params.steps)
    weights[place] = (w * scale).astype(np.float32)
    return Model(params, weights, b)


def score(docs: DataFrame, model: Model, folds: int = 5, fold: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits weights
    rows = small_batches(docs).select(key, held_out(F.col(key), folds, fold).alias("held_out"), F.col(text).cast("string").alias("__text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.scores(b.column(2)))],
                                             names=[key, "held_out", "score"])

    schema = rows.select(key, "held_out").schema.add("score", "double")
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that score under 0.5, all columns as they are."""
    shared, where = small_batches(docs).sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(b.column(where)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
