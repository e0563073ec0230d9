"""Exact top-k inner products with KD-trees, one per shard.

Vectors are dealt to shards by a hash of their id, as many as keep a shard near
``shard_rows`` vectors. Each shard builds a KD-tree: median splits of the widest side,
a tight bounding box at every node. A query bounds a box from above by the
sum over components of max(q * low, q * high), walks a shard's nodes best bound first, and stops when the best
bound left is below its k-th score. That score is propagated: a first shard is
searched alone, its k-th scores start the search of all others, and a task
hands them on from shard to shard.

Equal vectors of a shard are one point with its k + 1 least ids (more can't be among the k
best, since ties go to smaller ids). Queries are a stated set; they are taken in blocks
of at most about ``block`` vectors. A block is broadcast, searched, ranked, appended to the result's folder and dropped before the
next one, so the broadcast has a bound at any size and no pairs of rows are formed. Where there are fewer shards than
cores, a shard is searched by several tasks, each with a part of the block's queries.

Defined results: vectors NULL or with NULL or non-finite components, and rows with a NULL id, take no part; of rows
that share an id the least vector counts; only vectors of one length are
compared; a component or score beyond 64 bits counts as the nearest number of 64 bits (such ties, too, go to smaller ids); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

RESULT = "query_id long, vec_id long, score long"
RANKED = "query_id long, rank int, vec_id long, score long"
#: The bounds of a score.
LEAST, MOST = -2 ** 63, 2 ** 63 - 1
#: Tasks that share a shard at most.
MOST_PARTS = 16


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; NULL for a vector that takes no part."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


@dataclass
class Tree:
    """Points in leaf order, their ids (k + 1 at most each), and nodes with boxes."""
    points: np.ndarray
    ids: list[tuple]
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    span: np.ndarray


def build(ids: np.ndarray, points: np.ndarray, k: int, leaf: int = 128) -> Tree:
    """The tree of one shard."""
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    points, back = np.unique(points, axis=0, return_inverse=True)
    groups: list[list] = [[] for _ in range(len(points))]
    for i, g in zip(ids.tolist(), back.ravel().tolist(), strict=True):
        if len(groups[g]) <= k:
            groups[g].append(i)
    at = np.arange(len(points))
    low, high, child, span = [], [], [], []

    def node(lo: int, hi: int) -> int:
        me, part = len(low), points[at[lo:hi]]
        low.append(part.min(0))
        high.append(part.max(0))
        child.append((-1, -1))
        span.append((lo, hi))
        if hi - lo > leaf and part.shape[1]:
            side = int(np.argmax(high[me] - low[me]))
            mid = (hi - lo) // 2
            at[lo:hi] = at[lo:hi][np.argpartition(part[:, side], mid)]
            child[me] = (node(lo, lo + mid), node(lo + mid, hi))
        return me

    node(0, len(points))
    return Tree(points[at], [tuple(groups[g]) for g in at], np.array(low), np.array(high), np.array(child), np.array(span))


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[list[tuple]]:
    """Per query, up to k (-score, id) of the shard that can still be among the best k; kth is a score already reached."""
    most = max(1, int(np.abs(tree.points).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * max(1, queries.shape[1])
    kind = np.float64 if most < 2 ** 53 else object  # floats hold these whole numbers exactly
    points, q = tree.points.astype(kind), queries.astype(kind)
    bounds = np.maximum(q, 0) @ tree.high.astype(kind).T + np.minimum(q, 0) @ tree.low.astype(kind).T
    out = []
    for me, own, bound, floor in zip(q, query_ids.tolist(), bounds, kth, strict=True):
        best: list[tuple] = []
        floor = None if floor is None else int(floor)
        heap = [(-bound[0], 0)]
        while heap:
            b, at = heapq.heappop(heap)
            if floor is not None and -b < floor:
                break
            left, right = tree.child[at]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            lo, hi = tree.span[at]
            scores = points[lo:hi] @ me
            some = np.arange(hi - lo) if floor is None else np.flatnonzero(scores >= floor)
            if not len(some):
                continue
            for j in some.tolist():
                s = min(max(int(scores[j]), LEAST), MOST)
                best += [(-s, i) for i in tree.ids[lo + j] if i != own]
            best = heapq.nsmallest(k, best)
            if len(best) == k:
                floor = max(floor, -best[-1][0]) if floor is not None else -best[-1][0]
        out.append(best)
    return out


def _build(k: int):
    def run(key, table):
        ids = table.column("vec_id").to_numpy()
        size = key[0].as_py()
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        tree = build(ids, flat.reshape(len(ids), size), k)
        return pa.table({"size": pa.array([size], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()),
                         "tree": pa.array([pickle.dumps(tree)], pa.binary())})
    return run


def _search(shared, k: int):
    """shared: per vector length, query ids, queries and the scores they have reached. A row of the index names the queries it is for."""
    def run(batches):
        held = {size: (ids, q, list(kth)) for size, (ids, q, kth) in shared.value.items()}
        for b in batches:
            for size, part, parts, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if size not in held:
                    continue
                ids, q, kth = held[size]
                own = np.arange(part, len(ids), parts)
                rows = []
                for n, best in zip(own.tolist(), search(pickle.loads(blob.as_py()), ids[own], q[own], [kth[n] for n in own], k), strict=True):
                    rows += [(int(ids[n]), i, -s) for s, i in best]
                    if len(best) == k:
                        kth[n] = -best[-1][0] if kth[n] is None else max(kth[n], -best[-1][0])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                     names=["query_id", "vec_id", "score"])
    return run


def top_k(table: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding",
          shard_rows: int = 32_768, block: int = 16_384) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of each query, the rows whose id is divisible by ``every``."""
    spark = table.sparkSession
    path = scratch_path(spark, "kd-top")
    rows = (table.select(F.col(key).cast("long").alias("vec_id"), whole_numbers(F.col(vector)).alias("vector"))
            .where("vec_id is not null and vector is not null")
            .groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector")).checkpoint())
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, queries = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-queries // block))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    index = (rows.withColumn("shard", shard).groupBy("size", "shard")
             .applyInArrow(_build(k), "size int, shard long, tree binary").checkpoint())
    cores = spark.sparkContext.defaultParallelism

    def tasks(which, n_shards: int) -> DataFrame:
        """The shards, each as often as tasks share it."""
        parts = max(1, min(MOST_PARTS, -(-cores // n_shards)))
        dealt = index.where(which).select("size", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(parts).alias("parts"), "tree")
        return dealt.repartition(max(1, min(n_shards * parts, 4096)), "shard", "part").select("size", "part", "parts", "tree")

    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == i).toArrow()
        held = {}
        for size in set(part.column("size").to_pylist()):
            mine = part.filter(pc.equal(part.column("size"), size))
            flat = mine.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ids = mine.column("vec_id").to_numpy()
            held[size] = (ids, flat.reshape(len(ids), size), [None] * len(ids))
        shared = [spark.sparkContext.broadcast(held)]
        found = first = tasks("shard = 0", 1).mapInArrow(_search(shared[0], k), RESULT).checkpoint()
        if shards > 1:
            reached = first.groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
            kth = {r[0]: r[1] for r in reached.select("query_id", "s").collect()}  # one number for each query of the block
            shared.append(spark.sparkContext.broadcast(
                {size: (ids, q, [kth.get(x) for x in ids.tolist()]) for size, (ids, q, _) in held.items()}))
            found = first.unionAll(tasks("shard > 0", shards - 1).mapInArrow(_search(shared[1], k), RESULT))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
         .select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path))
        for b in shared:
            b.destroy()
    return spark.read.schema(RANKED).parquet(path)
