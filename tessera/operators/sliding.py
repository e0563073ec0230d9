"""Order statistics of a sliding frame of rows.

A frame function that keeps no state sorts k values for each row. Here the rows of a group arrive in order, the
frame's values stay sorted from row to row, and a row costs one search, one insertion and one removal. Spark
deals and sorts the rows; a worker holds one frame and one Arrow batch.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.checks import as_list
from tessera.operators import hotsplit
from tessera.operators.udf import run_starts


class SlidingMedian:
    """The median of the last k rows; NULLs are rows without a value, NaN is the largest value."""

    def __init__(self, k: int):
        self.k, self.rows, self.sorted, self.nan = k, deque(), [], 0

    def push(self, x: float | None) -> float | None:
        """Take the next row; the frame's median, or None while it holds fewer than k rows or no value."""
        s = self.sorted
        self.rows.append(x)
        if x is not None:
            if x != x:
                self.nan += 1
            else:
                insort(s, x)
        if len(self.rows) > self.k:
            old = self.rows.popleft()
            if old is not None:
                if old != old:
                    self.nan -= 1
                else:
                    del s[bisect_left(s, old)]
        if len(self.rows) < self.k:
            return None
        n = len(s) + self.nan
        if not n:
            return None
        at = n >> 1
        top = s[at] if at < len(s) else float("nan")
        if n & 1:
            return top
        return (s[at - 1] + top) / 2 if at - 1 < len(s) else top


def rolling_median(df: DataFrame, by, order, col: str, k: int, ahead: int, name: str,
                   hot_rows: int | None = hotsplit.HOT_ROWS) -> DataFrame:
    """The median over the frame of k rows that ends ``ahead`` rows after each row; NULL where it is not full.

    Groups above ``hot_rows`` rows run in pieces with the rows around them (see ``hotsplit``)."""
    by = as_list(by)
    rows = hotsplit.halo_rows(df, by, order, k - 1 - ahead, ahead, hot_rows).withColumn("__value", F.col(f"`{col}`").cast("double"))
    keys = [*by, "__piece"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *hotsplit.order_spec(order))

    def run(batches):
        waiting, ready, last, state = deque(), [], None, SlidingMedian(k)
        late = 0  # rows of the group whose frame is not complete

        def close():
            nonlocal late
            ready.extend([None] * late)
            late = 0

        def drained():
            while waiting and len(ready) >= waiting[0].num_rows:
                b = waiting.popleft()
                yield b.append_column(name, pa.array(ready[:b.num_rows], pa.float64()))
                del ready[:b.num_rows]

        for b in batches:
            if not b.num_rows:
                continue
            values = b.column("__value").to_pylist()
            starts = run_starts(b, keys)
            for lo, hi in zip(starts, [*starts[1:], len(values)]):
                key = [b.column(c)[lo].as_py() for c in keys]
                if key != last:
                    close()
                    last, state = key, SlidingMedian(k)
                for x in values[lo:hi]:
                    got = state.push(x)
                    if late < ahead:
                        late += 1
                    else:
                        ready.append(got)
            waiting.append(b.drop_columns(["__value"]))
            yield from drained()
        close()
        yield from drained()

    fields = [f for f in rows.schema.fields if f.name != "__value"]
    out = rows.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))
    return out.where("__halo = 0").select(*[F.col(f"`{c}`") for c in df.columns], name)
