"""User-defined functions on the Arrow-batched (vectorised) path.

* ``row_map``: a pandas Series -> Series function over a column (scalar
  ``pandas_udf``); rows travel in Arrow batches, never one at a time.
* ``group_map``: a function per group. With ``combine`` it runs on the map side, on the runs
  of a group within the batches of a task, and only its partial rows are shuffled; a function of all runs of a batch at once
  (``arrow_runs``) costs no Python call per group. Without, the group goes to one
  worker: at once (``pandas``, ``arrow``) or as an iterator of batches (``pandas_batches``, ``arrow_batches``),
  which holds one batch of a group of any size.
* ``group_reduce``: a Series -> scalar function per group, with the same two ways.

No plan depends on the number of rows. Prefer built-in functions whenever they can express the computation.
"""

# no postponed annotations here: Spark reads the type hints of the functions
# below to choose the kind of user function
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.checks import as_list, require_columns


def row_map(df: DataFrame, col: str, fn, return_type: str = "double", name: str | None = None) -> DataFrame:
    require_columns(df, col)
    u = pandas_udf(fn, return_type)
    return df.withColumn(name or f"{col}_mapped", u(F.col(col)))


GROUP_KINDS = ("pandas", "arrow", "pandas_batches", "arrow_batches", "arrow_runs")


def group_map(df: DataFrame, by, fn, schema: str, kind: str = "pandas", combine=None,
              combine_schema: str | None = None) -> DataFrame:
    """``kind='pandas'``: fn(pandas.DataFrame) -> pandas.DataFrame; ``'arrow'``:
    fn(pyarrow.Table) -> pyarrow.Table, without the pandas conversion. Either holds a whole group.
    ``'pandas_batches'`` and ``'arrow_batches'``: fn(iterator of DataFrames or RecordBatches) -> iterator of them,
    called once per group, whose batches arrive one after another.

    With ``combine`` (kinds ``pandas``, ``arrow`` and ``arrow_runs``): split-apply-combine in two levels. Each task sorts its rows by the
    group and calls ``fn`` on every run of one group within an Arrow batch, so before anything is
    shuffled and with one batch in memory; ``fn`` returns partial rows (``schema``), which hold the group columns. With
    ``'arrow_runs'`` it is fn(pyarrow.Table, starts) -> pyarrow.Table, called once per batch with where in it the runs start: for many
    small groups, whose calls one by one would cost far more than the work in them. ``combine`` runs per group
    on its partial rows and returns ``combine_schema``; with no ``combine_schema`` it is a DataFrame -> DataFrame
    function over all partial rows (a Spark aggregation, no second Python pass). A group's runs depend
    on how its rows lie, so ``fn`` and ``combine`` must give the same for any cut of the group."""
    by = as_list(by)
    require_columns(df, *by)
    if kind not in GROUP_KINDS:
        raise ValueError(f"kind={kind!r}")
    if combine is None:
        if kind == "arrow_runs":
            raise ValueError("the kind arrow_runs needs combine")
        grouped = df.groupBy(*by)
        if kind == "pandas":
            return grouped.applyInPandas(fn, schema)
        if kind == "arrow":
            return grouped.applyInArrow(fn, schema)
        if kind == "pandas_batches":
            def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                yield from fn(batches)
            return grouped.applyInPandas(frames, schema)

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from fn(batches)
        return grouped.applyInArrow(records, schema)
    if kind not in ("pandas", "arrow", "arrow_runs"):
        raise ValueError("combine takes the kinds pandas, arrow and arrow_runs")
    partial = _map_runs(df, by, fn, schema, kind)
    if combine_schema is None:
        return combine(partial)
    grouped = partial.groupBy(*by)
    return grouped.applyInPandas(combine, combine_schema) if kind == "pandas" else grouped.applyInArrow(combine, combine_schema)


def run_starts(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where in a batch a row's keys differ from those of the row before it; NULL equals NULL."""
    n = batch.num_rows
    if not n:
        return []
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        c = batch.column(k)
        if pa.types.is_nested(c.type):
            values = c.to_pylist()
            new[1:] |= [a != b for a, b in zip(values, values[1:])]
            continue
        a, b = c.slice(0, n - 1), c.slice(1)
        both = pc.fill_null(pc.not_equal(a, b), False)
        new[1:] |= pc.or_(both, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new).tolist()


def _map_runs(df: DataFrame, by: list[str], fn, schema: str, kind: str) -> DataFrame:
    """fn on every run of one group within the batches of each task, after a sort inside the task."""
    want = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = run_starts(batch, by)
            if kind == "arrow_runs":
                yield from fn(pa.Table.from_batches([batch]), np.array(starts)).select(want.names).cast(want).combine_chunks().to_batches()
                continue
            out = []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                rows = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if kind == "arrow":
                    out.append(fn(rows).select(want.names).cast(want))
                else:
                    out.append(pa.Table.from_pandas(fn(rows.to_pandas()), schema=want, preserve_index=False))
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return (df.sortWithinPartitions(*by) if by else df).mapInArrow(run, schema)


def group_reduce(df: DataFrame, by, col: str, fn, return_type: str = "double", name: str = "value",
                 combine=None, batches: bool = False) -> DataFrame:
    """Series -> scalar user aggregate per group.

    With ``combine`` (a Series -> scalar function over partial results) the reduction is two-level: ``fn`` runs on
    the runs of a group within the batches of each task, before the shuffle, and ``combine`` reduces the partial
    values. This needs a decomposable ``fn`` (sum, max, sum of logs, ...). With ``batches`` ``fn`` takes an iterator of
    Series, the batches of a group one after another, and returns the scalar; no worker holds the group.
    Otherwise a whole group goes to one worker (a grouped-aggregate pandas UDF)."""
    by = as_list(by)
    require_columns(df, col, *by)
    data = df.select(*by, F.col(col).alias("__value"))
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in data.schema.fields if f.name != "__value"]
    if combine is not None:
        def partial(rows: pa.Table) -> pa.Table:
            value = fn(rows.column("__value").to_pandas())
            return rows.slice(0, 1).drop_columns(["__value"]).append_column("__part", pa.array([value]))

        parts = _map_runs(data, by, partial, ", ".join([*keys, f"__part {return_type}"]), "arrow")
        c = pandas_udf(combine, return_type)
        return parts.groupBy(*by).agg(c(F.col("__part")).alias(name))
    if batches:
        schema = ", ".join([*keys, f"`{name}` {return_type}"])
        want = to_arrow_schema(T.StructType.fromDDL(schema))

        def whole(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = []

            def series():
                for b in frames:
                    if not first:
                        first.append(b.slice(0, 1).select(by))
                    yield b.column("__value").to_pandas()
            value = fn(series())
            for _ in frames:  # what fn left unread
                pass
            if first:
                yield pa.RecordBatch.from_arrays([*first[0].columns, pa.array([value])], names=want.names).cast(want)
        return data.groupBy(*by).applyInArrow(whole, schema)
    u = pandas_udf(fn, return_type)  # Series -> scalar: a grouped aggregate UDF
    return df.groupBy(*by).agg(u(F.col(col)).alias(name))


# -- ready-made functions used by the registered queries --------------------
def ols_slope_per_group_arrow(x: str, y: str, key: str):
    """Group function: slope of y on x (population covariance / variance)."""
    def fn(tbl: pa.Table) -> pa.Table:
        xv = tbl.column(x).to_numpy().astype(float)
        yv = tbl.column(y).to_numpy().astype(float)
        n = len(xv)
        slope = None
        if n > 1:
            dx = xv - xv.mean()
            vx = (dx * dx).mean()
            if vx > 0:
                slope = float((dx * (yv - yv.mean())).mean() / vx)
        return pa.table({key: tbl.column(key).slice(0, 1), "n": pa.array([n], pa.int64()),
                         "slope": pa.array([slope], pa.float64())})
    return fn


def sum_of_logs(s: pd.Series) -> float:
    """Decomposable user aggregate: sum of natural logs (log of the product)."""
    return float(np.log(s.dropna().to_numpy(dtype=float)).sum())


def plain_sum(s: pd.Series) -> float:
    return float(s.dropna().sum())


MOMENT_SCHEMA = "n long, sx double, sy double, sxx double, sxy double"


def ols_moments_runs(x: str, y: str, key: str, shift_x: float = 0.0, shift_y: float = 0.0):
    """Function of all runs of a batch: per run its row count and the sums needed for a slope (x and y
    shifted by constants to keep the sums small)."""
    def fn(tbl: pa.Table, starts: np.ndarray) -> pa.Table:
        xv = tbl.column(x).to_numpy().astype(float) - shift_x
        yv = tbl.column(y).to_numpy().astype(float) - shift_y
        sums = {n: np.add.reduceat(v, starts) for n, v in (("sx", xv), ("sy", yv), ("sxx", xv * xv), ("sxy", xv * yv))}
        return pa.table({key: tbl.column(key).take(pa.array(starts)), "n": np.diff(starts, append=len(xv)), **sums})
    return fn


def ols_moments_arrow(x: str, y: str, key: str, shift_x: float = 0.0, shift_y: float = 0.0):
    """Sub-group function: the same of one run."""
    runs = ols_moments_runs(x, y, key, shift_x, shift_y)
    return lambda tbl: runs(tbl, np.zeros(1, int))


def ols_slope_combine_arrow(key: str):
    """Group function over the partial sums: count and slope (NULL when x has
    no spread)."""
    def fn(tbl: pa.Table) -> pa.Table:
        n = pc.sum(tbl.column("n")).as_py()
        sx, sy = pc.sum(tbl.column("sx")).as_py(), pc.sum(tbl.column("sy")).as_py()
        sxx, sxy = pc.sum(tbl.column("sxx")).as_py(), pc.sum(tbl.column("sxy")).as_py()
        vx = sxx - sx * sx / n
        slope = (sxy - sx * sy / n) / vx if n > 1 and vx > 1e-9 * max(1.0, sxx) else None
        return pa.table({key: tbl.column(key).slice(0, 1), "n": pa.array([n], pa.int64()),
                         "slope": pa.array([slope], pa.float64())})
    return fn


def ols_slope_combine_spark(key: str):
    """DataFrame combine over the partial sums: count and slope, in Spark."""
    def fn(partial: DataFrame) -> DataFrame:
        s = partial.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
        n = F.col("n")
        vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
        ok = (n > 1) & (vx > F.lit(1e-9) * F.greatest(F.lit(1.0), F.col("sxx")))
        slope = F.when(ok, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / vx)
        return s.select(key, n.cast("bigint").alias("n"), slope.alias("slope"))
    return fn
