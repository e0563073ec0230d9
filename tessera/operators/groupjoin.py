"""Joining per-group tables back to rows: NULL keys match NULL keys, and a
table is broadcast only after its rows were counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.checks import as_list
from tessera.session import scratch_dir

#: A per-group table of at most this many rows is broadcast.
BROADCAST_ROWS = 200_000


#: Leaves of a plan that may be read several times as it is.
MOST_LEAVES = 4


def settled(df: DataFrame) -> DataFrame:
    """The frame, written once (checkpoint) if its plan has more than MOST_LEAVES leaves.

    Operators that read their input for two branches would, one upon the other, double the plan each time; a chain of
    them is cut by a written table instead. A table, a join or an aggregate of tables stays as it is."""
    if df._jdf.queryExecution().analyzed().collectLeaves().size() <= MOST_LEAVES:
        return df
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def join_by(df: DataFrame, table: DataFrame, by, how: str = "left", broadcast: bool = False) -> DataFrame:
    """``df`` with the columns of a table that has one row per group ``by``
    (NULL equals NULL). With no group the table is one row."""
    by = as_list(by)
    if not by:
        return df.crossJoin(F.broadcast(table))
    table = table.withColumnsRenamed({b: f"__key_{b}" for b in by})
    on = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"__key_{b}")) for b in by])
    return df.join(F.broadcast(table) if broadcast else table, on, how).drop(*[f"__key_{b}" for b in by])


def join_rows_by(df: DataFrame, table: DataFrame, by, how: str = "left") -> DataFrame:
    """``join_by`` for raw rows, where a hot group must not meet in one task: the
    per-group table is written once and counted; up to ``BROADCAST_ROWS`` rows it
    is broadcast and the rows stay where they are, beyond that no group can
    hold a large share of the rows without AQE's skew join splitting it."""
    by = as_list(by)
    if not by:
        return join_by(df, table, by)
    scratch_dir(df.sparkSession)
    table = table.checkpoint()
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return join_by(df, table, by, how, broadcast=small)


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation over the rows where both are known; NULL when either is constant there."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    vx, vy = F.var_pop(F.when(both, x)), F.var_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(vx * vy))
