"""Reshaping: long, wide, nested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checks import as_list, require_columns


def pivot_longer(df: DataFrame, ids, values, names_to: str = "name", values_to: str = "value",
                 value_type: str | None = None) -> DataFrame:
    """Columns ``values`` into (name, value) rows. Values of mixed types must be
    cast to one type (``value_type``); Spark refuses to stack int with string."""
    ids, values = as_list(ids), as_list(values)
    require_columns(df, *ids, *values)
    src = df.select(*ids, *[F.col(c).cast(value_type).alias(c) if value_type else F.col(c) for c in values])
    return src.unpivot(ids, values, names_to, values_to)


def pivot_wider(df: DataFrame, ids, key: str, levels, aggs: dict, fill=None) -> DataFrame:
    """``key`` values to columns. The level list is required: without it Spark
    runs an extra job to find the levels and the column count is unbounded.
    Output columns are ``<agg>_<level>``."""
    ids, levels = as_list(ids), list(levels)
    require_columns(df, *ids, key)
    names = list(aggs)
    p = df.groupBy(*ids).pivot(key, levels).agg(*[aggs[n].alias(n) for n in names])
    if len(names) == 1:
        out = p.select(*ids, *[F.col(f"`{lv}`").alias(f"{names[0]}_{lv}") for lv in levels])
    else:
        out = p.select(*ids, *[F.col(f"`{lv}_{n}`").alias(f"{n}_{lv}") for n in names for lv in levels])
    return out.fillna(fill) if fill is not None else out


def nest(df: DataFrame, by, name: str = "data", parts: int = 1) -> DataFrame:
    """Rows of each group into an array of structs: one output row per group, or with ``parts`` the
    group's non-empty parts (``<name>_part``) by a hash of the row, at every size alike. Choose
    ``parts`` where a group may be too large for one array; ``unnest`` of all
    parts gives back exactly the group's rows."""
    by = as_list(by)
    rest = [c for c in df.columns if c not in by]
    part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(parts)) if parts > 1 else F.lit(0).cast("bigint")
    return df.withColumn(name + "_part", part).groupBy(*by, name + "_part").agg(
        F.collect_list(F.struct(*rest)).alias(name))


def unnest(df: DataFrame, name: str = "data") -> DataFrame:
    """Array of structs back to rows; a row with an empty or NULL array is kept
    with NULL fields."""
    others = [c for c in df.columns if c not in (name, name + "_part")]
    return df.select(*others, F.inline_outer(F.col(name)))
