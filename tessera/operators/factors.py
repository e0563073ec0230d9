"""Categorical levels: lumping rare levels and ordering levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.groupjoin import join_by
from tessera.operators.ranking import exact_quantiles, numbered


def level_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def factor_lump(df: DataFrame, col: str, n: int, other: str = "Other", name: str | None = None) -> DataFrame:
    """Keep the ``n`` most frequent levels (ties by level value), others become
    ``other``; NULL is no level and stays NULL. The kept levels come from a distributed top-n (TakeOrderedAndProject)
    and are at most ``n`` rows, so broadcasting them is bounded."""
    top = level_counts(df.where(F.col(col).isNotNull()), col).orderBy(F.col("n").desc(), F.col(col).asc()).limit(n) \
        .select(F.col(col).alias("__lvl"), F.lit(True).alias("__keep"))
    j = df.join(F.broadcast(top), df[col] == top["__lvl"], "left")
    out = F.when(F.col("__keep"), F.col(col)).when(F.col(col).isNull(), F.lit(None)).otherwise(F.lit(other))
    return j.withColumn(name or col, out).drop("__lvl", "__keep")


def factor_order(df: DataFrame, col: str, by: str | None = None, fn: str = "freq") -> DataFrame:
    """Level table (level, n, key, position): ordered by frequency (descending)
    or, with ``by``, by the median of ``by`` within the level (ascending); ties
    by level value. Positions come from one sort over ranges of (key, level)."""
    counts = level_counts(df.where(F.col(col).isNotNull()), col)
    if by is None:
        lv = counts.withColumn("key", F.col("n").cast("double")).withColumn("__down", -F.col("key"))
    else:
        med = exact_quantiles(df.where(F.col(col).isNotNull()), by, [0.5], by=[col], names=["key"])
        # a level without values comes last
        lv = join_by(counts, med, [col]).withColumn("__down", F.coalesce("key", F.lit(float("inf"))))
    out = numbered(lv, [F.col("__down"), F.col(col)])
    return out.select(col, "n", "key", F.col("position").cast("int").alias("position"))
