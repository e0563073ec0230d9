"""Numeric column functions and group-relative scalings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.checks import as_list
from tessera.operators.groupjoin import join_rows_by


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, n: int = 0) -> Column:
    """Half away from zero (0.5 -> 1, -2.5 -> -3): Spark's ``round``."""
    return F.round(_c(c), n)


def safe_div(a, b) -> Column:
    """NULL instead of an error (ANSI) when the divisor is 0 or NULL."""
    return F.try_divide(_c(a), _c(b))


def log_base(c, base: float) -> Column:
    return F.log(float(base), _c(c))


def pow_(c, p: float) -> Column:
    return F.pow(_c(c), F.lit(p))


def abs_(c) -> Column:
    return F.abs(_c(c))


def scale_by_group(df: DataFrame, cols, by=(), kinds=("z", "minmax"), suffix: str = "_") -> DataFrame:
    """z-score (sample sd) and min-max scaling per group.

    Group statistics come from one ``groupBy`` (partial aggregation, skew-safe)
    joined back on the group key; with no group they are one row, broadcast."""
    cols, by = as_list(cols), as_list(by)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}"),
                 F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}")]
    st = df.groupBy(*by).agg(*aggs)
    j = join_rows_by(df, st, by)
    out = []
    for c in cols:
        if "z" in kinds:
            out.append(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")).alias(f"{c}{suffix}z"))
        if "minmax" in kinds:
            out.append(F.try_divide(F.col(c) - F.col(f"__lo_{c}"),
                                    F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).alias(f"{c}{suffix}minmax"))
    return j.select(*df.columns, *out)
