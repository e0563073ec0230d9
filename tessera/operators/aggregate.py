"""Grouped aggregation: named aggregates, function x column grids, counts with
shares, distinct counts, quantiles, weighted statistics, moments, mode and
median, cubes and two-way tables.

All of these are ``groupBy().agg()`` plans, so Spark adds a partial (map-side)
aggregate before the shuffle: a hot group is reduced on every map task first.
Shares use a one-row total cross-joined by broadcast, never a window without a
partition key over ungrouped rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.checks import as_list, require_columns
from tessera.operators.groupjoin import join_by
from tessera.operators.ranking import exact_quantiles, quantiles, sorted_cumulative, value_histogram

AGG_FUNCS = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max,
    "sd": F.stddev_samp, "var": F.var_samp, "count": F.count,
    "n_distinct": F.count_distinct, "first": F.first,
}


def _agg(spec, name: str) -> Column:
    if isinstance(spec, Column):
        return spec.alias(name)
    if isinstance(spec, str):
        return F.expr(spec).alias(name)
    fn, col = spec
    return AGG_FUNCS[fn](F.col(col)).alias(name)


def summarise_by(df: DataFrame, by, aggs: dict) -> DataFrame:
    """``aggs`` maps an output name to a Column, a SQL text or (fn, column)."""
    by = as_list(by)
    require_columns(df, *by)
    return df.groupBy(*by).agg(*[_agg(v, k) for k, v in aggs.items()])


def summarise_across(df: DataFrame, by, cols, fns, names: str = "{col}_{fn}") -> DataFrame:
    """Every function in ``fns`` (keys of AGG_FUNCS) over every column."""
    cols = as_list(cols)
    require_columns(df, *cols)
    aggs = {names.format(col=c, fn=f): (f, c) for c in cols for f in as_list(fns)}
    return summarise_by(df, by, aggs)


def total_row(df: DataFrame, col: str, name: str = "__total") -> DataFrame:
    return df.agg(F.sum(col).alias(name))


def count_by(df: DataFrame, by, sort: bool = True) -> DataFrame:
    """Row count per group and its share of all rows."""
    by = as_list(by)
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    out = g.crossJoin(F.broadcast(total_row(g, "n"))).select(
        *by, "n", (F.col("n") / F.col("__total")).alias("share"))
    return out.orderBy(F.col("n").desc(), *by) if sort else out


def distinct_count(df: DataFrame, by, col: str, approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """Distinct non-NULL values per group; HyperLogLog++ when ``approx``."""
    by = as_list(by)
    f = F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)
    return df.groupBy(*by).agg(f.alias("n_distinct"))


def quantiles_by(df: DataFrame, by, col: str, probs, approx: bool = False,
                 accuracy: int = 10_000, names=None, sketch: int | None = None) -> DataFrame:
    """Quantiles per group. Exact (linear interpolation, type 7) by default via
    the distributed rank recipe. ``approx=True`` uses ``percentile_approx`` and ``sketch`` mergeable KLL sketches of that many
    items (``ranking.quantile_sketches``); their results differ, so neither is ever chosen silently."""
    by, probs = as_list(by), as_list(probs)
    names = as_list(names) or [f"q{int(round(p * 100)):02d}" for p in probs]
    if approx:
        q = F.percentile_approx(F.col(col), probs, accuracy)
        g = df.groupBy(*by).agg(q.alias("__q"))
        return g.select(*by, *[F.col("__q")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return quantiles(df, col, probs, by=by, names=names, sketch=sketch)


def weighted_stats(df: DataFrame, by, x: str, w: str, probs=(0.5,), names=None) -> DataFrame:
    """Weighted mean, weighted population variance, and weighted quantiles
    (smallest x whose cumulative weight reaches p x total weight); rows with NULL
    x or w ignored."""
    by, probs = as_list(by), as_list(probs)
    names = as_list(names) or [f"wq{int(round(p * 100)):02d}" for p in probs]
    d = df.where(F.col(x).isNotNull() & F.col(w).isNotNull())
    # one row per distinct value first: moments and quantiles both come from it
    hist = value_histogram(d, x, by, weight=w)
    mom = hist.groupBy(*by).agg(F.try_divide(F.sum(F.col(x) * F.col("_n")), F.sum("_n")).alias("wmean"), F.sum("_n").alias("wsum"))
    # second pass around the weighted mean: no cancellation of large squares
    dev = join_by(hist, mom, by).groupBy(*by).agg(
        F.try_divide(F.sum(F.col("_n") * (F.col(x) - F.col("wmean")) ** 2), F.first("wsum")).alias("wvar"))
    mom = join_by(mom, dev, by)
    cum = sorted_cumulative(hist, x, ["_n"], by)
    incl = F.col("_n_before") + F.col("_n")
    picks = []
    for p, n in zip(probs, names):
        target = F.col("_n_total") * F.lit(float(p))
        picks.append(F.min(F.when((F.col("_n_before") < target) & (incl >= target), F.col(x))).alias(n))
    wq = cum.groupBy(*by).agg(*picks)
    return join_by(mom, wq, by)


def trimmed_mean(df: DataFrame, by, col: str, frac: float = 0.1) -> DataFrame:
    """Mean after dropping floor(n * frac) values from each end of each group,
    exact and distributed: positions come from the running-count recipe over
    distinct values, and each value contributes the part of its run of equal
    values that lies inside the kept positions."""
    by = as_list(by)
    hist = value_histogram(df, col, by)
    cum = sorted_cumulative(hist, col, ["_n"], by)
    n, before, cnt = F.col("_n_total"), F.col("_n_before"), F.col("_n")
    k = F.floor(n * F.lit(float(frac)))
    kept = F.greatest(F.lit(0), F.least(before + cnt, n - k) - F.greatest(before, k))
    s = cum.groupBy(*by).agg(F.sum(F.col(col) * kept).alias("__s"), F.sum(kept).alias("__k"))
    return s.select(*by, F.try_divide(F.col("__s"), F.col("__k")).alias("trimmed_mean"))


def moments_by(df: DataFrame, by, col: str) -> DataFrame:
    """n, mean, sample sd, population skewness, population excess kurtosis."""
    by = as_list(by)
    return df.groupBy(*by).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"),
        F.skewness(col).alias("skewness"), F.kurtosis(col).alias("kurtosis"))


def mode_median(df: DataFrame, by, col: str) -> DataFrame:
    """Modal value (smallest among equally frequent) and exact median."""
    by = as_list(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("__c"))
    mode = counts.groupBy(*by).agg(
        F.min_by(F.col(col), F.struct((-F.col("__c")).alias("c"), F.col(col).alias("v"))).alias("mode"))
    med = exact_quantiles(df, col, [0.5], by=by, names=["median"])
    return join_by(mode, med, by)


def cube_rollup(df: DataFrame, dims, aggs: dict, kind: str = "cube", sets=None) -> DataFrame:
    """Grouping sets with a ``grouping_id`` column (bit set = dimension rolled up)."""
    dims = as_list(dims)
    agg_cols = [_agg(v, k) for k, v in aggs.items()] + [F.grouping_id().cast("int").alias("grouping_id")]
    if kind == "cube":
        return df.cube(*dims).agg(*agg_cols)
    if kind == "rollup":
        return df.rollup(*dims).agg(*agg_cols)
    if kind == "sets":
        return df.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(*agg_cols)
    raise ValueError(f"kind={kind!r}")


def crosstab(df: DataFrame, r: str, c: str) -> DataFrame:
    """Two-way counts with row, column and overall shares (long form)."""
    g = df.groupBy(r, c).agg(F.count(F.lit(1)).alias("n"))
    rows = g.groupBy(r).agg(F.sum("n").alias("__rn"))
    cols = g.groupBy(c).agg(F.sum("n").alias("__cn"))
    tot = total_row(g, "n")
    return (join_by(join_by(g, rows, r), cols, c).crossJoin(F.broadcast(tot))
            .select(r, c, "n",
                    (F.col("n") / F.col("__rn")).alias("row_share"),
                    (F.col("n") / F.col("__cn")).alias("col_share"),
                    (F.col("n") / F.col("__total")).alias("share")))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "DataFrame", "Window", "F")]
