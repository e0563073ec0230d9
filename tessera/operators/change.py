"""Structural change in ordered series: OLS-CUSUM path, Chow test at a known
date and least-squares break dates.

A series here is already aggregated (one row per period, e.g. months); the
path and the tests run over that per-series table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.checks import as_list
from tessera.operators.ranking import numbered


def ols_cusum(df: DataFrame, order: str, y: str, by=()) -> DataFrame:
    """OLS-based CUSUM for a mean model: residuals from the series mean,
    cumulated in order and scaled by sigma * sqrt(n) (sigma with n - 1 df).
    Adds ``resid``, ``cusum`` and the series' ``max_abs`` of the path. Points of one place in the order come
    in the order of their values; one with a NULL value has no residual and keeps the path.

    Without ``by`` the one series is numbered and cumulated by a sort over ranges, so no task holds it; with ``by`` a
    series is a window."""
    by = as_list(by)
    if not by:
        one = df.agg(F.avg(y).alias("__mean"), F.count(F.lit(1)).alias("__n"))
        d = df.crossJoin(F.broadcast(one)).withColumn("resid", F.col(y) - F.col("__mean")).withColumn("__step", F.coalesce("resid", F.lit(0.0)))
        d = numbered(d, [F.col(order).asc_nulls_first(), F.col(y).asc_nulls_first()], ["__step"])
        spread = d.agg(F.sqrt(F.try_divide(F.sum(F.col("resid") ** 2), F.first("__n") - 1)).alias("__sigma"))
        path = d.crossJoin(F.broadcast(spread)).withColumn(
            "cusum", F.try_divide(F.col("__step_before") + F.col("__step"), F.col("__sigma") * F.sqrt("__n")))
        most = path.agg(F.max(F.abs("cusum")).alias("max_abs"))
        return path.select(*df.columns, "resid", "cusum").crossJoin(F.broadcast(most))
    whole = Window.partitionBy(*by)
    run = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_first(), F.col(y).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("resid", F.col(y) - F.avg(y).over(whole))
    n = F.count(F.lit(1)).over(whole)
    sigma = F.sqrt(F.try_divide(F.sum(F.col("resid") ** 2).over(whole), n - 1))
    d = d.withColumn("cusum", F.try_divide(F.sum(F.coalesce("resid", F.lit(0.0))).over(run), sigma * F.sqrt(n)))
    return d.withColumn("max_abs", F.max(F.abs("cusum")).over(whole))


def chow_test(df: DataFrame, x: str, y: str, at, by=()) -> DataFrame:
    """F test for a break in y = a + b x at ``x >= at``: residual sums of
    squares of the pooled and the two split fits from ``regr_*`` aggregates."""
    by = as_list(by)

    def rss(cond):
        c = (lambda e: F.when(cond, e)) if cond is not None else (lambda e: e)
        syy = F.regr_syy(c(F.col(y)), c(F.col(x)))
        sxy = F.regr_sxy(c(F.col(y)), c(F.col(x)))
        sxx = F.regr_sxx(c(F.col(y)), c(F.col(x)))
        return syy - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0)), F.regr_count(c(F.col(y)), c(F.col(x)))

    rp, n = rss(None)
    r1, n1 = rss(F.col(x) < F.lit(at))
    r2, n2 = rss(F.col(x) >= F.lit(at))
    s = df.groupBy(*by).agg(rp.alias("rss_pooled"), r1.alias("rss_1"), r2.alias("rss_2"),
                            n.alias("n"), n1.alias("n1"), n2.alias("n2"))
    k = 2
    f = F.try_divide((F.col("rss_pooled") - F.col("rss_1") - F.col("rss_2")) / k,
                     F.try_divide(F.col("rss_1") + F.col("rss_2"), F.col("n") - 2 * k))
    return s.select(*by, f.alias("f"), F.lit(k).cast("bigint").alias("df1"),
                    (F.col("n") - 2 * k).cast("bigint").alias("df2"),
                    F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"))


BREAK_SCHEMA = T.StructType([
    T.StructField("series", T.StringType()), T.StructField("n_breaks", T.IntegerType()),
    T.StructField("break_index", T.IntegerType()), T.StructField("break_order", T.LongType()),
    T.StructField("rss", T.DoubleType()), T.StructField("bic", T.DoubleType()),
])

def segment_costs(v: np.ndarray, max_breaks: int, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least residual sums of squares of v[:j] in m + 1 segments of at least ``min_size`` points, and where
    the last segment starts: arrays (m, j), exact, by functional pruning.

    A start i stays a candidate for the last segment only where some mean makes its cost the least: the candidates share
    the range of means as intervals, ordered by mean. The cost of i less that of a later i' is a parabola in the mean
    that no further point changes, so i keeps of its interval what lies between the parabola's roots, and the new
    candidate takes what is freed; a candidate without an interval never comes back. A few candidates are left
    at any time, so the work grows nearly with the length of the series, not with its square."""
    n = len(v)
    v = v - v.mean() if n else v  # smaller squares; costs do not change
    c1, c2 = np.concatenate([[0.0], np.cumsum(v)]), np.concatenate([[0.0], np.cumsum(v * v)])
    cost = np.full((max_breaks + 1, n + 1), np.inf)
    back = np.zeros((max_breaks + 1, n + 1), dtype=np.int64)
    if n < min_size:
        return cost, back
    low, high = float(v.min()), float(v.max())
    j = np.arange(min_size, n + 1)
    cost[0, j] = np.maximum(c2[j] - c1[j] ** 2 / j, 0.0)
    for m in range(1, max_breaks + 1):
        prev = cost[m - 1]
        at = np.zeros(0, np.int64)
        lo = hi = np.zeros(0)
        for end in range((m + 1) * min_size, n + 1):
            new = end - min_size
            if len(at):
                k = new - at
                mid = (c1[new] - c1[at]) / k
                room = mid * mid - (prev[at] - prev[new] + c2[new] - c2[at]) / k
                half = np.sqrt(np.maximum(room, 0.0))
                a, b = np.maximum(lo, mid - half), np.minimum(hi, mid + half)
                stays = (room >= 0) & (a <= b)
                at, lo, hi = at[stays], a[stays], b[stays]
            left, right = np.append(low, hi), np.append(lo, high)
            free = left < right if len(at) else np.array([True])
            if free.any():
                at, lo, hi = np.append(at, np.full(int(free.sum()), new)), np.append(lo, left[free]), np.append(hi, right[free])
                order = np.argsort(lo, kind="stable")
                at, lo, hi = at[order], lo[order], hi[order]
            total = prev[at] + np.maximum(c2[end] - c2[at] - (c1[end] - c1[at]) ** 2 / (end - at), 0.0)
            least = total.min()
            cost[m, end], back[m, end] = least, at[total == least].min()
    return cost, back


def _breaks_one(pdf, order, y, max_breaks, min_frac, key_cols):
    """Least-squares segmentation of a mean-shift model (optimal partition into m + 1 segments, each of
    at least ``min_frac`` of the series' points), for m = 0..max_breaks.
    Returns one row per (m, break) plus m = 0 with no break; BIC per m."""
    import pandas as pd

    pdf = pdf.sort_values(order)
    v = pdf[y].to_numpy(dtype=float)
    t = pdf[order].to_numpy()
    n = len(v)
    series = "|".join(str(pdf[c].iloc[0]) for c in key_cols) if key_cols else ""
    cost, back = segment_costs(v, max_breaks, max(2, int(np.floor(min_frac * n))))
    rows = []
    for m in range(0, max_breaks + 1):
        if not np.isfinite(cost[m, n]):
            continue
        rss = float(cost[m, n])
        k = 2 * m + 1  # m+1 means and m break dates
        bic = n * np.log(rss / n) + k * np.log(n) if rss > 0 else float("-inf")
        cuts, j = [], n
        for mm in range(m, 0, -1):
            j = int(back[mm, j])
            cuts.append(j)
        cuts.reverse()
        if not cuts:
            rows.append((series, m, None, None, rss, bic))
        for bi, c in enumerate(cuts, start=1):
            rows.append((series, m, bi, int(t[c - 1]), rss, bic))  # last point of the segment before the break
    return pd.DataFrame(rows, columns=["series", "n_breaks", "break_index", "break_order", "rss", "bic"])


def breakpoints(df: DataFrame, order: str, y: str, by=(), max_breaks: int = 3, min_frac: float = 0.15) -> DataFrame:
    """Break dates of a piecewise-constant mean, for 0..max_breaks breaks, per
    series; a segment holds at least ``min_frac`` of its series' points (2 at least). Each series is one group
    of ``applyInPandas``, so series run in parallel; its length is not limited, the search
    takes time nearly in proportion to it (``segment_costs``). Points with a NULL value or place are left out."""
    by = as_list(by)
    data = df.select(*by, order, y).dropna(subset=[order, y])

    def fn(pdf):
        return _breaks_one(pdf, order, y, max_breaks, min_frac, by)

    if by:
        return data.groupBy(*by).applyInPandas(fn, BREAK_SCHEMA)
    return data.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(
        lambda p: _breaks_one(p, order, y, max_breaks, min_frac, []), BREAK_SCHEMA)
