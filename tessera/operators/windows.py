"""Window operators: ranks, offsets, running and rolling aggregates, gap
filling, interpolation and regular time buckets.

Every window here is partitioned by the caller's group key: rows of one group
meet in one task, as a window requires. The order always ends in a unique
column supplied by the caller so ties resolve the same way in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.checks import as_list, require_columns
from tessera.operators import hotsplit
from tessera.operators.groupjoin import join_by
from tessera.operators.sliding import rolling_median
from tessera.operators.verbs import order_cols

RANK_KINDS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")


def _w(by, order) -> Window:
    return Window.partitionBy(*as_list(by)).orderBy(*order_cols(order))


def rank_family(df: DataFrame, by, order, kinds=RANK_KINDS, ntile: int = 4,
                hot_rows: int = hotsplit.HOT_ROWS) -> DataFrame:
    """Adds one column per rank kind (``ntile`` uses ``ntile`` buckets). Groups
    above ``hot_rows`` rows are ranked in pieces (see ``hotsplit``)."""
    if all(isinstance(o, str) for o in as_list(order)):
        return hotsplit.ranks(df, by, order, kinds, ntile, hot_rows)
    w = _w(by, order)
    fns = {"row_number": F.row_number(), "rank": F.rank(), "dense_rank": F.dense_rank(),
           "percent_rank": F.percent_rank(), "cume_dist": F.cume_dist(), "ntile": F.ntile(ntile)}
    return df.select("*", *[fns[k].over(w).alias(k) for k in as_list(kinds)])


def lead_lag(df: DataFrame, by, order, col: str, k: int = 1, hot_rows: int | None = hotsplit.HOT_ROWS) -> DataFrame:
    """Value k rows back and ahead, difference and growth against k rows back.
    Hot groups run in pieces with a k-row halo (see ``hotsplit``)."""
    def cols(w):
        lag = F.lag(col, k).over(w)
        return [lag.alias(f"{col}_lag"), F.lead(col, k).over(w).alias(f"{col}_lead"),
                (F.col(col) - lag).alias(f"{col}_diff"), F.try_divide(F.col(col) - lag, lag).alias(f"{col}_growth")]

    if all(isinstance(o, str) for o in as_list(order)):
        return hotsplit.with_halo(df, by, order, k, k, cols, hot_rows)
    return df.select("*", *cols(_w(by, order)))


def cumulative(df: DataFrame, by, order, col: str, any_flag: Column | None = None,
               all_flag: Column | None = None, hot_rows: int | None = hotsplit.HOT_ROWS) -> DataFrame:
    """Running sum, mean, min, max from the first row to the current row, and a
    running any / all of the given boolean columns. Groups above the hot-row
    threshold run in pieces with carried prefix aggregates (see ``hotsplit``)."""
    aggs = {"cum_sum": ("sum", F.col(col)), "__cnt": ("count", F.col(col)),
            "cum_min": ("min", F.col(col)), "cum_max": ("max", F.col(col))}
    if any_flag is not None:
        aggs["cum_any"] = ("any", any_flag)
    if all_flag is not None:
        aggs["cum_all"] = ("all", all_flag)
    r = hotsplit.running(df, by, order, aggs, hot_rows)
    r = r.withColumn("cum_mean", F.try_divide(F.col("cum_sum"), F.col("__cnt"))).drop("__cnt")
    names = ["cum_sum", "cum_mean", "cum_min", "cum_max"] + [k for k in ("cum_any", "cum_all") if k in aggs]
    return r.select(*df.columns, *names)


ROLL_FUNCS = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def rolling_rows(df: DataFrame, by, order, col: str, k: int, fn: str = "mean",
                 align: str = "right", name: str | None = None, hot_rows: int | None = hotsplit.HOT_ROWS) -> DataFrame:
    """k-row rolling aggregate; NULL where the window holds fewer than k rows.
    ``align='right'`` uses the current and k-1 previous rows; ``'center'`` (odd k)
    uses (k-1)/2 rows on each side. ``fn`` is mean, sum, max, min, or median (order columns given by name)."""
    if align == "right":
        lo, hi = -(k - 1), 0
    elif align == "center":
        if k % 2 == 0:
            raise ValueError("centre alignment needs an odd k")
        lo, hi = -(k // 2), k // 2
    else:
        raise ValueError(f"align={align!r}")

    name = name or f"{col}_roll_{fn}"
    if fn == "median":
        # Spark has no median over a frame: the frame's values are kept sorted from row to row
        return rolling_median(df, by, order, col, k, hi, name, hot_rows)

    def cols(wbase):
        w = wbase.rowsBetween(lo, hi)
        full = F.count(F.lit(1)).over(w) == k
        return [F.when(full, ROLL_FUNCS[fn](col).over(w)).alias(name)]

    if all(isinstance(o, str) for o in as_list(order)):
        return hotsplit.with_halo(df, by, order, -lo, hi, cols, hot_rows)
    return df.select("*", *cols(_w(by, order)))


def rolling_time(df: DataFrame, by, ts: str, col: str, span: str = "1 HOUR",
                 fns=("sum", "count"), prefix: str = "win_", hot_rows: int | None = hotsplit.HOT_ROWS) -> DataFrame:
    """Aggregates over ``(ts - span, ts]``-style range frames: all rows of the
    group whose time lies within ``span`` before the current row, peers included."""
    by = as_list(by)
    require_columns(df, ts, col, *by)
    sql = {"sum": f"sum(`{col}`)", "count": f"count(`{col}`)", "mean": f"avg(`{col}`)",
           "max": f"max(`{col}`)", "min": f"min(`{col}`)"}

    def cols(part_cols):
        part = ", ".join(f"`{b}`" for b in part_cols)
        frame = (f"OVER ({'PARTITION BY ' + part if part else ''} ORDER BY `{ts}` "
                 f"RANGE BETWEEN INTERVAL {span} PRECEDING AND CURRENT ROW)")
        return [F.expr(f"{sql[f]} {frame}").alias(prefix + f) for f in as_list(fns)]

    n, unit = span.split()
    # a halo may be longer than the frame, so a month counts as 31 days here
    secs = int(n) * {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 7 * 86400,
                     "MONTH": 31 * 86400, "YEAR": 366 * 86400}[unit.upper().rstrip("S")]
    # hot groups run in time pieces, each with the rows of the span before it
    return hotsplit.with_time_halo(df, by, ts, secs, cols, hot_rows)


def locf_fill(df: DataFrame, by, order, col: str, direction: str = "forward",
              max_gap: int | None = None, name: str | None = None, hot_rows: int | None = hotsplit.HOT_ROWS) -> DataFrame:
    """Carry the last (``forward``) or next (``backward``) non-NULL value over
    NULLs; with ``max_gap``, to the rows at most that many rows from the value
    (of a longer run the nearest ``max_gap`` rows are filled).
    Hot groups run in pieces (see ``hotsplit``); the backward fill is the
    forward fill under the reversed order."""
    if all(isinstance(o, str) for o in as_list(order)):
        if direction == "forward":
            ordr = as_list(order)
        elif direction == "backward":
            ordr = [o[1:] if o.startswith("-") else "-" + o for o in as_list(order)]
        else:
            raise ValueError(f"direction={direction!r}")
        return hotsplit.fill_forward(df, by, ordr, col, name or f"{col}_filled", max_gap, hot_rows)
    w = _w(by, order)
    rn = F.row_number().over(w)
    d = df.withColumn("__rn", rn).withColumn(
        "__known", F.when(F.col(col).isNotNull(), F.col("__rn")))
    if direction == "forward":
        frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        val = F.last(col, ignorenulls=True).over(frame)
        src = F.last("__known", ignorenulls=True).over(frame)
        gap = F.col("__rn") - src
    elif direction == "backward":
        frame = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        val = F.first(col, ignorenulls=True).over(frame)
        src = F.first("__known", ignorenulls=True).over(frame)
        gap = src - F.col("__rn")
    else:
        raise ValueError(f"direction={direction!r}")
    out = val if max_gap is None else F.when(gap <= max_gap, val)
    return d.withColumn(name or f"{col}_filled", out).drop("__rn", "__known")


def interpolate_linear(df: DataFrame, by, ts: str, col: str, order_tiebreak: str | None = None,
                       name: str | None = None, hot_rows: int | None = hotsplit.HOT_ROWS) -> DataFrame:
    """NULLs between two known points are filled on the straight line through
    them in time; leading and trailing NULLs stay NULL. Groups above ``hot_rows`` rows run in pieces (see ``hotsplit``)."""
    order = [ts] + ([order_tiebreak] if order_tiebreak else [])
    t = _epoch_micros(F.col(ts))
    if all(isinstance(o, str) for o in order):
        # previous and next known (value, time) by two hot-group-safe fills
        known = F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("v"), t.alias("t")))
        d = df.withColumn("__known", known)
        d = hotsplit.fill_forward(d, by, order, "__known", "__prev", hot_rows=hot_rows)
        d = hotsplit.fill_forward(d, by, ["-" + o for o in order], "__known", "__next", hot_rows=hot_rows)
        v0, t0, v1, t1 = (F.col("__prev.v"), F.col("__prev.t"), F.col("__next.v"), F.col("__next.t"))
        interp = F.when(F.col(col).isNotNull(), F.col(col)).when(
            t1 == t0, v0).otherwise(v0 + (v1 - v0) * (t - t0) / (t1 - t0))
        return d.withColumn(name or f"{col}_interp", interp).drop("__known", "__prev", "__next")
    w = _w(by, order)
    d = df.withColumn("__t", t).withColumn("__kt", F.when(F.col(col).isNotNull(), F.col("__t")))
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fwd = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    v0, t0 = F.last(col, True).over(back), F.last("__kt", True).over(back)
    v1, t1 = F.first(col, True).over(fwd), F.first("__kt", True).over(fwd)
    interp = F.when(F.col(col).isNotNull(), F.col(col)).when(
        t1 == t0, v0).otherwise(v0 + (v1 - v0) * (F.col("__t") - t0) / (t1 - t0))
    return d.withColumn(name or f"{col}_interp", interp).drop("__t", "__kt")


def _epoch_micros(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz")).cast("double")


#: Buckets of one stretch of a spine, made by one task at a time.
SPINE_CHUNK = 65_536


def time_bucket_agg(df: DataFrame, by, ts: str, unit: str, aggs: dict, fill: dict | None = None,
                    width: int = 1, chunk: int = SPINE_CHUNK) -> DataFrame:
    """Regular series: rows cut into buckets of ``width`` units (15 ``minute``, 2 ``hour``,
    ``day``, ``quarter``...; counted from 1970-01-01, weeks from their Monday) and aggregated; every bucket between a group's first and last one is kept,
    empty ones with ``fill`` values. The spine is one row per bucket per group, numbered from the group's own
    bounds. It is made in stretches of at most ``chunk`` buckets that are dealt to all tasks, so a group may
    have any number of buckets. Rows with a NULL time are in no bucket."""
    by = as_list(by)
    unit = unit.lower()
    whole = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    if unit in ("month", "quarter", "year"):
        months = {"month": 1, "quarter": 3, "year": 12}[unit] * width
        number = F.floor(((F.year(whole) - 1970) * 12 + F.month(whole) - 1) / months)
        bucket = F.add_months(F.lit("1970-01-01").cast("date"), (F.col("__k") * months).cast("int")).cast("timestamp_ntz")
    else:
        secs = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}[unit] * width
        origin = F.lit("1969-12-29 00:00:00" if unit == "week" else "1970-01-01 00:00:00").cast("timestamp_ntz")
        number = F.floor(F.timestamp_diff("SECOND", origin, whole) / secs)
        bucket = origin + F.make_dt_interval(secs=F.col("__k") * secs)
    g = df.groupBy(*by, number.cast("bigint").alias("__k")).agg(*[v.alias(k) for k, v in aggs.items()])
    bounds = df.groupBy(*by).agg(F.min(number).cast("bigint").alias("__lo"), F.max(number).cast("bigint").alias("__hi"))
    first = F.col("__lo") + F.col("__chunk") * chunk
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = bounds.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__hi") - F.col("__lo")) / chunk))))
    spine = stretches.repartition(tasks, *by, "__chunk").select(
        *by, F.explode(F.sequence(first, F.least(first + (chunk - 1), F.col("__hi")))).alias("__k"))
    out = join_by(spine, g, [*by, "__k"])
    out = out.select(*by, bucket.alias("bucket"), *aggs)
    return out.fillna(fill) if fill else out
