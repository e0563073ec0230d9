"""Date and time column functions, plus the business-day calendar.

Fixture timestamps load as TIMESTAMP_NTZ. Functions that Spark evaluates
through a zoned timestamp (``date_trunc``) are cast back to NTZ; the session
time zone is pinned to UTC by ``prepare_session``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_part(c, unit: str) -> Column:
    """year, quarter, month, day, hour, minute, second, weekday (ISO: Monday = 1),
    isoweek, yday."""
    c = _c(c)
    fns = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth,
           "hour": F.hour, "minute": F.minute, "second": F.second,
           "weekday": lambda x: F.weekday(x) + 1, "isoweek": F.weekofyear, "yday": F.dayofyear}
    return fns[unit](c)


def date_floor(c, unit: str, week_start: int = 1) -> Column:
    """Start of the unit containing ``c`` as a DATE (units of a day or more) or
    TIMESTAMP_NTZ (smaller units). ``week_start``: ISO day number, 1 = Monday,
    7 = Sunday."""
    c = _c(c)
    if unit == "week" and week_start != 1:
        shift = 8 - week_start  # days to move so that week_start lands on a Monday
        return F.date_sub(F.to_date(F.date_trunc("week", F.date_add(F.to_date(c), shift))), shift)
    t = F.date_trunc(unit, c).cast("timestamp_ntz")
    return F.to_date(t) if unit in ("year", "quarter", "month", "week", "day") else t


def _add_unit(d: Column, unit: str, n: int = 1) -> Column:
    if unit == "year":
        return F.add_months(d, 12 * n)
    if unit == "quarter":
        return F.add_months(d, 3 * n)
    if unit == "month":
        return F.add_months(d, n)
    if unit == "week":
        return F.date_add(d, 7 * n)
    if unit == "day":
        return F.date_add(d, n)
    if unit in ("hour", "minute", "second"):
        return d + F.expr(f"INTERVAL {n} {unit.upper()}")
    raise ValueError(f"unit={unit!r}")


def date_ceiling(c, unit: str, week_start: int = 1) -> Column:
    """Smallest unit boundary at or after ``c`` (a value on a boundary stays)."""
    fl = date_floor(c, unit, week_start)
    on_boundary = _c(c).cast("timestamp_ntz") == fl.cast("timestamp_ntz")
    return F.when(on_boundary, fl).otherwise(_add_unit(fl, unit))


def date_round(c, unit: str, week_start: int = 1) -> Column:
    """Nearest unit boundary; exactly half way rounds up."""
    fl = date_floor(c, unit, week_start)
    ce = date_ceiling(c, unit, week_start)
    ts = _c(c).cast("timestamp_ntz")
    lo = F.timestamp_diff("SECOND", fl.cast("timestamp_ntz"), ts)
    hi = F.timestamp_diff("SECOND", ts, ce.cast("timestamp_ntz"))
    return F.when(lo < hi, fl).otherwise(ce)


def date_add_months(c, n: int) -> Column:
    """Month arithmetic with end-of-month clamp (31 Jan + 1 month = 28/29 Feb)."""
    return F.add_months(F.to_date(_c(c)), n)


def date_diff(a, b, unit: str = "day") -> Column:
    """``b - a`` in whole units: days and weeks from calendar dates, hours,
    minutes and seconds from the timestamps."""
    a, b = _c(a), _c(b)
    if unit == "day":
        return F.datediff(F.to_date(b), F.to_date(a))
    if unit == "week":
        return F.floor(F.datediff(F.to_date(b), F.to_date(a)) / 7)
    return F.timestamp_diff(unit.upper(), a.cast("timestamp_ntz"), b.cast("timestamp_ntz"))


def age_years(birth, at) -> Column:
    """Completed years from ``birth`` to ``at``."""
    b, a = F.to_date(_c(birth)), F.to_date(_c(at))
    before = (F.month(a) < F.month(b)) | ((F.month(a) == F.month(b)) & (F.dayofmonth(a) < F.dayofmonth(b)))
    return F.year(a) - F.year(b) - F.when(before, 1).otherwise(0)


def interval_ops(s1, e1, s2, e2) -> dict[str, Column]:
    """Half-open intervals [s, e): overlap flag, containment of the second in the
    first, intersection bounds (NULL when empty) and the gap in days (0 when
    they overlap or touch)."""
    s1, e1, s2, e2 = _c(s1), _c(e1), _c(s2), _c(e2)
    lo, hi = F.greatest(s1, s2), F.least(e1, e2)
    overlap = lo < hi
    return {
        "overlaps": overlap,
        "contains": (s1 <= s2) & (e2 <= e1),
        "inter_start": F.when(overlap, lo),
        "inter_end": F.when(overlap, hi),
        "gap_days": F.when(overlap | (lo == hi), F.lit(0)).otherwise(F.datediff(F.to_date(lo), F.to_date(hi))),
    }


def business_calendar(spark_df_with_dates: DataFrame, date_col: str, holidays: DataFrame,
                      holiday_col: str = "dt", weekend=(6, 7)) -> DataFrame:
    """Calendar (dt, is_business, bd_index, next_bd) covering the dates of the
    given frame. ``bd_index`` counts business days up to and including ``dt``;
    ``next_bd`` is the first business day on or after ``dt``.

    The calendar has one row per day of the covered span, so the window that
    numbers it runs over a span-sized table, not over the data."""
    bounds = spark_df_with_dates.agg(F.min(F.to_date(date_col)).alias("lo"),
                                     F.max(F.to_date(date_col)).alias("hi"))
    hol = holidays.select(F.to_date(holiday_col).alias("dt")).distinct().withColumn("__hol", F.lit(True))
    # pad the end so that a next business day exists for the last dates, even after a run of
    # holidays: a closed run of n days holds at least 3n/7 - 2 of them outside the weekend
    later = bounds.crossJoin(hol.select(F.col("dt").alias("__h"))).groupBy("lo", "hi").agg(F.count_if(F.col("__h") > F.col("hi")).alias("n"))
    padded = bounds.join(later.select("lo", "n"), "lo", "left").select("lo", F.date_add("hi", (14 + 3 * F.coalesce("n", F.lit(0))).cast("int")).alias("end"))
    days = padded.select(F.explode(F.sequence("lo", "end")).alias("dt"))
    cal = days.join(F.broadcast(hol), "dt", "left").withColumn(
        "is_business", (~F.weekday("dt").isin([d - 1 for d in weekend])) & F.col("__hol").isNull())
    w = Window.orderBy("dt")
    cal = cal.withColumn("bd_index", F.sum(F.col("is_business").cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cal = cal.withColumn("next_bd", F.first(F.when(F.col("is_business"), F.col("dt")), ignorenulls=True).over(
        w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return cal.select("dt", "is_business", "bd_index", "next_bd")


def business_days(df: DataFrame, start: str, end: str, holidays: DataFrame, holiday_col: str = "dt",
                  weekend=(6, 7)) -> DataFrame:
    """Adds ``start_is_business``, ``start_next_bd`` (first business day on or after the
    start) and ``business_days`` (business days after the start up to and including the
    end; negative if the end is earlier). NULL dates give NULL. The calendar has one row per day of the span of both
    columns, which bounds what is broadcast."""
    dates = df.select(F.explode(F.array(F.to_date(start), F.to_date(end))).alias("__d"))
    cal = business_calendar(dates, "__d", holidays, holiday_col, weekend)
    first = cal.select(F.col("dt").alias("__s"), F.col("is_business").alias("start_is_business"),
                       F.col("next_bd").alias("start_next_bd"), F.col("bd_index").alias("__bs"))
    last = cal.select(F.col("dt").alias("__e"), F.col("bd_index").alias("__be"))
    j = (df.join(F.broadcast(first), F.to_date(start) == F.col("__s"), "left")
         .join(F.broadcast(last), F.to_date(end) == F.col("__e"), "left"))
    return j.select(*df.columns, "start_is_business", "start_next_bd", (F.col("__be") - F.col("__bs")).alias("business_days"))
