"""Joins: mutating, filtering, nested, completion, as-of and range.

Spark chooses the physical join (broadcast hash, shuffled hash, sort-merge)
from statistics and AQE; nothing here hints a broadcast unless the side's row
count is fixed or has been checked.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.checks import as_list, require_columns
from tessera.operators.groupjoin import BROADCAST_ROWS, join_by


def _pairs(on):
    """``on`` as [(left, right)]: names shared by both sides, or (l, r) tuples."""
    out = []
    for o in as_list(on):
        out.append(tuple(o) if isinstance(o, (tuple, list)) else (o, o))
    return out


def join_mutating(left: DataFrame, right: DataFrame, on, how: str = "inner",
                  suffix=("_x", "_y")) -> DataFrame:
    """inner/left/right/full equi-join. Key columns with one name on both sides
    come out once (coalesced for full joins); other clashing names get suffixes."""
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"how={how!r}")
    pairs = _pairs(on)
    require_columns(left, *[a for a, _ in pairs])
    require_columns(right, *[b for _, b in pairs])
    same_keys = {a for a, b in pairs if a == b}
    clash = (set(left.columns) & set(right.columns)) - same_keys
    lsel = [F.col(c).alias(c + suffix[0] if c in clash else c) for c in left.columns]
    rsel = [F.col(c).alias(("__r_" + c) if c in same_keys else (c + suffix[1] if c in clash else c))
             for c in right.columns]
    lx, rx = left.select(*lsel), right.select(*rsel)

    def lname(a):
        return a + suffix[0] if a in clash else a

    def rname(b):
        return "__r_" + b if b in same_keys else (b + suffix[1] if b in clash else b)

    cond = reduce(lambda x, y: x & y, [lx[lname(a)] == rx[rname(b)] for a, b in pairs])
    j = lx.join(rx, cond, how)
    cols = []
    for c in left.columns:
        if c in same_keys:
            if how in ("right",):
                cols.append(F.col("__r_" + c).alias(c))
            elif how == "full":
                cols.append(F.coalesce(F.col(c), F.col("__r_" + c)).alias(c))
            else:
                cols.append(F.col(c))
        else:
            cols.append(F.col(lname(c)))
    for c in right.columns:
        if c in same_keys:
            continue
        cols.append(F.col(rname(c)))
    return j.select(*cols)


def join_filtering(left: DataFrame, right: DataFrame, on, how: str = "semi") -> DataFrame:
    """Left rows with (semi) or without (anti) a match; never duplicates rows."""
    if how not in ("semi", "anti"):
        raise ValueError(f"how={how!r}")
    pairs = _pairs(on)
    r = right.select(*[F.col(b).alias("__k_" + a) for a, b in pairs])
    cond = reduce(lambda x, y: x & y, [left[a] == r["__k_" + a] for a, _ in pairs])
    return left.join(r, cond, "left_semi" if how == "semi" else "left_anti")


def join_nested(left: DataFrame, right: DataFrame, on, name: str = "data", parts: int = 1) -> DataFrame:
    """Right matches nested as an array of structs per left row.

    With ``parts``, a key's matches come in that many hash parts (``<name>_part``), each an
    output row of its own, at every size alike: choose it where a key may have
    too many matches for one array. Left rows without a match get one row with
    an empty array.
    """
    pairs = _pairs(on)
    rkeys = [b for _, b in pairs]
    payload = [c for c in right.columns if c not in rkeys]
    part = F.pmod(F.xxhash64(*[F.col(c) for c in right.columns]), F.lit(parts)) if parts > 1 else F.lit(0).cast("bigint")
    nested = right.withColumn("__part", part).groupBy(*rkeys, "__part").agg(
        F.collect_list(F.struct(*[F.col(c) for c in payload])).alias(name))
    cond = reduce(lambda x, y: x & y, [left[a] == nested[b] for a, b in pairs])
    j = left.join(nested, cond, "left")
    return j.select(*[left[c] for c in left.columns],
                    F.coalesce(nested["__part"], F.lit(0).cast("bigint")).alias(name + "_part"),
                    F.coalesce(nested[name], F.array().cast(nested.schema[name].dataType)).alias(name))


def expand_complete(df: DataFrame, cols, fill: dict | None = None, max_rows: int = 1_000_000_000) -> DataFrame:
    """Every combination of the distinct values of ``cols``, joined to the data;
    combinations absent from the data get ``fill`` values (or NULL).

    The result has as many rows as the product of the level sets: their
    sizes are counted, and a product above ``max_rows`` is an error. A level
    set is broadcast up to ``BROADCAST_ROWS`` levels."""
    cols = as_list(cols)
    require_columns(df, *cols)
    sets = [df.select(c).distinct() for c in cols]
    sizes = [lv.count() for lv in sets]
    if math.prod(sizes) > max_rows:
        raise ValueError(f"the levels of {cols} ({sizes}) make more than {max_rows} combinations")
    # the largest set leads, so the sets that are broadcast are the small ones
    order = sorted(range(len(cols)), key=lambda i: -sizes[i])
    spine = sets[order[0]]
    for i in order[1:]:
        spine = spine.crossJoin(F.broadcast(sets[i]) if sizes[i] <= BROADCAST_ROWS else sets[i])
    spine = spine.select(*[F.col(c).alias("__s_" + c) for c in cols])
    data = df.select(*[F.col(c).alias("__d_" + c) for c in df.columns])
    cond = reduce(lambda x, y: x & y, [F.col("__s_" + c).eqNullSafe(F.col("__d_" + c)) for c in cols])
    out = spine.join(data, cond, "left").select(
        *[F.col("__s_" + c).alias(c) for c in cols],
        *[F.col("__d_" + c).alias(c) for c in df.columns if c not in cols])
    return out.fillna(fill) if fill else out


# ------------------------------------------------------------------- as-of
def epoch_seconds(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


#: Rows of one key that one task of an as-of join sorts, when the bucket is chosen from the data.
ASOF_BUCKET_ROWS = 200_000


def _asof_bucket(left: DataFrame, right: DataFrame, by, ts: str, right_ts: str) -> int:
    both = left.select(*by, epoch_seconds(ts).alias("__t")).unionByName(right.select(*by, epoch_seconds(right_ts).alias("__t")))
    rate = F.count("__t") / (F.max("__t") - F.min("__t") + 1)
    top = both.groupBy(*by).agg(rate.alias("r")).agg(F.max("r")).first()[0]  # rows a second of the busiest key
    return max(1, int(ASOF_BUCKET_ROWS / top)) if top else 86_400


def join_asof(left: DataFrame, right: DataFrame, by, ts: str, right_cols,
              right_ts: str | None = None, bucket_seconds: int | None = None,
              prefix: str = "r_") -> DataFrame:
    """For each left row, the last right row with the same ``by`` key and
    ``right_ts <= ts`` (a right row at the same instant counts). Left rows
    without one keep NULLs.

    Skew-safe recipe: time is cut into buckets. Inside a (key, bucket) a
    window over the tagged union finds the match; a left row with none in its
    bucket takes the latest right row of earlier buckets, found from a
    per-(key, bucket) maximum (partial aggregation, so a hot key is reduced
    map-side) and a window over buckets of the key. Without ``bucket_seconds``
    one counting job makes the buckets so long that the busiest key has about
    ``ASOF_BUCKET_ROWS`` rows in one. A NULL key or time matches nothing.
    """
    by, right_cols = as_list(by), as_list(right_cols)
    right_ts = right_ts or ts
    require_columns(left, *by, ts)
    require_columns(right, *by, right_ts, *right_cols)
    rnames = [prefix + c for c in right_cols]
    rts_name = prefix + right_ts
    lcols = left.columns
    bw = F.lit(bucket_seconds or _asof_bucket(left, right, by, ts, right_ts))

    l = left.withColumn("__b", F.floor(epoch_seconds(ts) / bw)).withColumn("__tag", F.lit(1))
    r = right.select(*[F.col(c) for c in by],
                     F.col(right_ts).alias("__t"),
                     F.struct(F.col(right_ts).alias(rts_name),
                              *[F.col(c).alias(n) for c, n in zip(right_cols, rnames)]).alias("__r")) \
        .withColumn("__b", F.floor(epoch_seconds("__t") / bw))

    # 1. match inside the bucket
    lu = l.select(*[F.col(c) for c in by], "__b", F.col(ts).alias("__t"), F.lit(1).alias("__tag"),
                  F.struct(*[F.col(c) for c in lcols]).alias("__l"),
                  F.lit(None).cast(r.schema["__r"].dataType).alias("__r"))
    ru = r.select(*[F.col(c) for c in by], "__b", "__t", F.lit(0).alias("__tag"),
                  F.lit(None).cast(lu.schema["__l"].dataType).alias("__l"), "__r")
    w_in = (Window.partitionBy(*by, "__b").orderBy("__t", "__tag")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = (lu.unionByName(ru)
              .withColumn("__m", F.last("__r", ignorenulls=True).over(w_in))
              .where("__tag = 1"))

    # 2. latest right row of earlier buckets, per (key, bucket)
    last_b = r.groupBy(*by, "__b").agg(F.max_by("__r", "__t").alias("__r"))
    lb = l.select(*by, "__b").distinct().withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType))
    w_prev = Window.partitionBy(*by).orderBy("__b").rangeBetween(Window.unboundedPreceding, -1)
    carry = (last_b.withColumn("__tag", F.lit(0))
             .unionByName(lb.withColumn("__tag", F.lit(1)))
             .withColumn("__c", F.last("__r", ignorenulls=True).over(w_prev))
             .where("__tag = 1").select(*by, "__b", "__c"))

    j = join_by(inside, carry, [*by, "__b"])
    m = F.coalesce(F.col("__m"), F.col("__c"))
    known = reduce(lambda x, y: x & y, [F.col("__l." + c).isNotNull() for c in [*by, ts]], F.lit(True))
    m = F.when(known, m)  # a NULL key or time matches nothing
    return j.select(*[F.col("__l." + c).alias(c) for c in lcols],
                    m.getField(rts_name).alias(rts_name),
                    *[m.getField(n).alias(n) for n in rnames])


# ------------------------------------------------------------------- range
#: A level's cells are this many times as long as those of the level below.
CELL_FACTOR = 8
#: Levels from one second to some 270 years.
CELL_LEVELS = 12


def join_range(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str,
               on=(), bucket_seconds: int = 1, closed: str = "left") -> DataFrame:
    """Point-in-interval join: pairs with ``lo <= point < hi`` (``closed='left'``)
    or ``lo <= point <= hi`` (``'both'``), plus optional equality keys ``on``.

    A multi-level time index: the cells of level 0 are ``bucket_seconds`` long, those of
    each further level ``CELL_FACTOR`` times as long. An interval is put on the level whose cells are just
    not longer than it, so it touches at most ``CELL_FACTOR + 1`` of them at any length (longer
    ones than the last level's: as many as its length asks for). A point comes once per level that has intervals;
    these few numbers are a scalar subquery of the same plan, nothing is counted before. Pairs meet by equality of
    (``on``, level, cell) in exactly one cell, so the plan is a hash or sort-merge join, whose skew AQE splits,
    never a nested loop. NULL points, ends and keys match nothing."""
    on = as_list(on)
    require_columns(points, point, *on)
    require_columns(intervals, lo, hi, *on)
    clash = (set(points.columns) & set(intervals.columns)) - set(on)
    if clash:
        raise ValueError(f"rename clashing columns first: {sorted(clash)}")
    sizes = [bucket_seconds * CELL_FACTOR ** k for k in range(CELL_LEVELS)]
    size_of = F.array(*[F.lit(s).cast("bigint") for s in sizes])
    start, end = F.floor(epoch_seconds(lo)), F.floor(epoch_seconds(hi))
    level = reduce(lambda x, k: F.when(end - start >= sizes[k], k).otherwise(x), range(1, CELL_LEVELS), F.lit(0))
    iv = intervals.where(F.col(hi) >= F.col(lo)).withColumn("__level", level)
    cell = F.get(size_of, F.col("__level"))
    iv = iv.withColumn("__b", F.explode(F.sequence(F.floor(start / cell), F.floor(end / cell))))
    used = intervals.where(F.col(hi) >= F.col(lo)).agg(F.collect_set(level).alias("__levels"))
    p = points.withColumn("__level", F.explode(used.scalar()))
    p = p.withColumn("__b", F.floor(F.floor(epoch_seconds(point)) / cell))
    j = p.join(iv, [*on, "__level", "__b"])
    upper = (F.col(point) < F.col(hi)) if closed == "left" else (F.col(point) <= F.col(hi))
    return j.where((F.col(point) >= F.col(lo)) & upper).drop("__b", "__level")
