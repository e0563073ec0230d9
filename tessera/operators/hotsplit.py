"""Ordered windows that split hot groups.

A window partitioned by a key sends all rows of that key to one task. When one
key holds a large share of the rows (a third, say), that task does a third of
the work. Here groups with more than ``hot_rows`` rows are cut into pieces
along the first order column (at approximate quantiles of that group), the
window runs per (group, piece), and what a row needs from earlier pieces is a
per-piece aggregate carried forward by a window over the pieces of the group
(a table of groups x pieces rows). Ordinary groups form a single piece.

The piece of a row is a deterministic function of the row and two small
broadcast tables (the hot groups and their cut points), so recomputation
after a lost executor gives the same pieces.

Which groups are hot is decided in the plan: one aggregate counts the rows per group, its short
list of hot groups is broadcast, ordinary groups take the plain one-window-per-group branch, and Spark drops the
other branch at run time when the list is empty. No job runs while a query is built,
unless its input is itself such a plan, which is then written once (``settled``). With hot
groups, their cut points take one more pass over their rows. ``hot_rows=None`` leaves the count out where no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.checks import as_list
from tessera.operators.groupjoin import join_by, settled
from tessera.operators.ranking import text_number

HOT_ROWS = 5_000_000
PIECES = 64


def _first_order(order) -> tuple[str, bool]:
    o = as_list(order)[0]
    if not isinstance(o, str):
        raise ValueError("hot-group splitting needs column names in the order list")
    return (o[1:], True) if o.startswith("-") else (o, False)


def order_spec(order) -> list[Column]:
    out = []
    for o in as_list(order):
        out.append(F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_first())
    return out


#: Groups that are split at most, the largest first; any other has at most a twenty-thousandth of the rows.
HOT_GROUPS = 20_000


def _by_heat(df: DataFrame, by, hot_rows: int | None, plain, split) -> DataFrame:
    """``plain`` of the rows of ordinary groups and ``split`` of those of groups with more than ``hot_rows`` rows.

    Which groups are hot is found in the plan itself, by one aggregate (partial counts per group) whose list of at most HOT_GROUPS
    groups is broadcast to both sides; where it is empty, Spark drops the split side. ``hot_rows=None`` splits nothing and counts nothing."""
    if hot_rows is None:
        return plain(df)
    df = settled(df)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__cnt")).where(F.col("__cnt") > hot_rows)
    if not by:  # one group: all rows or none
        one = F.broadcast(counts.select(F.lit(1).alias("__one")))
        return plain(df.join(one, F.lit(1) == F.col("__one"), "left_anti")).unionByName(
            split(df.join(one, F.lit(1) == F.col("__one"), "left_semi")))
    hot = counts.orderBy(F.desc("__cnt")).limit(HOT_GROUPS).select(*by, F.lit(True).alias("__hot"))
    ordinary = join_by(df, hot, by, broadcast=True).where("__hot is null").drop("__hot")
    return plain(ordinary).unionByName(split(join_by(df, hot, by, "inner", broadcast=True).drop("__hot")))


def split_groups(df: DataFrame, by, order, pieces: int = PIECES) -> DataFrame:
    """Adds ``__piece``: the piece of the group's range of the first order column (pieces
    increase along the window order). Every group is cut; there are at most HOT_GROUPS."""
    by = as_list(by)
    col, desc = _first_order(order)
    probs = [i / pieces for i in range(1, pieces)]
    # texts are cut by the number their first bytes make, which follows their order
    key = text_number(F.col(col)) if isinstance(df.schema[col].dataType, T.StringType) else F.col(col)
    src = df.withColumn("__order", key)
    bounds = src.groupBy(*by).agg(F.percentile_approx("__order", probs, 10_000).alias("__bounds"))
    d = join_by(src, bounds, by, broadcast=True) if by else _cross_left(src, bounds)
    me = F.col("__order")
    cmp = (lambda b: b > me) if desc else (lambda b: b < me)
    # NULL comes first in ascending order and last in descending order
    piece = F.when(F.col("__bounds").isNull(), F.lit(0)).when(me.isNull(), F.lit(pieces if desc else 0)).otherwise(
        F.size(F.filter("__bounds", cmp)))
    return d.withColumn("__piece", piece).drop("__bounds", "__order")


def _cross_left(df: DataFrame, one_or_none: DataFrame) -> DataFrame:
    """df with the columns of a table of at most one row (NULLs when empty)."""
    return df.join(F.broadcast(one_or_none.withColumn("__k", F.lit(1))),
                   F.lit(1) == F.col("__k"), "left").drop("__k")


_PIECE_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
              "any": F.bool_or, "all": F.bool_and}
_CARRY = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "any": F.bool_or, "all": F.bool_and}


def running(df: DataFrame, by, order, aggs: dict, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running aggregates from the first row of the group to the current row.
    ``aggs``: {name: (kind, Column)} with kind in sum, count, min, max, any, all."""
    by = as_list(by)
    w = Window.partitionBy(*by).orderBy(*order_spec(order)).rowsBetween(Window.unboundedPreceding, 0)
    return _by_heat(df, by, hot_rows, lambda d: d.select(*df.columns, *[_PIECE_AGG[k](c).over(w).alias(n) for n, (k, c) in aggs.items()]),
                    lambda d: _running_split(d, by, order, aggs))


def _running_split(df: DataFrame, by, order, aggs: dict) -> DataFrame:
    d = split_groups(df, by, order)
    w = Window.partitionBy(*by, "__piece").orderBy(*order_spec(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[_PIECE_AGG[k](c).over(w).alias(f"__in_{n}") for n, (k, c) in aggs.items()])
    pieces = d.groupBy(*by, "__piece").agg(*[_PIECE_AGG[k](c).alias(f"__p_{n}") for n, (k, c) in aggs.items()])
    prev = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.select(*by, "__piece", *[_CARRY[k](f"__p_{n}").over(prev).alias(f"__c_{n}")
                                            for n, (k, _) in aggs.items()])
    j = join_by(d, carry, [*by, "__piece"])
    out = []
    for n, (k, _) in aggs.items():
        c, i = F.col(f"__c_{n}"), F.col(f"__in_{n}")
        if k in ("sum", "count"):
            v = F.coalesce(c, F.lit(0)) + i if k == "count" else F.when(c.isNull(), i).when(i.isNull(), c).otherwise(c + i)
        elif k == "min":
            v = F.least(c, i)
        elif k == "max":
            v = F.greatest(c, i)
        elif k == "any":
            v = F.when(c.isNull(), i).when(i.isNull(), c).otherwise(c | i)
        else:
            v = F.when(c.isNull(), i).when(i.isNull(), c).otherwise(c & i)
        out.append(v.alias(n))
    drop = [f"__in_{n}" for n in aggs] + [f"__c_{n}" for n in aggs] + ["__piece"]
    return j.select(*[x for x in j.columns if x not in drop], *out)


def ranks(df: DataFrame, by, order, kinds, ntile: int = 4, hot_rows: int = HOT_ROWS) -> DataFrame:
    """row_number, rank, dense_rank, percent_rank, cume_dist, ntile with hot
    groups split: each is the rank inside the piece plus counts carried from
    earlier pieces (ties of the full order key never straddle two pieces)."""
    by = as_list(by)
    kinds = as_list(kinds)
    spec = order_spec(order)
    w = Window.partitionBy(*by).orderBy(*spec)
    fns = {"row_number": F.row_number(), "rank": F.rank(), "dense_rank": F.dense_rank(),
           "percent_rank": F.percent_rank(), "cume_dist": F.cume_dist(), "ntile": F.ntile(ntile)}
    return _by_heat(df, by, hot_rows, lambda d: d.select(*df.columns, *[fns[k].over(w).alias(k) for k in kinds]),
                    lambda d: _ranks_split(d, by, order, spec, kinds, ntile))


def _ranks_split(df: DataFrame, by, order, spec, kinds, ntile: int) -> DataFrame:
    d = split_groups(df, by, order)
    w = Window.partitionBy(*by, "__piece").orderBy(*spec)
    peers = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select("*", F.row_number().over(w).alias("__rn"), F.rank().over(w).alias("__rk"),
                 F.dense_rank().over(w).alias("__dr"), F.count(F.lit(1)).over(peers).alias("__le"))
    # a struct counts NULL fields as values
    okey = F.struct(*[F.col(o.lstrip("-")) for o in as_list(order)])
    pieces = d.groupBy(*by, "__piece").agg(F.count(F.lit(1)).alias("__pn"), F.count_distinct(okey).alias("__pd"))
    prev = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carry = pieces.select(*by, "__piece", F.coalesce(F.sum("__pn").over(prev), F.lit(0)).alias("__cn"),
                          F.coalesce(F.sum("__pd").over(prev), F.lit(0)).alias("__cd"),
                          F.sum("__pn").over(whole).alias("__N"))
    j = join_by(d, carry, [*by, "__piece"])
    rn = (F.col("__cn") + F.col("__rn")).cast("int")
    rk = (F.col("__cn") + F.col("__rk")).cast("int")
    n = F.col("__N")
    size, rem = F.floor(n / ntile), n % ntile
    big = rem * (size + 1)
    nt = F.when(rn <= big, F.floor((rn - 1) / (size + 1)) + 1).otherwise(
        rem + F.floor((rn - 1 - big) / size) + 1).cast("int")
    cols = {"row_number": rn, "rank": rk, "dense_rank": (F.col("__cd") + F.col("__dr")).cast("int"),
            "percent_rank": F.when(n > 1, (rk - 1) / (n - 1)).otherwise(F.lit(0.0)),
            "cume_dist": (F.col("__cn") + F.col("__le")) / n, "ntile": nt}
    keep = [c for c in df.columns]
    return j.select(*keep, *[cols[k].alias(k) for k in kinds])


def with_halo(df: DataFrame, by, order, before: int, after: int, cols_fn, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Row-frame windows (lag, lead, k-row rolling) with hot groups split.

    Each piece is extended with a halo: the ``before`` rows that precede it
    and the ``after`` rows that follow it in its group, taken from the tails
    and heads of neighbouring pieces (at most before/after rows per piece, so
    the carried arrays are bounded). ``cols_fn(w)`` returns the new columns
    for a Window ``w`` over (group, piece) in the requested order; halo rows
    only serve as context and are dropped from the output."""
    by = as_list(by)

    def split(d):
        w = Window.partitionBy(*by, "__piece").orderBy(*order_spec(order))
        return _pieces_with_halo(d, by, order, before, after).select(*df.columns, "__halo", *cols_fn(w)).where("__halo = 0").drop("__halo")

    return _by_heat(df, by, hot_rows, lambda d: d.select(*df.columns, *cols_fn(Window.partitionBy(*by).orderBy(*order_spec(order)))), split)


def halo_rows(df: DataFrame, by, order, before: int, after: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The rows with ``__piece`` and ``__halo`` (1 for the rows that a piece has only as context)."""
    by = as_list(by)
    return _by_heat(df, by, hot_rows, lambda d: d.select("*", F.lit(0).alias("__piece"), F.lit(0).alias("__halo")),
                    lambda d: _pieces_with_halo(d, by, order, before, after))


def _pieces_with_halo(df: DataFrame, by: list[str], order, before: int, after: int) -> DataFrame:
    d = split_groups(df, by, order)
    spec = order_spec(order)
    wp = Window.partitionBy(*by, "__piece")
    d = d.withColumn("__rn", F.row_number().over(wp.orderBy(*spec))) \
        .withColumn("__pcnt", F.count(F.lit(1)).over(wp))
    row = F.struct(*[F.col(c) for c in df.columns])
    parts = [d.select(*df.columns, "__piece", F.lit(0).alias("__halo"))]
    pieces = d.groupBy(*by, "__piece").agg(
        F.sort_array(F.collect_list(F.when(F.col("__rn") > F.col("__pcnt") - before,
                                           F.struct(F.col("__rn").alias("k"), row.alias("r"))))).alias("__tail"),
        F.sort_array(F.collect_list(F.when(F.col("__rn") <= after,
                                           F.struct(F.col("__rn").alias("k"), row.alias("r"))))).alias("__head"))
    over = Window.partitionBy(*by).orderBy("__piece")
    if before > 0:
        prev = over.rowsBetween(Window.unboundedPreceding, -1)
        # previous pieces' tails in piece order, flattened; keep the last `before`
        seq = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__piece").alias("p"),
                                                                         F.col("__tail").alias("t"))).over(prev)),
                                    lambda s: s["t"]))
        h = pieces.select(*by, "__piece", seq.alias("__seq")).where(F.size("__seq") > 0)
        start = F.greatest(F.size("__seq") - before + 1, F.lit(1))
        h = h.select(*by, "__piece", F.explode(F.slice("__seq", start, F.lit(before))).alias("__x"))
        parts.append(h.select(*[F.col("__x.r." + c).alias(c) for c in df.columns], "__piece",
                              F.lit(1).alias("__halo")))
    if after > 0:
        nxt = over.rowsBetween(1, Window.unboundedFollowing)
        seq = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__piece").alias("p"),
                                                                         F.col("__head").alias("t"))).over(nxt)),
                                    lambda s: s["t"]))
        h = pieces.select(*by, "__piece", seq.alias("__seq")).where(F.size("__seq") > 0)
        h = h.select(*by, "__piece", F.explode(F.slice("__seq", F.lit(1), F.lit(after))).alias("__x"))
        parts.append(h.select(*[F.col("__x.r." + c).alias(c) for c in df.columns], "__piece",
                              F.lit(1).alias("__halo")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u


def with_time_halo(df: DataFrame, by, ts: str, span_seconds: int, cols_fn, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Time-range windows (a frame reaching ``span_seconds`` back) with hot
    groups split into pieces along ``ts``. A row is copied, as context only,
    into each later piece of its group that starts less than the span after
    it; ``cols_fn(partition_cols)`` returns the new columns, given the
    partition columns to use in the window. Copies per row are bounded by the
    number of pieces; they are dropped from the output."""
    by = as_list(by)
    return _by_heat(df, by, hot_rows, lambda d: d.select(*df.columns, *cols_fn(by)), lambda d: _time_split(d, by, ts, span_seconds, cols_fn))


def _time_split(df: DataFrame, by, ts: str, span_seconds: int, cols_fn) -> DataFrame:
    d = split_groups(df, by, [ts])
    secs = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            F.col(ts).cast("timestamp_ntz"))
    starts = d.where(F.col("__piece") > 0).groupBy(*by, "__piece").agg(F.min(secs).alias("__s")) \
        .groupBy(*by).agg(F.collect_list(F.struct(F.col("__piece").alias("p"), F.col("__s").alias("s")))
                          .alias("__starts"))
    # at most HOT_GROUPS groups x PIECES entries
    j = join_by(d, starts, by) if by else _cross_left(d, starts)
    j = j.withColumn("__starts", F.coalesce("__starts", F.array().cast(starts.schema["__starts"].dataType)))
    me = secs
    targets = F.filter("__starts", lambda x: (x["p"] > F.col("__piece")) & (x["s"] - span_seconds <= me))
    halo = j.select(*df.columns, F.explode(targets).alias("__t")).select(
        *df.columns, F.col("__t.p").alias("__piece"), F.lit(1).alias("__halo"))
    u = d.select(*df.columns, "__piece", F.lit(0).alias("__halo")).unionByName(halo)
    return u.select(*df.columns, "__halo", *cols_fn([*by, "__piece"])).where("__halo = 0").drop("__halo")


def fill_forward(df: DataFrame, by, order, col: str, name: str, max_gap: int | None = None,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Last non-NULL value at or before each row (optionally only within
    ``max_gap`` rows), with hot groups split into pieces."""
    by = as_list(by)

    def plain(d):
        w = Window.partitionBy(*by).orderBy(*order_spec(order))
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("__rn", F.row_number().over(w))
        d = d.withColumn("__kn", F.when(F.col(col).isNotNull(), F.col("__rn")))
        val = F.last(col, ignorenulls=True).over(upto)
        if max_gap is not None:
            val = F.when(F.col("__rn") - F.last("__kn", ignorenulls=True).over(upto) <= max_gap, val)
        return d.select(*df.columns, val.alias(name))

    return _by_heat(df, by, hot_rows, plain, lambda d: _fill_split(d, by, order, col, name, max_gap))


def _fill_split(df: DataFrame, by, order, col: str, name: str, max_gap: int | None) -> DataFrame:
    d = split_groups(df, by, order)
    w = Window.partitionBy(*by, "__piece").orderBy(*order_spec(order))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__rn", F.row_number().over(w))
    d = d.withColumn("__kn", F.when(F.col(col).isNotNull(), F.col("__rn")))
    d = d.select("*", F.last(col, ignorenulls=True).over(upto).alias("__lv"),
                 F.last("__kn", ignorenulls=True).over(upto).alias("__lk"))
    pieces = d.groupBy(*by, "__piece").agg(
        F.count(F.lit(1)).alias("__pn"),
        F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col("__rn"))).alias("__pv"),
        F.max("__kn").alias("__pk"))
    prev = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__pn").over(prev), F.lit(0))
    pieces = pieces.select(*by, "__piece", "__pn", "__pv", "__pk", start.alias("__start"))
    last_known = pieces.select(*by, "__piece", "__start",
                               F.last("__pv", ignorenulls=True).over(prev).alias("__cv"),
                               F.last(F.col("__start") + F.col("__pk"), ignorenulls=True).over(prev).alias("__ck"))
    j = join_by(d, last_known, [*by, "__piece"])
    val = F.coalesce(F.col("__lv"), F.col("__cv"))
    if max_gap is not None:
        here = F.col("__start") + F.col("__rn")
        src = F.coalesce(F.col("__start") + F.col("__lk"), F.col("__ck"))
        val = F.when(here - src <= max_gap, val)
    return j.select(*df.columns, val.alias(name))
