"""Running sums over a sorted key, exact quantiles and average ranks, all
without a window that pulls every row into one task.

Recipe (used by quantiles, equal-frequency cuts, ROC, rank tests, Spearman
correlation and stratified splits):

1. pre-aggregate to one row per distinct (group, value) with its weights; the
   partial aggregation also flattens a hot value into a single row;
2. a group of up to ``BUCKET_VALUES`` distinct values is one window;
3. the value range of each larger group is cut into B buckets at approximate quantiles
   of the distinct values (``percentile_approx``: one small row of bounds per
   large group), so a bucket holds about 1/B of the group's distinct values. The bucket
   is a deterministic function of the row, so every branch of the plan agrees;
4. running weight inside (group, bucket) by a window partitioned on both, so
   each window task sorts about 1/B of a group;
5. per (group, bucket) totals, at most large groups x B rows, become offsets by a
   window partitioned by group (or, with no group, over the B bucket rows), joined back.

Quantiles of a group with more than ``BUCKET_VALUES`` rows need no order of all its values: ``_narrowed`` counts the rows beside
approximate quantiles and orders only the values between the two that hold the rank sought.

Everything stays in the JVM (no Python worker, no checkpoint).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.checks import as_list, require_columns
from tessera.operators.groupjoin import join_by, settled
from tessera.session import scratch_dir

_ORDERABLE = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


#: Distinct values of a group that one task sorts; larger groups are cut into buckets.
BUCKET_VALUES = 200_000


def _below(bounds: Column, key: Column, steps: int) -> Column:
    """How many of the sorted bounds are smaller than the key, by bisection."""
    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less = F.coalesce(F.get(bounds, mid) < key, F.lit(False))
        go = s["lo"] < s["hi"]
        return F.struct(F.when(go & less, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(go & ~less, mid).otherwise(s["hi"]).alias("hi"))
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"]


#: Groups that are cut at most, the largest first; any other has at most a ten-thousandth of the rows.
LARGE_GROUPS = 10_000


def sorted_cumulative(df: DataFrame, order_col: str, weights, by=(), *,
                      buckets: int | None = None, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """For rows that are already one per distinct (by, order_col), add for every
    weight ``w`` the columns ``w_before`` (sum of ``w`` over rows of the same group
    with a smaller key) and ``w_total`` (group sum). NULL is a group like any other.

    Groups are windows, dealt once by group, so an aggregation by group that follows needs no
    exchange. Only groups with more than ``bucket_values`` rows are cut, into ``buckets``
    (by default the session's shuffle partitions) ranges of the key; text
    keys are cut by the number their first bytes make. Which groups these are is found in the same plan: their list
    (at most LARGE_GROUPS) is broadcast, and where it is empty Spark drops the whole branch."""
    weights, by = as_list(weights), as_list(by)
    require_columns(df, order_col, *weights, *by)
    nb = int(buckets or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, proxy = F.col(order_col), None
    if isinstance(df.schema[order_col].dataType, _ORDERABLE):
        proxy = key
    elif isinstance(df.schema[order_col].dataType, T.StringType):
        proxy = text_number(key)
    if nb <= 1 or proxy is None:
        return _whole_groups(df, key, weights, by)
    df = settled(df)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > bucket_values)
    if not by:
        held = df.withColumn("__proxy", proxy).crossJoin(F.broadcast(counts)).drop("__rows")
        return _cut_groups(df, held, df.withColumn("__proxy", proxy), key, weights, by, nb)
    large = counts.orderBy(F.desc("__rows")).limit(LARGE_GROUPS).select(*by, F.lit(True).alias("__large"))
    small = join_by(df, large, by, broadcast=True).where("__large is null").select(*df.columns)
    held = join_by(df, large, by, "inner", broadcast=True).drop("__large").withColumn("__proxy", proxy)
    return _whole_groups(small, key, weights, by).unionByName(_cut_groups(df, held, held, key, weights, by, nb))


def _whole_groups(df: DataFrame, key: Column, weights: list[str], by: list[str]) -> DataFrame:
    """Running sums by one window per group."""
    earlier = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    out = [F.col(c) for c in df.columns]
    for w in weights:
        zero = F.lit(0).cast(df.schema[w].dataType)
        out += [F.coalesce(F.sum(w).over(earlier), zero).alias(w + "_before"), F.sum(w).over(whole).alias(w + "_total")]
    return df.select(*out)


def _cut_groups(df: DataFrame, held: DataFrame, rows: DataFrame, key: Column, weights: list[str], by: list[str], nb: int) -> DataFrame:
    """Running sums of ``rows`` by one window per range of the key; the ranges come from the rows held (both with ``__proxy``). Without
    groups nothing is held of a small frame, whose rows are one range."""
    probs = [i / nb for i in range(1, nb)]
    bounds = held.groupBy(*by).agg(F.percentile_approx("__proxy", probs, max(10_000, 50 * nb)).alias("__bounds"))
    # the bounds of at most LARGE_GROUPS groups
    d = join_by(rows, bounds, by, broadcast=True)
    d = d.withColumn("__bkt", F.when(F.col("__bounds").isNull(), F.lit(0)).otherwise(
        _below(F.col("__bounds"), F.col("__proxy"), nb.bit_length() + 1))).drop("__bounds", "__proxy")
    run_w = Window.partitionBy(*by, "__bkt").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(w).over(run_w).alias("__run_" + w) for w in weights])
    stats = d.groupBy(*by, "__bkt").agg(*[F.sum(w).alias("__sum_" + w) for w in weights])
    prev = Window.partitionBy(*by).orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    cols = [*by, "__bkt"]
    for w in weights:
        cols += [F.coalesce(F.sum("__sum_" + w).over(prev), F.lit(0)).alias("__off_" + w),
                 F.sum("__sum_" + w).over(whole).alias(w + "_total")]
    stats = stats.select(*cols)
    # with groups: at most LARGE_GROUPS x buckets rows, left to AQE; without: at most ``nb`` rows
    joined = join_by(d, stats, [*by, "__bkt"], "inner", broadcast=not by)
    out = [F.col(c) for c in df.columns]
    for w in weights:
        before = F.col("__off_" + w) + F.col("__run_" + w) - F.col(w)
        out += [before.alias(w + "_before"), F.col(w + "_total")]
    return joined.select(*out)


def numbered(df: DataFrame, order, weights=()) -> DataFrame:
    """Rows with their ``position`` (1-based) in the order of ``order`` over the whole
    frame and, per weight ``w``, ``w_before`` (its sum over earlier rows) and ``w_total``.

    One sort over ranges of all order columns, written once so that every reader sees the same
    cut; a position is the row's place in its range plus the rows of earlier ranges (one row
    per range is broadcast). The order columns should tell rows apart: equal ones share a range."""
    weights = as_list(weights)
    scratch_dir(df.sparkSession)
    d = (df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
         .checkpoint().withColumn("__part", F.shiftright("__row", 33)))
    totals = d.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(w).alias(f"__sum_{w}") for w in weights])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    offsets = totals.select("__part", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__first"),
                            *[F.coalesce(F.sum(f"__sum_{w}").over(earlier), F.lit(0)).alias(f"__off_{w}") for w in weights],
                            *[F.sum(f"__sum_{w}").over(whole).alias(f"{w}_total") for w in weights])
    run = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[(F.sum(w).over(run) - F.col(w)).alias(f"__run_{w}") for w in weights])
    place = F.col("__row") - F.shiftleft("__part", 33)
    return d.join(F.broadcast(offsets), "__part").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("__first") + place + 1).alias("position"),
        *[x for w in weights for x in ((F.col(f"__off_{w}") + F.col(f"__run_{w}")).alias(f"{w}_before"), F.col(f"{w}_total"))])


def text_number(c: Column) -> Column:
    """A number that never decreases along the order of texts: their first six bytes."""
    return F.conv(F.substring(F.rpad(F.hex(F.encode(c, "UTF-8")), 12, "0"), 1, 12), 16, 10).cast("bigint")


def value_histogram(df: DataFrame, col: str, by=(), weight: str | None = None) -> DataFrame:
    """One row per distinct non-null (by, col) with its row count ``_n``."""
    by = as_list(by)
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(w.alias("_n"))


def _with_null_row(df: DataFrame, col: str, by) -> DataFrame:
    """The histogram with a NULL value of weight 0, so a group without values keeps its row."""
    return df.groupBy(*as_list(by), col).agg(F.count(col).alias("_n"))


#: Accuracy of the approximate quantiles between which ``_narrowed`` looks: their ranks are off by at most a share of 1/ACCURACY.
ACCURACY = 10_000

#: Probabilities that are narrowed in one plan at most; for more all values are ordered.
MOST_RANKS = 20


def _narrowed(df: DataFrame, col: str, probs: list[float], by: list[str], large: DataFrame) -> DataFrame:
    """The values of the large groups around the ranks of ``probs``, with their counts as ``sorted_cumulative`` has them.

    Two approximate quantiles around each probability part a group's rows into those below, between and above; they are counted, which
    tells exactly what part holds the rank sought, nearly always the one between (some 4/ACCURACY of the rows). Only its
    values are counted one by one and ordered, per group and probability (``__sought``). A poor approximation makes that part larger, never wrong.
    Raw rows are not shuffled, and each step takes the cuts from the one before, so all agree on them."""
    v, rows = F.col(f"`{col}`"), df.where(F.col(f"`{col}`").isNotNull()).select(*by, F.col(f"`{col}`"))
    near = [min(max(p + side * 2 / ACCURACY, 0.0), 1.0) for p in probs for side in (-1, 1)]
    cuts = (join_by(rows, large, by, "inner", broadcast=True).groupBy(*by)
            .agg(F.percentile_approx(v, near, ACCURACY).alias("__cuts"), F.max("_n_total").alias("_n_total"))
            .where(F.col("_n_total").isNotNull())
            .select(*by, "_n_total", *[F.get("__cuts", F.lit(j)).alias(f"__c{j}") for j in range(len(near))]))
    sums = [F.max("_n_total").alias("_n_total"), *[F.max(f"__c{j}").alias(f"__c{j}") for j in range(len(near))]]
    for i in range(len(probs)):
        sums += [F.count_if(v < F.col(f"__c{2 * i}")).alias(f"__lt{i}"), F.count_if(v <= F.col(f"__c{2 * i + 1}")).alias(f"__le{i}")]
    parts, kept = [], []
    for i, p in enumerate(probs):
        lt, le, h = F.col(f"__lt{i}"), F.col(f"__le{i}"), (F.col("_n_total") - 1).cast("double") * F.lit(p)
        first, last = (F.when(r < lt, 0).when(r < le, 1).otherwise(2) for r in (F.floor(h), F.ceil(h)))
        parts += [first.alias(f"__first{i}"), last.alias(f"__last{i}"),
                  F.when(first == 0, F.lit(0).cast("bigint")).when(first == 1, lt).otherwise(le).alias(f"__before{i}")]
        part = F.when(v < F.col(f"__c{2 * i}"), 0).when(v <= F.col(f"__c{2 * i + 1}"), 1).otherwise(2)
        kept.append(F.when(part.between(F.col(f"__first{i}"), F.col(f"__last{i}")),
                           F.struct(F.lit(i).alias("__sought"), F.col(f"__before{i}").alias("__before"))))
    ends = (join_by(rows, cuts, by, "inner", broadcast=True).groupBy(*by).agg(*sums).where(F.col("_n_total").isNotNull())
            .select(*by, "_n_total", *[f"__c{j}" for j in range(len(near))], *parts))
    found = join_by(rows, ends, by, "inner", broadcast=True)
    found = found.where(reduce(lambda a, b: a | b, [k.isNotNull() for k in kept])).select(
        *by, v, "_n_total", F.inline(F.array_compact(F.array(*kept))))
    hist = found.groupBy(*by, "__sought", v).agg(F.count(F.lit(1)).alias("_n"), F.max("__before").alias("__before"), F.max("_n_total").alias("_n_total"))
    earlier = Window.partitionBy(*by, "__sought").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    return hist.select(*by, "__sought", v, "_n", (F.col("__before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_n_before"), "_n_total")


def _values_at_ranks(df: DataFrame, col: str, probs: list[float], by: list[str], large_rows: int) -> DataFrame:
    """Distinct values with their running counts: all of a small group, those around the ranks sought of a large one."""
    if not isinstance(df.schema[col].dataType, _ORDERABLE) or len(probs) > MOST_RANKS:
        return sorted_cumulative(_with_null_row(df, col, by), col, ["_n"], by).withColumn("__sought", F.lit(None).cast("int"))
    df = settled(df.select(*by, F.col(f"`{col}`")))
    counts = df.groupBy(*by).agg(F.count(F.col(f"`{col}`")).alias("_n_total"))
    large = counts.where(F.col("_n_total") > large_rows)
    if by:
        large = large.orderBy(F.desc("_n_total"), *by).limit(LARGE_GROUPS)
        rest = join_by(df, large, by, broadcast=True).where("_n_total is null")
    else:
        rest = join_by(df, counts.where(F.col("_n_total") <= large_rows), by)
    hist = _with_null_row(rest.drop("_n_total"), col, by)
    small = _whole_groups(hist, F.col(f"`{col}`"), ["_n"], by).withColumn("__sought", F.lit(None).cast("int"))
    return small.unionByName(_narrowed(df, col, probs, by, large))


def exact_quantiles(df: DataFrame, col: str, probs, by=(), *, names=None,
                    count_name: str | None = None, large_rows: int = BUCKET_VALUES) -> DataFrame:
    """Linear-interpolation quantiles (position (n-1)p, the rule of R type 7 and
    of DuckDB ``quantile_cont``) per group; NULLs ignored, and NULL for a group
    without values. One row per group (NULL is a group) with one double column per probability (named ``names`` or ``q_<p>``), plus the
    group's non-NULL count when ``count_name`` is given. Groups with more than ``large_rows`` values are narrowed to those around the ranks
    sought (at most LARGE_GROUPS, the largest; found in the same plan, and without any Spark drops that branch)."""
    by, probs = as_list(by), [float(p) for p in as_list(probs)]
    names = as_list(names) or [f"q_{str(p).replace('.', '_')}" for p in probs]
    cum = _values_at_ranks(df, col, probs, by, large_rows)
    n = F.col("_n_total")
    before, cnt = F.col("_n_before"), F.col("_n")

    def covers(k: Column, i: int) -> Column:
        return (F.col("__sought").isNull() | (F.col("__sought") == i)) & (before <= k) & (k < before + cnt)

    parts = []
    for p in probs:
        h = (n - 1).cast("double") * F.lit(p)
        parts.append((h, F.floor(h), F.ceil(h)))
    aggs = []
    for i, (h, lo, hi) in enumerate(parts):
        aggs += [F.max(F.when(covers(lo, i), F.col(col))).cast("double").alias(f"_lo{i}"),
                 F.max(F.when(covers(hi, i), F.col(col))).cast("double").alias(f"_hi{i}"),
                 F.max(F.when(n > 0, h - lo)).alias(f"_d{i}")]
    if count_name:
        aggs.append(F.max(n).alias(count_name))
    agg = cum.groupBy(*by).agg(*aggs)
    outs = [F.col(b) for b in by] + ([F.col(count_name)] if count_name else [])
    for i, name in enumerate(names):
        lo_v, hi_v, d = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_d{i}")
        outs.append(F.when(d == 0, lo_v).otherwise(lo_v + (hi_v - lo_v) * d).alias(name))
    return agg.select(*outs)


#: Items kept by a quantile sketch; see ``sketch_rank_error``.
SKETCH_K = 2000


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """Largest rank error of a KLL sketch of ``k`` items, as a share of the rows, with 99 % confidence
    (the fit that the sketch's library publishes): 1.3 % for 200, 0.14 % for 2000."""
    return 2.296 / k ** 0.9723


def quantile_sketches(df: DataFrame, col: str, by=(), k: int = SKETCH_K) -> DataFrame:
    """One KLL sketch per group (NULL is a group): ``sketch`` (bytes) and ``n``, its non-NULL values; NULL without one.

    Built by partial aggregation, so a group of any size is some ``k`` numbers per task before the shuffle. Sketches
    can be stored and merged with those of other rows (``merged_sketches``). NaN are left out, as the sketch does."""
    by = as_list(by)
    x = F.col(f"`{col}`").cast("double")
    x = F.when(~F.isnan(x), x)
    g = df.groupBy(*by).agg(F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"), F.count(x).alias("n"))
    return g.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def merged_sketches(sketches: DataFrame, by=()) -> DataFrame:
    """The sketches of coarser groups, or of the same groups from several tables."""
    by = as_list(by)
    g = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return g.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def sketch_quantiles(sketches: DataFrame, probs, by=(), names=None, count_name: str | None = None) -> DataFrame:
    """Quantiles of sketches: values whose rank is within ``sketch_rank_error`` of p, NULL for a group without values."""
    by, probs = as_list(by), [float(p) for p in as_list(probs)]
    names = as_list(names) or [f"q_{str(p).replace('.', '_')}" for p in probs]
    known = F.col("sketch").isNotNull()
    return sketches.select(*by, *([F.col("n").alias(count_name)] if count_name else []),
                           *[F.when(known, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(n) for p, n in zip(probs, names)])


def quantiles(df: DataFrame, col: str, probs, by=(), *, names=None, sketch: int | None = None) -> DataFrame:
    """Exact quantiles, or with ``sketch`` those of KLL sketches of that many items."""
    if sketch is None:
        return exact_quantiles(df, col, probs, by, names=names)
    return sketch_quantiles(quantile_sketches(df, col, by, sketch), probs, by, names)


def average_ranks(df: DataFrame, col: str, by=()) -> DataFrame:
    """Per distinct non-NULL (by, col): ``_n`` rows, mid-rank ``avg_rank``
    (1-based, ties share the mean of their positions) and ``_n_total``."""
    hist = value_histogram(df, col, by)
    cum = sorted_cumulative(hist, col, ["_n"], by)
    return cum.withColumn("avg_rank", F.col("_n_before") + (F.col("_n") + 1) / 2.0)


def cut_bin(value: Column, cuts: list[Column]) -> Column:
    """1 + number of cut points strictly below the value (right-closed bins)."""
    terms = [F.when(c < value, 1).otherwise(0) for c in cuts]
    return F.when(value.isNull(), None).otherwise(reduce(lambda a, b: a + b, terms, F.lit(1)))
