"""Data profiling: column summaries, frequency tables, outlier fences,
correlations, information measures, target and score profiles, histogram and
box-plot data.

Each profile is one or two aggregate jobs over the table followed by work on
the small aggregated result. Long-form outputs come from ``unpivot`` of the
one-row aggregate, never from a loop of jobs per column.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.checks import as_list
from tessera.operators.groupjoin import join_by, join_rows_by, safe_corr
from tessera.operators.ranking import cut_bin, exact_quantiles, numbered, quantiles, sketch_quantiles, sorted_cumulative
from tessera.session import scratch_dir


def _long(df: DataFrame, cols, key=None, value_type: str = "double") -> DataFrame:
    """(key..., column, value) rows for the given columns."""
    key = as_list(key)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(value_type).alias("value")) for c in cols])
    return df.select(*key, F.explode(arr).alias("__kv")).select(*key, "__kv.column", "__kv.value")


def profile_table(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per column: type, rows, NULLs, zeros (numeric), NaN or infinite (floating),
    distinct non-NULL values. One aggregate over the table."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(df.schema.fields):  # named by number: a name may hold dots
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"{i}__null"))
        if isinstance(f.dataType, T.NumericType):
            aggs.append(F.count_if(c == 0).alias(f"{i}__zero"))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            aggs.append(F.count_if(F.isnan(c) | c.isin(float("inf"), float("-inf"))).alias(f"{i}__naninf"))
        d = F.approx_count_distinct(c) if approx_distinct else F.count_distinct(c)
        aggs.append(d.alias(f"{i}__distinct"))
    one = df.agg(*aggs)
    rows = []
    for i, f in enumerate(df.schema.fields):
        def g(suffix, i=i):
            name = f"{i}__{suffix}"
            return F.col(name).cast("bigint") if name in one.columns else F.lit(None).cast("bigint")
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                             F.col("__rows").alias("n_rows"), g("null").alias("n_null"), g("zero").alias("n_zero"),
                             g("naninf").alias("n_nan_inf"), g("distinct").alias("n_distinct")))
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


PROFILE_PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def profile_numeric(df: DataFrame, cols=None, sketch: int | None = None) -> DataFrame:
    """Per numeric column: n, mean, sd, cv, min, p01..p99, max, iqr, skewness,
    excess kurtosis. Quantiles are exact (distributed rank recipe), or with ``sketch`` those of a KLL sketch of that many items
    per column: then the whole profile is one aggregate of the table, without a copy of each row per column."""
    cols = as_list(cols) or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    # moments in one plain aggregate of the wide table; only exact quantiles need (column, value) rows
    parts = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max, "skewness": F.skewness, "kurtosis": F.kurtosis}
    if sketch is not None:
        parts["sketch"] = lambda c: F.kll_sketch_agg_double(F.when(~F.isnan(c), c), F.lit(sketch))
        parts["__known"] = lambda c: F.count(F.when(~F.isnan(c), c))
    one = df.agg(*[fn(F.col(f"`{c}`").cast("double")).alias(f"__{k}_{i}") for i, c in enumerate(cols) for k, fn in parts.items()])
    mom = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"__{k}_{i}").alias(k) for k in parts])
                                        for i, c in enumerate(cols)])))
    names = [f"p{int(round(p * 100)):02d}" for p in PROFILE_PROBS]
    if sketch is None:
        q = exact_quantiles(_long(df, cols), "value", list(PROFILE_PROBS), by=["column"], names=names)
        j = mom.join(q, "column", "left")
    else:
        mom = mom.withColumn("sketch", F.when(F.col("__known") > 0, F.col("sketch")))
        rest = [k for k in parts if k not in ("sketch", "__known")]
        j = sketch_quantiles(mom, PROFILE_PROBS, ["column", *rest], names)
    return j.select(
        "column", "n", "mean", "sd", F.try_divide(F.col("sd"), F.col("mean")).alias("cv"), "min", *names, "max",
        (F.col("p75") - F.col("p25")).alias("iqr"), "skewness", "kurtosis")


def freq_table(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """value, count, percent, cumulative percent; most frequent first (ties by
    value), NULL counted as a level. Levels are numbered by one sort over ranges of (count, level),
    so a column of once-only values is spread over all tasks."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    j = numbered(g, [F.col("n").desc(), F.col(col).asc_nulls_last()], ["n"])
    out = j.select(
        col, "n", (F.col("n") * 100.0 / F.col("n_total")).alias("pct"),
        ((F.col("n_before") + F.col("n")) * 100.0 / F.col("n_total")).alias("cum_pct"),
        F.col("position").cast("int").alias("position"))
    return out.where(F.col("position") <= top) if top else out


def outlier_fence(df: DataFrame, by, col: str, method: str = "tukey", k: float | None = None) -> DataFrame:
    """Adds ``lower``, ``upper`` and ``is_outlier``. Tukey: quartiles -/+ k*IQR
    (k = 1.5). MAD: median -/+ k * 1.4826 * MAD (k = 3)."""
    by = as_list(by)
    if method == "tukey":
        k = 1.5 if k is None else k
        q = exact_quantiles(df, col, [0.25, 0.75], by=by, names=["__q1", "__q3"])
        f = q.select(*by, (F.col("__q1") - k * (F.col("__q3") - F.col("__q1"))).alias("lower"),
                     (F.col("__q3") + k * (F.col("__q3") - F.col("__q1"))).alias("upper"))
    elif method == "mad":
        k = 3.0 if k is None else k
        scratch_dir(df.sparkSession)
        med = exact_quantiles(df, col, [0.5], by=by, names=["__med"]).checkpoint()  # read for the deviations and for the fences
        dev = join_rows_by(df, med, by).select(
            *by, F.abs(F.col(col) - F.col("__med")).alias("__dev"))
        mad = exact_quantiles(dev, "__dev", [0.5], by=by, names=["__mad"])
        both = join_by(med, mad, by)
        f = both.select(*by, (F.col("__med") - k * 1.4826 * F.col("__mad")).alias("lower"),
                        (F.col("__med") + k * 1.4826 * F.col("__mad")).alias("upper"))
    else:
        raise ValueError(f"method={method!r}")
    j = join_rows_by(df, f, by)
    return j.withColumn("is_outlier", (F.col(col) < F.col("lower")) | (F.col(col) > F.col("upper")))


def _pairwise_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with ``r<i>_<j>``: the mid-rank of column i among the rows where column j is known too.

    One run of the rank recipe serves all pairs: a value of column i is counted once per partner, over the
    rows where that partner is known, and the running sums of these counts are its ranks beside each
    partner. The rank table is written once; each column's part of it is then joined by value, and
    AQE broadcasts the parts its runtime statistics show to be small."""
    scratch_dir(df.sparkSession)
    known = [F.col(f"`{c}`").isNotNull().cast("bigint").alias(f"n{j}") for j, c in enumerate(cols)]
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("value"), *known)
                                        for i, c in enumerate(cols)])))
    counts = [f"n{j}" for j in range(len(cols))]
    hist = long.where(F.col("value").isNotNull()).groupBy("i", "value").agg(*[F.sum(n).alias(n) for n in counts])
    cum = sorted_cumulative(hist, "value", counts, by=["i"])
    ranks = cum.select("i", "value", *[(F.col(f"{n}_before") + (F.col(n) + 1) / 2.0).alias(f"r{n[1:]}") for n in counts]).checkpoint()
    src = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    for i in range(len(cols)):
        mine = ranks.where(F.col("i") == i).select(F.col("value").alias(f"c{i}"), *[F.col(f"r{j}").alias(f"r{i}_{j}") for j in range(len(cols)) if j != i])
        src = src.join(mine, f"c{i}", "left")
    return src


def correlations(df: DataFrame, cols, method: str = "pearson") -> DataFrame:
    """Long form (var1, var2, r) for every pair var1 before var2 in ``cols``, each
    over the rows where both are known; NULL where one is constant there.

    Spearman = Pearson on mid-ranks, where both columns are ranked among the rows
    that the pair uses, so a NULL in one column leaves its row out of the other's ranks."""
    cols = as_list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if method == "spearman":
        src = _pairwise_ranks(df, cols)
        sides = [(f"r{i}_{j}", f"r{j}_{i}") for i, j in pairs]
    elif method == "pearson":
        src = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
        sides = [(f"c{i}", f"c{j}") for i, j in pairs]
    else:
        raise ValueError(f"method={method!r}")
    one = src.agg(*[safe_corr(a, b).alias(f"p{n}") for n, (a, b) in enumerate(sides)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(cols[i]).alias("var1"), F.lit(cols[j]).alias("var2"), F.col(f"p{n}").alias("r"))
                                         for n, (i, j) in enumerate(pairs)])))


def _entropy_of(counts: DataFrame, by, n_col: str = "n") -> DataFrame:
    """-sum p log2 p per group ``by`` over the count column."""
    by = as_list(by)
    tot = counts.groupBy(*by).agg(F.sum(n_col).alias("__t"))
    j = join_by(counts, tot, by)
    p = F.col(n_col) / F.col("__t")
    return j.groupBy(*by).agg((-F.sum(p * F.log2(p))).alias("h"))


def info_measures(df: DataFrame, cols, target: str) -> DataFrame:
    """Per input column: entropy H(X), mutual information with the target
    I(X;Y) = H(X) + H(Y) - H(X,Y) (= information gain), and gain ratio I/H(X).
    NULL is a level. Base-2 logarithms."""
    cols = as_list(cols)
    long = _long(df, cols, key=[target], value_type="string")
    joint = long.groupBy("column", "value", target).agg(F.count(F.lit(1)).alias("n"))
    hx = _entropy_of(joint.groupBy("column", "value").agg(F.sum("n").alias("n")), ["column"]) \
        .withColumnRenamed("h", "hx")
    hxy = _entropy_of(joint, ["column"]).withColumnRenamed("h", "hxy")
    hy_counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    hy = _entropy_of(hy_counts, []).withColumnRenamed("h", "hy")
    out = hx.join(hxy, "column").crossJoin(F.broadcast(hy))
    mi = F.col("hx") + F.col("hy") - F.col("hxy")
    return out.select("column", F.col("hx").alias("entropy"), mi.alias("mutual_info"),
                      F.try_divide(mi, F.col("hx")).alias("gain_ratio"))


def target_profile(df: DataFrame, input_col: str, target: str, bins: int = 5) -> DataFrame:
    """Target rate per equal-frequency bin of the input."""
    names = [f"__c{i}" for i in range(1, bins)]
    cuts = exact_quantiles(df, input_col, [i / bins for i in range(1, bins)], names=names)
    b = df.crossJoin(F.broadcast(cuts)).withColumn("bin", cut_bin(F.col(input_col), [F.col(c) for c in names]))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("positives"),
                                F.avg(target).alias("rate"), F.min(input_col).alias("lo"),
                                F.max(input_col).alias("hi"))


def gain_lift(df: DataFrame, score: str, target: str, n: int = 10) -> DataFrame:
    """Cumulative gain and lift by score group (group 1 = highest scores). Groups
    come from cut points; the running sums run over the n group rows."""
    names = [f"__c{i}" for i in range(1, n)]
    cuts = exact_quantiles(df, score, [i / n for i in range(1, n)], names=names)
    b = df.crossJoin(F.broadcast(cuts)).withColumn(
        "grp", F.lit(n + 1) - cut_bin(F.col(score), [F.col(c) for c in names]))
    g = b.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(target).cast("bigint").alias("positives"))
    w = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, 0)
    wall = Window.partitionBy(F.lit(1))
    cum_n, cum_p = F.sum("n").over(w), F.sum("positives").over(w)
    tot_n, tot_p = F.sum("n").over(wall), F.sum("positives").over(wall)
    return g.select("grp", "n", "positives", cum_n.alias("cum_n"), cum_p.alias("cum_positives"),
                    F.try_divide(cum_p, tot_p).alias("gain"),
                    F.try_divide(cum_p / cum_n, tot_p / tot_n).alias("lift"))


def histogram_bins(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Counts in ``bins`` equal-width bins between min and max (the maximum falls
    in the last bin); empty bins kept."""
    x = F.col(col)
    rng = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    # a constant column has no width: all its rows are in bin 1
    share = F.coalesce(F.try_divide(x - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    idx = F.least(F.floor(share * bins) + 1, F.lit(bins))
    cnt = df.where(x.isNotNull()).crossJoin(F.broadcast(rng)).groupBy(idx.cast("int").alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"))
    spine = rng.select("__lo", "__hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    return spine.join(cnt, "bin", "left").select(
        "bin", (F.col("__lo") + (F.col("bin") - 1) * width).alias("lo"),
        (F.col("__lo") + F.col("bin") * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def box_summary(df: DataFrame, by, col: str, sketch: int | None = None) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 IQR of the box) and
    number of points outside them, per group; with ``sketch`` quartiles of KLL sketches of that many items."""
    by = as_list(by)
    q = quantiles(df, col, [0.25, 0.5, 0.75], by=by, names=["q1", "median", "q3"], sketch=sketch)
    j = join_rows_by(df, q, by)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    x = F.col(col)
    return j.groupBy(*by, "q1", "median", "q3").agg(
        F.count(x).alias("n"), F.min(F.when(x >= lo, x)).alias("whisker_lo"),
        F.max(F.when(x <= hi, x)).alias("whisker_hi"),
        F.count_if((x < lo) | (x > hi)).alias("n_out"))


__all__ = ["profile_table", "profile_numeric", "freq_table", "outlier_fence", "correlations",
           "info_measures", "target_profile", "gain_lift", "histogram_bins", "box_summary"]
