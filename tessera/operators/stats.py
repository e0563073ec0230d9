"""Statistical tests, metrics and linear models computed from aggregates.

Pattern: one or two aggregate jobs reduce the table to sufficient statistics
(counts, means, co-moments, per-group moments); the few numbers left are
combined in Spark expressions or, for k x k matrices, solved on the driver
with numpy. Nothing row-sized reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.checks import as_list, require_columns
from tessera.operators.groupjoin import join_by, join_rows_by, safe_corr
from tessera.operators.ranking import exact_quantiles, sorted_cumulative
from tessera.operators.verbs import seeded_hash


# ---------------------------------------------------------------- group tests
def group_moments(df: DataFrame, by: str, x: str) -> DataFrame:
    return df.where(F.col(x).isNotNull()).groupBy(by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))


def t_test_welch(df: DataFrame, by: str, x: str, reference=None) -> DataFrame:
    """Welch two-sample t: one row per pair of levels with mean difference
    (level - reference), t and Welch df. With ``reference``, its pairs with every
    other level; without, every pair, the smaller level as reference."""
    m = group_moments(df, by, x).where(F.col(by).isNotNull())
    ref = m.select(F.col(by).alias("__ref"), F.col("n").alias("n0"), F.col("mean").alias("m0"), F.col("var").alias("v0"))
    if reference is None:
        o = m.join(ref, F.col("__ref") < F.col(by))  # pairs of levels: the result itself
    else:
        ref = ref.where(F.col("__ref") == F.lit(reference))
        o = m.where(F.col(by) != F.lit(reference)).crossJoin(F.broadcast(ref))  # ref: one row
    se2 = F.col("var") / F.col("n") + F.col("v0") / F.col("n0")
    dfw = F.try_divide(se2 * se2, F.try_divide((F.col("var") / F.col("n")) ** 2, F.col("n") - 1)
                       + F.try_divide((F.col("v0") / F.col("n0")) ** 2, F.col("n0") - 1))
    return o.select(F.col(by).alias("level"), F.col("__ref").cast("string").alias("reference"),
                    (F.col("mean") - F.col("m0")).alias("mean_diff"),
                    F.try_divide(F.col("mean") - F.col("m0"), F.sqrt(se2)).alias("t"), dfw.alias("df"))


def anova_oneway(df: DataFrame, by: str, x: str) -> DataFrame:
    """One row: between and within sums of squares, their df, F and eta squared."""
    m = group_moments(df, by, x)
    tot = m.agg(F.sum("n").alias("__total"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("gm"),
                F.count(F.lit(1)).alias("k"))
    j = m.crossJoin(F.broadcast(tot))  # one row
    s = j.groupBy("__total", "k").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("gm")) ** 2).alias("ssb"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0))).alias("ssw"))
    dfb, dfw = F.col("k") - 1, F.col("__total") - F.col("k")
    return s.select("ssb", "ssw", dfb.cast("bigint").alias("df_between"), dfw.cast("bigint").alias("df_within"),
                    F.try_divide(F.try_divide(F.col("ssb"), dfb), F.try_divide(F.col("ssw"), dfw)).alias("f"),
                    F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_sq"))


def levene_test(df: DataFrame, by: str, x: str) -> DataFrame:
    """Brown-Forsythe (median-centred Levene): one-way ANOVA on |x - group median|."""
    med = exact_quantiles(df, x, [0.5], by=[by], names=["__med"])
    z = join_rows_by(df, med, [by]).select(by, F.abs(F.col(x) - F.col("__med")).alias("__z"))
    return anova_oneway(z, by, "__z").select("f", "df_between", "df_within")


def chisq_test(df: DataFrame, r: str, c: str) -> DataFrame:
    """Pearson chi-square test of independence over observed cells, using
    sum (O-E)^2/E = sum O^2/E - N, so the empty cells of the full grid are not
    materialised; df = (R-1)(C-1); Cramer's V."""
    g = df.groupBy(r, c).agg(F.count(F.lit(1)).alias("o"))
    rows = g.groupBy(r).agg(F.sum("o").alias("__r"))
    cols = g.groupBy(c).agg(F.sum("o").alias("__c"))
    j = join_by(join_by(g, rows, r), cols, c)
    o = F.col("o").cast("double")
    s = j.agg(F.sum(o * o / (F.col("__r").cast("double") * F.col("__c"))).alias("__q"),
              F.sum("o").alias("N"))
    # NULL is a level on both sides, like any other
    dims = rows.agg(F.count(F.lit(1)).alias("R")).crossJoin(cols.agg(F.count(F.lit(1)).alias("C")))
    out = s.crossJoin(dims)
    chi = F.col("N") * F.col("__q") - F.col("N")
    return out.select(chi.alias("statistic"), ((F.col("R") - 1) * (F.col("C") - 1)).cast("bigint").alias("df"),
                      F.sqrt(F.try_divide(chi, F.col("N") * (F.least("R", "C") - 1))).alias("cramers_v"))


def ranksum_test(df: DataFrame, by: str, x: str, a, b) -> DataFrame:
    """Wilcoxon rank-sum for levels ``a`` vs ``b`` with mid-ranks and tie-corrected
    normal approximation (no continuity correction). Ranks by the distributed
    recipe over distinct values: W = sum over values of n_a(v) * midrank(v)."""
    two = df.where(F.col(by).isin(a, b) & F.col(x).isNotNull())
    hist = two.groupBy(x).agg(F.count(F.lit(1)).alias("_n"),
                              F.count_if(F.col(by) == F.lit(a)).alias("_na"))
    cum = sorted_cumulative(hist, x, ["_n"])
    mid = F.col("_n_before") + (F.col("_n") + 1) / 2.0
    s = cum.agg(F.sum(F.col("_na") * mid).alias("w"), F.sum("_na").alias("na"), F.sum("_n").alias("N"),
                F.sum(F.col("_n") ** 3 - F.col("_n")).alias("ties"))
    nb, na, n = F.col("N") - F.col("na"), F.col("na").cast("double"), F.col("N").cast("double")
    e = na * (n + 1) / 2.0
    var = na * nb / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    return s.select("w", F.col("na").alias("n_a"), nb.alias("n_b"), F.try_divide(F.col("w") - e, F.sqrt(var)).alias("z"))


# ---------------------------------------------------------------- metrics
def confusion_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Binary 0/1 truth and prediction: cells, accuracy, Cohen's kappa,
    precision, recall and F1 (NULL where a denominator is 0)."""
    s = df.agg(F.count_if((F.col(truth) == 1) & (F.col(pred) == 1)).alias("tp"),
               F.count_if((F.col(truth) == 0) & (F.col(pred) == 1)).alias("fp"),
               F.count_if((F.col(truth) == 1) & (F.col(pred) == 0)).alias("fn"),
               F.count_if((F.col(truth) == 0) & (F.col(pred) == 0)).alias("tn"))
    # doubles: products of counts pass 64 bits from about 3e9 rows
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    acc = F.try_divide(tp + tn, n)
    pe = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    prec, rec = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return s.select("tp", "fp", "fn", "tn", acc.alias("accuracy"),
                    F.try_divide(acc - pe, 1 - pe).alias("kappa"), prec.alias("precision"), rec.alias("recall"),
                    F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Exact ROC with ties grouped: one row per distinct score (threshold
    ``score >= s``) with tp, fp, tpr, fpr, and the area (same on every row),
    AUC = sum over scores of pos(s) * (neg below s + neg at s / 2) / (P * N).
    Running sums use the distributed recipe, not a global window."""
    hist = df.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(F.col(truth) == 1).alias("_pos"), F.count_if(F.col(truth) != 1).alias("_neg"))
    cum = sorted_cumulative(hist, score, ["_pos", "_neg"])
    tp = F.col("_pos_total") - F.col("_pos_before")
    fp = F.col("_neg_total") - F.col("_neg_before")
    pts = cum.select(score, tp.alias("tp"), fp.alias("fp"),
                     F.try_divide(tp, F.col("_pos_total")).alias("tpr"), F.try_divide(fp, F.col("_neg_total")).alias("fpr"),
                     (F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2.0)).alias("__a"),
                     F.col("_pos_total"), F.col("_neg_total"))
    area = pts.agg(F.try_divide(F.sum("__a"), F.first("_pos_total").cast("double") * F.first("_neg_total")).alias("auc"))
    return pts.drop("__a", "_pos_total", "_neg_total").crossJoin(F.broadcast(area))


def regression_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    e = F.col(truth) - F.col(pred)
    s = df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
               F.sum(e * e).alias("__sse"), F.var_pop(truth).alias("__vy"), F.count(truth).alias("__n"))
    return s.select("rmse", "mae", (1 - F.try_divide(F.col("__sse"), F.col("__vy") * F.col("__n"))).alias("r2"))


# ---------------------------------------------------------------- linear models
def _moments(df: DataFrame, y: str, xs: list[str]):
    """Means, population co-moments of (x..., y) and n in one aggregate (Spark's
    covariance aggregates are the numerically stable online form)."""
    cols = xs + [y]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m_{c}") for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(F.covar_pop(a, b).alias(f"c_{a}__{b}"))
    r = df.select(*cols).dropna().agg(*aggs).first()
    k = len(cols)
    cov = np.zeros((k, k))
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[i:], start=i):
            cov[i, j] = cov[j, i] = r[f"c_{a}__{b}"]
    means = np.array([r[f"m_{c}"] for c in cols])
    return int(r["n"]), means, cov


def _ols(df: DataFrame, y: str, xs: list[str]):
    n, means, cov = _moments(df, y, xs)
    k = len(xs)
    sxx, sxy = cov[:k, :k], cov[:k, k]
    b = np.linalg.solve(sxx, sxy)
    b0 = means[k] - b @ means[:k]
    rss = n * (cov[k, k] - b @ sxy)
    tss = n * cov[k, k]
    return n, means, cov, b, b0, rss, tss


def _terms(df: DataFrame, y: str, xs, keep=()):
    """Numeric columns as given, or those of a formula ``y ~ a + b`` passed as ``y``."""
    if xs is None or "~" in y:
        from tessera.operators.models import design
        return design(df, y, keep)
    return df, y, as_list(xs)


def lm_fit(df: DataFrame, y: str, xs=None) -> DataFrame:
    """Least squares with intercept, of ``y`` on numeric columns ``xs`` or of a formula
    ``"y ~ a + b"`` (categorical terms allowed): rows (term, estimate, std_error, t_value)
    plus r_squared and n on every row. One aggregate job; the (k+1)x(k+1)
    co-moment matrix is solved on the driver."""
    df, y, xs = _terms(df, y, xs)
    require_columns(df, y, *xs)
    n, means, cov, b, b0, rss, tss = _ols(df, y, xs)
    k = len(xs)
    sigma2 = rss / (n - k - 1)
    inv = np.linalg.inv(n * cov[:k, :k])
    se = np.sqrt(np.diag(inv) * sigma2)
    se0 = math.sqrt(sigma2 * (1.0 / n + means[:k] @ inv @ means[:k]))
    r2 = 1 - rss / tss
    rows = [("(Intercept)", float(b0), float(se0))] + [(x, float(bi), float(si)) for x, bi, si in zip(xs, b, se)]
    spark = df.sparkSession
    return spark.createDataFrame(
        [(t, e, s, e / s, float(r2), n) for t, e, s in rows],
        "term string, estimate double, std_error double, t_value double, r_squared double, n long")


def robust_se(df: DataFrame, y: str, xs=None, kind: str = "HC1", cluster: str | None = None) -> DataFrame:
    """Heteroskedasticity- (HC0, HC1) or cluster-robust standard errors.

    Pass 1 fits by co-moments; pass 2 aggregates the meat X' diag(e^2) X (or,
    with ``cluster``, per-cluster score sums then their outer products) as k^2
    sums; the sandwich is formed on the driver."""
    df, y, xs = _terms(df, y, xs, [cluster] if cluster else [])
    n, means, cov, b, b0, rss, tss = _ols(df, y, xs)
    k = len(xs) + 1
    design = [F.lit(1.0)] + [F.col(f"`{x}`").cast("double") for x in xs]
    names = ["(Intercept)"] + xs
    resid = F.col(y) - F.lit(float(b0)) - sum((F.lit(float(bi)) * F.col(x) for x, bi in zip(xs, b)), F.lit(0.0))
    d = df.select(*(xs + [y] + ([cluster] if cluster else []))).dropna()
    if cluster is None:
        aggs = [F.sum(design[i] * design[j] * resid * resid).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        r = d.agg(*aggs).first()
    else:
        scores = d.groupBy(cluster).agg(*[F.sum(design[i] * resid).alias(f"s{i}") for i in range(k)])
        aggs = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
        aggs.append(F.count(F.lit(1)).alias("G"))
        r = scores.agg(*aggs).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = r[f"m{i}_{j}"]
    xtx = np.zeros((k, k))
    mu = np.concatenate([[1.0], means[:-1]])
    xtx[:, :] = n * np.outer(mu, mu)
    xtx[1:, 1:] += n * cov[:-1, :-1]
    bread = np.linalg.inv(xtx)
    v = bread @ meat @ bread
    if cluster is None:
        if kind == "HC1":
            v *= n / (n - k)
        elif kind != "HC0":
            raise ValueError(f"kind={kind!r}")
    else:
        g = r["G"]
        v *= (g / (g - 1)) * ((n - 1) / (n - k))
    est = [float(b0)] + [float(x) for x in b]
    se = np.sqrt(np.diag(v))
    label = "cluster" if cluster else kind
    return df.sparkSession.createDataFrame(
        [(t, e, float(s), label) for t, e, s in zip(names, est, se)],
        "term string, estimate double, std_error double, kind string")


def vif(df: DataFrame, cols) -> DataFrame:
    """Variance inflation factors: diagonal of the inverse correlation matrix
    (k x k, from one aggregate of pairwise correlations)."""
    cols = as_list(cols)
    k = len(cols)
    aggs = [safe_corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    r = df.select(*cols).dropna().agg(*aggs).first()
    m = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            m[i, j] = m[j, i] = np.nan if r[f"{i}_{j}"] is None else r[f"{i}_{j}"]
    # a constant column has no correlation and no factor; it is left out of the others' factors
    known = [i for i in range(k) if k == 1 or not np.isnan(np.delete(m[i], i)).all()]
    value = dict.fromkeys(range(k))
    if known:
        try:
            inv = np.linalg.inv(m[np.ix_(known, known)])
            value |= {i: float(inv[n, n]) for n, i in enumerate(known)}
        except np.linalg.LinAlgError:  # an exact linear relation: no finite factor
            value |= dict.fromkeys(known, float("inf"))
    return df.sparkSession.createDataFrame([(c, value[i]) for i, c in enumerate(cols)],
                                           "column string, vif double")


# ---------------------------------------------------------------- classifiers
def naive_bayes_moments(df: DataFrame, label: str, xs) -> DataFrame:
    """Gaussian class model: per class n, prior, and mean and (population)
    variance of each feature."""
    xs = as_list(xs)
    aggs = [F.count(F.lit(1)).alias("n")]
    for x in xs:
        aggs += [F.avg(x).alias(f"mean_{x}"), F.var_pop(x).alias(f"var_{x}")]
    g = df.groupBy(label).agg(*aggs)
    tot = g.agg(F.sum("n").alias("__N"))
    return g.crossJoin(F.broadcast(tot)).withColumn("prior", F.col("n") / F.col("__N")).drop("__N")


def naive_bayes_scores(df: DataFrame, label: str, xs, key: str, max_classes: int = 1000) -> DataFrame:
    """Per row: the predicted class (the first of equals) and its log posterior (up
    to a constant). The class table is broadcast after its size is checked."""
    xs = as_list(xs)
    mom = naive_bayes_moments(df, label, xs)
    if mom.count() > max_classes:
        raise ValueError("too many classes for a broadcast class table")
    # the class table is one row, an array of its classes in order: rows are scored where they are
    fields = ["prior", *[f"{m}_{x}" for x in xs for m in ("mean", "var")]]
    table = mom.where(F.col(label).isNotNull()).agg(F.array_sort(F.collect_list(
        F.struct(F.col(label).alias("class"), *fields))).alias("__classes"))

    def log_post(c):
        ll = F.log(c["prior"])
        for x in xs:
            # a constant feature says nothing about its class
            v = F.nullif(c[f"var_{x}"], F.lit(0.0))
            ll = ll - F.coalesce(0.5 * F.log(2 * math.pi * v) + (F.col(x) - c[f"mean_{x}"]) ** 2 / (2 * v), F.lit(0.0))
        return ll

    scored = df.select(key, *xs).crossJoin(F.broadcast(table))
    best = F.array_max(F.transform("__classes", lambda c, i: F.struct(log_post(c).alias("ll"), (-i).alias("at"))))
    return scored.withColumn("__best", best).select(
        key, F.get("__classes", -F.col("__best.at"))["class"].alias("predicted"), F.col("__best.ll").alias("log_post"))


def naive_bayes_levels(df: DataFrame, label: str, x: str, alpha: float = 1.0) -> DataFrame:
    """Categorical class model of one column: per level and class the count and the log probability of the
    level in the class, smoothed by ``alpha``; NULL is a level, rows without a label are left out."""
    known = df.where(F.col(label).isNotNull())
    classes = known.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    levels = known.select(x).distinct()
    k = levels.agg(F.count(F.lit(1)).alias("__k"))
    cells = known.groupBy(x, label).agg(F.count(F.lit(1)).alias("n"))
    # levels x classes is the model itself
    grid = levels.crossJoin(F.broadcast(classes)).crossJoin(F.broadcast(k))
    j = join_by(grid, cells, [x, label])
    n = F.coalesce(F.col("n"), F.lit(0))
    return j.select(x, label, n.alias("n"), F.log((n + alpha) / (F.col("__n") + alpha * F.col("__k"))).alias("log_prob"))


def naive_bayes_category_scores(df: DataFrame, label: str, xs, key: str, alpha: float = 1.0) -> DataFrame:
    """Per row: the predicted class (the first of equals) of categorical columns and its log posterior (up to a constant).

    Every column's levels carry the log probabilities of all classes as one array, so a row is
    joined once per column and its classes are compared in place."""
    known = df.where(F.col(label).isNotNull())
    one = known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("class"), "n"))).alias("__classes"), F.sum("n").alias("__N"))
    rows = df.select(key, *xs)
    total = F.transform("__classes", lambda c: F.log(c["n"] / F.col("__N")))
    for i, x in enumerate(as_list(xs)):
        t = naive_bayes_levels(df, label, x, alpha).groupBy(x).agg(
            F.transform(F.array_sort(F.collect_list(F.struct(label, "log_prob"))), lambda s: s["log_prob"]).alias(f"__p{i}"))
        rows = join_rows_by(rows, t, [x])
        # a level without labelled rows says nothing
        total = F.when(F.col(f"__p{i}").isNull(), total).otherwise(F.zip_with(total, F.col(f"__p{i}"), lambda a, b: a + b))
    best = F.array_max(F.transform(total, lambda ll, i: F.struct(ll.alias("ll"), (-i).alias("at"))))
    return rows.crossJoin(F.broadcast(one)).withColumn("__best", best).select(
        key, F.get("__classes", -F.col("__best.at"))["class"].alias("predicted"), F.col("__best.ll").alias("log_post"))


# ---------------------------------------------------------------- preprocessing
def near_zero_var(df: DataFrame, cols) -> DataFrame:
    """Per column: frequency ratio (most common / second most common value count),
    percent of distinct values, distinct count. Top-2 per column is a
    row_number <= 2 filter (partial WindowGroupLimit before the shuffle)."""
    cols = as_list(cols)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                          for c in cols])).alias("kv")).select("kv.*")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    top2 = counts.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("column").agg(
        F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n1"), F.max(F.when(F.col("r") == 2, F.col("n"))).alias("n2"))
    tot = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.count("value").alias("n_distinct"))
    return top2.join(tot, "column").select(
        "column", F.try_divide(F.col("n1"), F.col("n2")).alias("freq_ratio"),
        (F.col("n_distinct") * 100.0 / F.col("rows")).alias("percent_unique"), "n_distinct")


PREPROCESS_STEPS = ("impute", "center", "scale", "range")


def preprocess(df: DataFrame, cols, steps=("impute", "center", "scale")) -> DataFrame:
    """``impute``: NULL -> exact median; ``center``: minus mean; ``scale``: divided
    by sample sd; ``range``: (x - min) / (max - min), which goes with neither of the two. Statistics come from one
    aggregate, and one quantile job for the medians of all columns, broadcast as one row."""
    cols, steps = as_list(cols), as_list(steps)
    if unknown := set(steps) - set(PREPROCESS_STEPS):
        raise ValueError(f"unknown steps {sorted(unknown)}")
    if "range" in steps and {"center", "scale"} & set(steps):
        raise ValueError("range replaces center and scale; choose one")
    out = df
    if "impute" in steps:
        long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("__i"), F.col(f"`{c}`").cast("double").alias("__v")) for i, c in enumerate(cols)])))
        med = exact_quantiles(long, "__v", [0.5], by=["__i"], names=["__med"])
        one = med.agg(*[F.max(F.when(F.col("__i") == i, F.col("__med"))).alias(f"__med_{i}") for i in range(len(cols))])
        out = df.crossJoin(F.broadcast(one)).select(
            *[F.coalesce(F.col(f"`{c}`"), F.col(f"__med_{cols.index(c)}")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])
    st = out.agg(*[e for i, c in enumerate(cols) for e in (F.avg(f"`{c}`").alias(f"__m_{i}"), F.stddev_samp(f"`{c}`").alias(f"__s_{i}"),
                                                          F.min(f"`{c}`").alias(f"__lo_{i}"), F.max(f"`{c}`").alias(f"__hi_{i}"))])

    def scaled(c: str) -> Column:
        x, i = F.col(f"`{c}`"), cols.index(c)
        if "range" in steps:
            return F.try_divide(x - F.col(f"__lo_{i}"), F.col(f"__hi_{i}") - F.col(f"__lo_{i}"))
        if "center" in steps:
            x = x - F.col(f"__m_{i}")
        return F.try_divide(x, F.col(f"__s_{i}")) if "scale" in steps else x

    return out.crossJoin(F.broadcast(st)).select(*[scaled(c).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def drop_correlated(df: DataFrame, cols, cutoff: float = 0.9) -> DataFrame:
    """Columns to drop so that no remaining pair has |r| > cutoff: repeatedly take
    the pair with the largest |r| and drop the member with the larger mean
    absolute correlation. The k x k matrix is one aggregate; the greedy pick
    runs on it on the driver."""
    cols = as_list(cols)
    k = len(cols)
    aggs = [safe_corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    r = df.select(*cols).dropna().agg(*aggs).first()
    m = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            m[i, j] = m[j, i] = abs(r[f"{i}_{j}"] or 0.0)
    alive = list(range(k))
    dropped = []
    while len(alive) > 1:
        sub = m[np.ix_(alive, alive)] - np.eye(len(alive))
        i, j = np.unravel_index(np.argmax(sub), sub.shape)
        if sub[i, j] <= cutoff:
            break
        mean_abs = sub.sum(axis=1) / (len(alive) - 1)
        victim = alive[i] if mean_abs[i] >= mean_abs[j] else alive[j]
        dropped.append((cols[victim], float(sub[i, j])))
        alive.remove(victim)
    return df.sparkSession.createDataFrame(dropped, "column string, max_abs_corr double")


def split_stratified(df: DataFrame, key: str, strata: str | None = None, p: float = 0.8, k: int = 5,
                     seed: int = 42) -> DataFrame:
    """Repeatable split: rows ordered within their stratum by a seeded hash of
    the key; position < floor(p * stratum size) -> train; fold = position mod k.
    Positions come from the distributed rank recipe, so a large stratum is not
    sorted in one task."""
    s = [strata] if strata else []
    h = df.withColumn("__h", seeded_hash(key, seed))
    hist = h.groupBy(*s, "__h").agg(F.count(F.lit(1)).alias("_n"))
    cum = sorted_cumulative(hist, "__h", ["_n"], s)
    pos = join_by(h, cum.drop("_n"), [*s, "__h"], "inner")
    # rows sharing a hash (a hash collision) get consecutive positions by key
    w = Window.partitionBy(*s, "__h").orderBy(key)
    pos = pos.withColumn("position", F.col("_n_before") + F.row_number().over(w) - 1)
    return pos.select(*df.columns, "position",
                      (F.col("position") < F.floor(F.lit(p) * F.col("_n_total"))).alias("is_train"),
                      F.pmod(F.col("position"), F.lit(k)).cast("int").alias("fold")).drop("position")
