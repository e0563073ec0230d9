"""Statistics, survival and structural-change queries (inventory section 2.13)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import change as C
from tessera.operators import stats as ST
from tessera.operators import survival as SV
from tessera.plans.profiling import SCORED_SQL, scored_in
from tessera.plans.registry import register
from tessera.plans.verbs import EVENTS_GAPPY_SQL, events_gappy

# ------------------------------------------------------------------ derived inputs


def survival_in(t):
    """Per customer: days from first to second order, capped at 180; event = a
    second order within 180 days; grp = custkey mod 2."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    two = t.orders.select("o_custkey", "o_orderdate", "o_orderkey") \
        .withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    g = two.groupBy("o_custkey").agg(F.min(F.when(F.col("rn") == 1, F.col("o_orderdate"))).alias("d1"),
                                     F.min(F.when(F.col("rn") == 2, F.col("o_orderdate"))).alias("d2"))
    gap = F.datediff(F.to_date("d2"), F.to_date("d1"))
    seen = F.col("d2").isNotNull() & (gap <= 180)
    return g.select(F.col("o_custkey").alias("custkey"),
                    F.when(seen, gap).otherwise(180).cast("bigint").alias("duration_d"),
                    F.when(seen, 1).otherwise(0).cast("int").alias("event"),
                    F.pmod(F.col("o_custkey"), F.lit(2)).cast("int").alias("grp"))


SURVIVAL_SQL = """(WITH r AS (SELECT o_custkey, o_orderdate,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
  g AS (SELECT o_custkey, min(o_orderdate) FILTER (WHERE rn = 1) AS d1, min(o_orderdate) FILTER (WHERE rn = 2) AS d2
        FROM r WHERE rn <= 2 GROUP BY 1)
  SELECT o_custkey AS custkey,
    CAST(CASE WHEN d2 IS NOT NULL AND date_diff('day', d1, d2) <= 180 THEN date_diff('day', d1, d2) ELSE 180 END AS BIGINT) AS duration_d,
    CAST(CASE WHEN d2 IS NOT NULL AND date_diff('day', d1, d2) <= 180 THEN 1 ELSE 0 END AS INTEGER) AS event,
    CAST(o_custkey % 2 AS INTEGER) AS grp FROM g)"""


def monthly_in(t):
    """Monthly order revenue: t = year * 12 + month - 1, y = round(sum, 2)."""
    m = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("bigint")
    return t.orders.groupBy(m.alias("t")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


MONTHLY_SQL = ("(SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS t, "
               "round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1)")

# ------------------------------------------------------------------ survival


@register("km_curve", sql=f"""
WITH s AS {SURVIVAL_SQL},
g AS (SELECT grp, duration_d AS time, CAST(sum(event) AS BIGINT) AS n_event, count(*) AS nrows FROM s GROUP BY 1, 2),
r AS (SELECT *, sum(nrows) OVER (PARTITION BY grp ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_risk
      FROM g),
k AS (SELECT *,
  max(CASE WHEN n_event = n_risk THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dead,
  sum(CASE WHEN n_event < n_risk THEN ln(1 - n_event / n_risk) ELSE 0 END)
    OVER (PARTITION BY grp ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lsum
  FROM r)
SELECT grp, time, CAST(n_risk AS BIGINT) AS n_risk, n_event, CAST(nrows - n_event AS BIGINT) AS n_censor,
       round(CASE WHEN dead = 1 THEN 0.0 ELSE exp(lsum) END, 6) AS survival
FROM k""")
def q_km_curve(t):
    k = SV.km_curve(survival_in(t), "duration_d", "event", by="grp")
    return k.withColumn("survival", F.round("survival", 6))


@register("logrank_test", sql=f"""
WITH s AS {SURVIVAL_SQL},
g AS (SELECT duration_d, count(*) AS nrows, count(*) FILTER (WHERE grp = 0) AS nrows_a, sum(event) AS d,
             sum(CASE WHEN grp = 0 THEN event ELSE 0 END) AS da FROM s GROUP BY 1),
r AS (SELECT *, sum(nrows) OVER (ORDER BY duration_d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n,
                sum(nrows_a) OVER (ORDER BY duration_d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS na FROM g),
a AS (SELECT CAST(sum(da) AS BIGINT) AS observed_a, sum(d * na / n) AS expected_a, CAST(sum(d) AS BIGINT) AS dt,
             sum(CASE WHEN n > 1 THEN d * (na / n) * (1 - na / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM r)
SELECT observed_a, round(expected_a, 6) AS expected_a, dt - observed_a AS observed_b, round(dt - expected_a, 6) AS expected_b,
       round(variance, 6) AS variance, round((observed_a - expected_a) ^ 2 / variance, 6) AS chisq
FROM a""")
def q_logrank_test(t):
    r = SV.logrank_test(survival_in(t), "duration_d", "event", "grp", 0, 1)
    return r.withColumns({c: F.round(c, 6) for c in ("expected_a", "expected_b", "variance", "chisq")})


@register("aft_fit")
def q_aft_fit(t):
    """Weibull AFT on the survival input (durations shifted by one day)."""
    return SV.aft_fit(survival_in(t), "duration_d", "event", ["grp"], shift=1.0)


@register("cox_fit")
def q_cox_fit(t):
    """Cox model with one binary covariate (grp), Breslow ties."""
    return SV.cox_fit(survival_in(t), "duration_d", "event", ["grp"])


# ------------------------------------------------------------------ structural change
@register("ols_cusum", sql=f"""
WITH m AS {MONTHLY_SQL},
r AS (SELECT t, y, y - avg(y) OVER () AS resid FROM m),
s AS (SELECT *, sum(resid) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                / (sqrt(sum(resid * resid) OVER () / (count(*) OVER () - 1)) * sqrt(count(*) OVER ())) AS cusum FROM r)
SELECT t, y, round(resid, 6) AS resid, round(cusum, 6) AS cusum, round(max(abs(cusum)) OVER (), 6) AS max_abs FROM s""")
def q_ols_cusum(t):
    c = C.ols_cusum(monthly_in(t), "t", "y")
    return c.withColumns({"resid": F.round("resid", 6), "cusum": F.round("cusum", 6), "max_abs": F.round("max_abs", 6)})


BREAK_T = 1999 * 12  # January 1999


@register("chow_test", sql=f"""
WITH m AS {MONTHLY_SQL},
s AS (SELECT regr_syy(y, t) - regr_sxy(y, t) ^ 2 / regr_sxx(y, t) AS rp, count(*) AS n,
             regr_syy(y, t) FILTER (WHERE t < {BREAK_T}) - regr_sxy(y, t) FILTER (WHERE t < {BREAK_T}) ^ 2
               / regr_sxx(y, t) FILTER (WHERE t < {BREAK_T}) AS r1,
             regr_syy(y, t) FILTER (WHERE t >= {BREAK_T}) - regr_sxy(y, t) FILTER (WHERE t >= {BREAK_T}) ^ 2
               / regr_sxx(y, t) FILTER (WHERE t >= {BREAK_T}) AS r2,
             count(*) FILTER (WHERE t < {BREAK_T}) AS n1, count(*) FILTER (WHERE t >= {BREAK_T}) AS n2 FROM m)
SELECT round(((rp - r1 - r2) / 2) / ((r1 + r2) / (n - 4)), 6) AS f, CAST(2 AS BIGINT) AS df1,
       CAST(n - 4 AS BIGINT) AS df2, n1, n2 FROM s""")
def q_chow_test(t):
    return C.chow_test(monthly_in(t), "t", "y", BREAK_T).withColumn("f", F.round("f", 6))


@register("breakpoints")
def q_breakpoints(t):
    """Least-squares mean-shift break dates (0-3 breaks) in monthly revenue."""
    return C.breakpoints(monthly_in(t), "t", "y", max_breaks=3)


@register("breakpoints_daily")
def q_breakpoints_daily(t):
    """Break dates in the daily revenue (some 2,400 points)."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return C.breakpoints(t.orders.groupBy(day.alias("t")).agg(F.round(F.sum("o_totalprice"), 2).alias("y")), "t", "y", max_breaks=3)


# ------------------------------------------------------------------ group tests
@register("t_test_welch", sql="""
WITH m AS (SELECT o_orderpriority AS level, count(*) AS n, avg(o_totalprice) AS mean, var_samp(o_totalprice) AS var
           FROM orders GROUP BY 1),
r AS (SELECT level AS reference, n AS n0, mean AS m0, var AS v0 FROM m)
SELECT level, reference, round(mean - m0, 6) AS mean_diff,
       round((mean - m0) / sqrt(var / n + v0 / n0), 6) AS t,
       round((var / n + v0 / n0) ^ 2 / ((var / n) ^ 2 / (n - 1) + (v0 / n0) ^ 2 / (n0 - 1)), 6) AS df
FROM m JOIN r ON reference < level""")
def q_t_test_welch(t):
    """Every pair of order priorities."""
    r = ST.t_test_welch(t.orders, "o_orderpriority", "o_totalprice")
    return r.withColumns({c: F.round(c, 6) for c in ("mean_diff", "t", "df")})


_ANOVA_SQL = """
WITH m AS (SELECT {by} AS g, count(*) AS n, avg({x}) AS mean, var_samp({x}) AS var FROM {src} GROUP BY 1),
tot AS (SELECT sum(n) AS nn, sum(n * mean) / sum(n) AS gm, count(*) AS k FROM m),
s AS (SELECT sum(n * (mean - gm) ^ 2) AS ssb, sum(coalesce((n - 1) * var, 0)) AS ssw, any_value(nn) AS nn,
             any_value(k) AS k FROM m, tot)
SELECT {cols} FROM s"""
_ANOVA_COLS = ("round(ssb, 0) AS ssb, round(ssw, 0) AS ssw, CAST(k - 1 AS BIGINT) AS df_between, "
               "CAST(nn - k AS BIGINT) AS df_within, round((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS f, "
               "round(ssb / (ssb + ssw), 6) AS eta_sq")


@register("anova_oneway", sql=_ANOVA_SQL.format(by="o_orderpriority", x="o_totalprice", src="orders", cols=_ANOVA_COLS))
def q_anova_oneway(t):
    a = ST.anova_oneway(t.orders, "o_orderpriority", "o_totalprice")
    return a.withColumns({"ssb": F.round("ssb", 0), "ssw": F.round("ssw", 0), "f": F.round("f", 6),
                          "eta_sq": F.round("eta_sq", 6)})


@register("levene_test", sql=_ANOVA_SQL.format(
    by="o_orderpriority", x="z",
    src="(SELECT o_orderpriority, abs(o_totalprice - med) AS z FROM orders JOIN "
        "(SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS med FROM orders GROUP BY 1) USING (o_orderpriority))",
    cols="round((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS f, CAST(k - 1 AS BIGINT) AS df_between, "
         "CAST(nn - k AS BIGINT) AS df_within"))
def q_levene_test(t):
    return ST.levene_test(t.orders, "o_orderpriority", "o_totalprice").withColumn("f", F.round("f", 6))


@register("chisq_test", sql="""
WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS o FROM orders GROUP BY 1, 2),
rt AS (SELECT o_orderstatus, sum(o) AS r FROM g GROUP BY 1),
ct AS (SELECT o_orderpriority, sum(o) AS c FROM g GROUP BY 1),
nt AS (SELECT sum(o) AS n, (SELECT count(*) FROM rt) AS rr, (SELECT count(*) FROM ct) AS cc FROM g),
x AS (SELECT r, c, n, rr, cc, coalesce(g.o, 0) AS o
      FROM rt CROSS JOIN ct CROSS JOIN nt LEFT JOIN g USING (o_orderstatus, o_orderpriority)),
s AS (SELECT sum((o - r * c / n) ^ 2 / (r * c / n)) AS chi, any_value(n) AS n, any_value(rr) AS rr,
             any_value(cc) AS cc FROM x)
SELECT round(chi, 6) AS statistic, CAST((rr - 1) * (cc - 1) AS BIGINT) AS df,
       round(sqrt(chi / (n * (least(rr, cc) - 1))), 6) AS cramers_v
FROM s""")
def q_chisq_test(t):
    c = ST.chisq_test(t.orders, "o_orderstatus", "o_orderpriority")
    return c.withColumns({"statistic": F.round("statistic", 6), "cramers_v": F.round("cramers_v", 6)})


@register("ranksum_test", sql="""
WITH two AS (SELECT o_orderpriority AS g, o_totalprice AS x FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')),
r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk, x FROM two),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM two GROUP BY x)),
s AS (SELECT sum(rk) FILTER (WHERE g = '1-URGENT') AS w, count(*) FILTER (WHERE g = '1-URGENT') AS na,
             count(*) AS n FROM r)
SELECT round(w, 6) AS w, na AS n_a, n - na AS n_b,
       round((w - na * (n + 1) / 2.0) / sqrt(na * (n - na) / 12.0 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z
FROM s, t""")
def q_ranksum_test(t):
    r = ST.ranksum_test(t.orders, "o_orderpriority", "o_totalprice", "1-URGENT", "5-LOW")
    return r.withColumns({"w": F.round("w", 6), "z": F.round("z", 6)})


# ------------------------------------------------------------------ metrics
@register("confusion_metrics", sql=f"""
WITH s AS {SCORED_SQL},
c AS (SELECT count(*) FILTER (WHERE truth = 1 AND score > 5000) AS tp, count(*) FILTER (WHERE truth = 0 AND score > 5000) AS fp,
             count(*) FILTER (WHERE truth = 1 AND score <= 5000) AS fn, count(*) FILTER (WHERE truth = 0 AND score <= 5000) AS tn
      FROM s),
m AS (SELECT *, tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS acc,
             ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) ^ 2) AS pe FROM c)
SELECT tp, fp, fn, tn, round(acc, 6) AS accuracy, round((acc - pe) / nullif(1 - pe, 0), 6) AS kappa,
       round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
       round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1
FROM m""")
def q_confusion_metrics(t):
    s = scored_in(t).withColumn("pred", (F.col("score") > 5000).cast("int"))
    c = ST.confusion_metrics(s, "truth", "pred")
    return c.withColumns({k: F.round(k, 6) for k in ("accuracy", "kappa", "precision", "recall", "f1")})


@register("roc_auc", sql=f"""
WITH s AS {SCORED_SQL},
h AS (SELECT score, count(*) FILTER (WHERE truth = 1) AS pos, count(*) FILTER (WHERE truth <> 1) AS neg FROM s GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
                sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below,
                sum(pos) OVER () AS p, sum(neg) OVER () AS nn FROM h),
a AS (SELECT sum(pos * (coalesce(neg_below, 0) + neg / 2.0)) / (any_value(p) * any_value(nn)) AS auc FROM c)
SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / p, 6) AS tpr, round(fp / nn, 6) AS fpr,
       round(auc, 6) AS auc
FROM c, a""")
def q_roc_auc(t):
    r = ST.roc_auc(scored_in(t), "score", "truth")
    return r.withColumns({k: F.round(k, 6) for k in ("tpr", "fpr", "auc")})


@register("regression_metrics", sql="""
WITH u AS (SELECT avg(l_extendedprice / l_quantity) AS unit FROM lineitem),
p AS (SELECT l_extendedprice AS y, l_quantity * unit AS yhat FROM lineitem, u)
SELECT round(sqrt(avg((y - yhat) ^ 2)), 6) AS rmse, round(avg(abs(y - yhat)), 6) AS mae,
       round(1 - sum((y - yhat) ^ 2) / (var_pop(y) * count(y)), 6) AS r2
FROM p""")
def q_regression_metrics(t):
    li = t.lineitem
    unit = li.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    p = li.crossJoin(F.broadcast(unit)).select(F.col("l_extendedprice").alias("y"),
                                               (F.col("l_quantity") * F.col("unit")).alias("yhat"))
    m = ST.regression_metrics(p, "y", "yhat")
    return m.withColumns({k: F.round(k, 6) for k in ("rmse", "mae", "r2")})


@register("vif", sql="""
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT 'l_quantity' AS "column", round(1 / (1 - r * r), 6) AS vif FROM c
UNION ALL SELECT 'l_extendedprice', round(1 / (1 - r * r), 6) FROM c""")
def q_vif(t):
    return ST.vif(t.lineitem, ["l_quantity", "l_extendedprice"]).withColumn("vif", F.round("vif", 6))


_LM = """
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
                  regr_r2(l_extendedprice, l_quantity) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
                  regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
                  regr_sxy(l_extendedprice, l_quantity) AS sxy, avg(l_quantity) AS xbar FROM lineitem),
e AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM s)"""


@register("lm_fit", sql=_LM + """
SELECT '(Intercept)' AS term, round(a, 6) AS estimate, round(sqrt(s2 * (1.0 / n + xbar * xbar / sxx)), 6) AS std_error,
       round(a / sqrt(s2 * (1.0 / n + xbar * xbar / sxx)), 6) AS t_value, round(r2, 6) AS r_squared, n FROM e
UNION ALL
SELECT 'l_quantity', round(b, 6), round(sqrt(s2 / sxx), 6), round(b / sqrt(s2 / sxx), 6), round(r2, 6), n FROM e""")
def q_lm_fit(t):
    r = ST.lm_fit(t.lineitem, "l_extendedprice", ["l_quantity"])
    return r.withColumns({k: F.round(k, 6) for k in ("estimate", "std_error", "t_value", "r_squared")})


def _hc_sql(scale, kind):
    return f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
                  count(*) AS n, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) AS sxx FROM lineitem),
m AS (SELECT sum((l_extendedprice - a - b * l_quantity) ^ 2) AS m00,
             sum(l_quantity * (l_extendedprice - a - b * l_quantity) ^ 2) AS m01,
             sum(l_quantity * l_quantity * (l_extendedprice - a - b * l_quantity) ^ 2) AS m11,
             any_value(n) AS n, any_value(sx) AS sx, any_value(sxx) AS sxx, any_value(a) AS a, any_value(b) AS b
      FROM lineitem, f),
v AS (SELECT *, n * sxx - sx * sx AS det FROM m)
SELECT '(Intercept)' AS term, round(a, 6) AS estimate,
       round(sqrt((sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (det * det) * {scale}), 6) AS std_error,
       '{kind}' AS kind FROM v
UNION ALL
SELECT 'l_quantity', round(b, 6), round(sqrt((sx * sx * m00 - 2 * n * sx * m01 + n * n * m11) / (det * det) * {scale}), 6),
       '{kind}' FROM v"""


@register("robust_se", sql=_hc_sql("(n / (n - 2.0))", "HC1"))
def q_robust_se(t):
    r = ST.robust_se(t.lineitem, "l_extendedprice", ["l_quantity"], "HC1")
    return r.withColumns({k: F.round(k, 6) for k in ("estimate", "std_error")})


@register("robust_se_hc0", sql=_hc_sql("1.0", "HC0"))
def q_robust_se_hc0(t):
    r = ST.robust_se(t.lineitem, "l_extendedprice", ["l_quantity"], "HC0")
    return r.withColumns({k: F.round(k, 6) for k in ("estimate", "std_error")})


@register("robust_se_cluster", sql="""
WITH b AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS b0,
                  count(*) AS n, avg(l_quantity) AS mx, var_pop(l_quantity) * count(*) AS sxx FROM lineitem),
s AS (SELECT l_orderkey, sum(l_extendedprice - b0 - b1 * l_quantity) AS e,
             sum((l_extendedprice - b0 - b1 * l_quantity) * l_quantity) AS ex FROM lineitem, b GROUP BY l_orderkey),
m AS (SELECT sum(e * e) AS m00, sum(e * ex) AS m01, sum(ex * ex) AS m11, count(*) AS g FROM s),
v AS (SELECT *, (g / (g - 1.0)) * ((n - 1.0) / (n - 2.0)) AS c, 1.0 / n + mx * mx / sxx AS i00, -mx / sxx AS i01, 1 / sxx AS i11 FROM m, b)
SELECT '(Intercept)' AS term, round(b0, 4) AS estimate,
       round(sqrt(c * (i00 * i00 * m00 + 2 * i00 * i01 * m01 + i01 * i01 * m11)), 4) AS std_error, 'cluster' AS kind FROM v
UNION ALL
SELECT 'l_quantity', round(b1, 4), round(sqrt(c * (i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11)), 4), 'cluster' FROM v""")
def q_robust_se_cluster(t):
    """Cluster-robust (by order) standard errors."""
    r = ST.robust_se(t.lineitem, "l_extendedprice", ["l_quantity"], cluster="l_orderkey")
    return r.withColumns({k: F.round(k, 4) for k in ("estimate", "std_error")})


@register("robust_se_cluster_two")
def q_robust_se_cluster_two(t):
    """Cluster-robust (by order) standard errors of two regressors."""
    r = ST.robust_se(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], cluster="l_orderkey")
    return r.withColumns({k: F.round(k, 4) for k in ("estimate", "std_error")})


@register("naive_bayes", sql=f"""
WITH s AS (SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT quality, count(*) AS n, round(avg(n_chars), 6) AS mean_n_chars, round(var_pop(n_chars), 4) AS var_n_chars
      FROM s GROUP BY 1)
SELECT *, round(n / sum(n) OVER (), 6) AS prior FROM g""")
def q_naive_bayes(t):
    d = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    m = ST.naive_bayes_moments(d, "quality", ["n_chars"])
    return m.withColumns({"mean_n_chars": F.round("mean_n_chars", 6), "var_n_chars": F.round("var_n_chars", 4),
                          "prior": F.round("prior", 6)})


@register("naive_bayes_scores", sql="""
WITH s AS (SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT quality, count(*) / (SELECT count(*) FROM s) AS prior, avg(n_chars) AS m, var_pop(n_chars) AS v FROM s GROUP BY 1),
p AS (SELECT doc_id, g.quality, ln(prior) - 0.5 * ln(2 * pi() * v) - (n_chars - m) ^ 2 / (2 * v) AS ll FROM s, g)
SELECT doc_id, arg_max(quality, ll) AS predicted, round(max(ll), 6) AS log_post FROM p GROUP BY doc_id""")
def q_naive_bayes_scores(t):
    """Gaussian naive Bayes predicted quality per labelled document."""
    d = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    return ST.naive_bayes_scores(d, "quality", ["n_chars"], key="doc_id").withColumn("log_post", F.round("log_post", 6))


_NZV_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _nzv_sql():
    parts = []
    for c in _NZV_COLS:
        parts.append(f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 2""")
    return ("WITH c AS (" + "\nUNION ALL ".join(parts) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk FROM c)
SELECT "column", round(max(n) FILTER (WHERE rk = 1) / max(n) FILTER (WHERE rk = 2), 6) AS freq_ratio,
       round(count(value) * 100.0 / sum(n), 6) AS percent_unique, count(value) AS n_distinct
FROM r GROUP BY 1""")


@register("near_zero_var", sql=_nzv_sql())
def q_near_zero_var(t):
    li = t.lineitem
    # text form of doubles must agree across engines: format through decimal
    li = li.select(*[F.col(c).cast("decimal(12,2)").alias(c) if c in ("l_quantity", "l_discount", "l_tax") else F.col(c)
                     for c in _NZV_COLS])
    n = ST.near_zero_var(li, _NZV_COLS)
    return n.withColumns({"freq_ratio": F.round("freq_ratio", 6), "percent_unique": F.round("percent_unique", 6)})


@register("preprocess", sql="""
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                  stddev_samp(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity,
       round((l_extendedprice - mp) / sp, 6) AS l_extendedprice
FROM lineitem, s""")
def q_preprocess(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    p = ST.preprocess(li, ["l_quantity", "l_extendedprice"], ("center", "scale"))
    return p.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})


@register("preprocess_range", sql="""
WITH s AS (SELECT min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_discount - lo) / (hi - lo), 6) AS l_discount FROM lineitem, s""")
def q_preprocess_range(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount")
    return ST.preprocess(li, ["l_discount"], ("range",)).withColumn("l_discount", F.round("l_discount", 6))


@register("preprocess_impute", sql=f"""
WITH g AS {EVENTS_GAPPY_SQL}, m AS (SELECT quantile_cont(value, 0.5) AS med FROM g)
SELECT event_id, coalesce(value, med) AS value FROM g, m""")
def q_preprocess_impute(t):
    g = events_gappy(t).select("event_id", "value")
    return ST.preprocess(g, ["value"], ("impute",))


@register("drop_correlated")
def q_drop_correlated(t):
    """Columns of lineitem to drop at |r| > 0.5 (greedy pick on the k x k matrix)."""
    li = t.lineitem.withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return ST.drop_correlated(li, ["l_quantity", "l_extendedprice", "l_net", "l_discount", "l_tax"], 0.5)


@register("split_stratified", sql="""
WITH r AS (SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST('0x' || substr(md5(o_orderkey || '|42'), 1, 15) AS BIGINT), o_orderkey) - 1 AS pos,
  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, pos < floor(0.8 * n) AS is_train, CAST(pos % 5 AS INTEGER) AS fold FROM r""")
def q_split_stratified(t):
    """Repeatable 80/20 split and 5 folds of orders, stratified by status."""
    return ST.split_stratified(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus",
                               p=0.8, k=5, seed=42)


@register("lm_fit_formula", sql="""
WITH g AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_extendedprice) AS m, sum(l_extendedprice ^ 2) - count(*) * avg(l_extendedprice) ^ 2 AS ss
           FROM lineitem GROUP BY 1),
r AS (SELECT f, n, m FROM g ORDER BY n, f DESC LIMIT 1),
s AS (SELECT sum(ss) / (sum(n) - count(*)) AS s2, 1 - sum(ss) / (SELECT var_pop(l_extendedprice) * count(*) FROM lineitem) AS r2 FROM g),
t AS (SELECT '(Intercept)' AS term, r.m AS estimate, sqrt(s2 / r.n) AS std_error FROM r, s
      UNION ALL SELECT 'l_returnflag_' || g.f, g.m - r.m, sqrt(s2 * (1 / g.n + 1 / r.n)) FROM g, r, s WHERE g.f <> r.f)
SELECT term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error, round(r2, 6) AS r_squared FROM t, s""")
def q_lm_fit_formula(t):
    """Price on a factor: the coefficients are differences of group means."""
    r = ST.lm_fit(t.lineitem, "l_extendedprice ~ l_returnflag")
    return r.select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"),
                    F.round("r_squared", 6).alias("r_squared"))


_CAT = """s AS (SELECT o_orderkey AS k, o_orderstatus AS y, o_orderpriority AS a, CAST(o_custkey % 4 AS INTEGER) AS b FROM orders)"""


def _categories(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("y"), F.col("o_orderpriority").alias("a"),
                           (F.col("o_custkey") % 4).cast("int").alias("b"))


@register("naive_bayes_levels", sql=f"""
WITH {_CAT}, c AS (SELECT y, count(*) AS t FROM s GROUP BY y), l AS (SELECT DISTINCT a FROM s),
n AS (SELECT a, y, count(*) AS n FROM s GROUP BY ALL)
SELECT l.a, c.y, coalesce(n.n, 0) AS n, round(ln((coalesce(n.n, 0) + 1.0) / (c.t + (SELECT count(*) FROM l))), 6) AS log_prob
FROM l CROSS JOIN c LEFT JOIN n ON n.a = l.a AND n.y = c.y""")
def q_nb_levels(t):
    return ST.naive_bayes_levels(_categories(t), "y", "a").withColumn("log_prob", F.round("log_prob", 6))


@register("naive_bayes_category_scores", sql=f"""
WITH {_CAT}, c AS (SELECT y, count(*) AS t FROM s GROUP BY y),
p AS (SELECT s.k, c.y, ln(c.t / (SELECT count(*) FROM s))
        + ln(((SELECT count(*) FROM s u WHERE u.a = s.a AND u.y = c.y) + 1.0) / (c.t + (SELECT count(DISTINCT a) FROM s)))
        + ln(((SELECT count(*) FROM s u WHERE u.b = s.b AND u.y = c.y) + 1.0) / (c.t + (SELECT count(DISTINCT b) FROM s))) AS ll
      FROM s CROSS JOIN c)
SELECT k, arg_max(y, (round(ll, 9), -ascii(y))) AS predicted, round(max(ll), 6) AS log_post FROM p GROUP BY k""")
def q_nb_category_scores(t):
    return ST.naive_bayes_category_scores(_categories(t), "y", ["a", "b"], "k").withColumn("log_post", F.round("log_post", 6))
