"""Model and user-function queries (inventory sections 2.11 and 2.13)."""

from pyspark.sql import functions as F

from tessera.operators import aggregate as A
from tessera.operators import models as MD
from tessera.operators import stats as ST
from tessera.operators import udf as U
from tessera.plans.registry import register

FORMULA = "quality ~ n_chars + lang + source"


def labelled_docs(t):
    return t.documents.select("doc_id", "n_chars", "lang", "source").join(
        t.labels.select("doc_id", "quality"), "doc_id")


@register("formula_encode", sql="""
WITH d AS (SELECT d.doc_id, d.n_chars, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)),
lv AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) AS i, count(*) OVER () AS k FROM d GROUP BY lang)
SELECT doc_id, CAST(quality AS DOUBLE) AS label,
       list_prepend(CAST(n_chars AS DOUBLE), (SELECT list(CAST(lv.lang = d.lang AS DOUBLE) ORDER BY i) FROM lv WHERE i < k)) AS features
FROM d""")
def q_formula_encode(t):
    """quality ~ n_chars + lang: label and one-hot feature vector per document."""
    return MD.formula_encode(labelled_docs(t), "quality ~ n_chars + lang", keep=["doc_id"])


@register("tree_fit")
def q_tree_fit(t):
    """Regression tree of the quality rate on labelled documents; one row per
    leaf rule. (A classification tree here collapses to its root: Spark merges
    sibling leaves that predict the same majority class.)"""
    return MD.tree_fit(labelled_docs(t), FORMULA, depth=4, min_n=10, kind="regression")


@register("forest_fit")
def q_forest_fit(t):
    """Random forest importances on labelled documents."""
    return MD.forest_fit(labelled_docs(t), FORMULA, n_trees=20, depth=4)


@register("svm_linear")
def q_svm_linear(t):
    """Linear SVM coefficients on labelled documents."""
    return MD.svm_linear(labelled_docs(t), "quality ~ n_chars + lang")


@register("glm_fit")
def q_glm_fit(t):
    """Binomial GLM (logit) of quality on n_chars and lang."""
    return MD.glm_fit(labelled_docs(t), "quality ~ n_chars + lang", "binomial")


@register("glm_fit_poisson")
def q_glm_fit_poisson(t):
    """Poisson GLM of orders per customer on market segment."""
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")).join(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return MD.glm_fit(per, "n_orders ~ c_mktsegment", "poisson")


@register("cross_validate")
def q_cross_validate(t):
    """5-fold CV of tree depth on labelled documents, folds stratified by label."""
    d = labelled_docs(t)
    folds = ST.split_stratified(d, "doc_id", "quality", p=1.0, k=5, seed=7)
    return MD.cross_validate(folds, FORMULA, "fold", "tree", {"maxDepth": [2, 4, 6]})


@register("cross_validate_lm", sql="""
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, l_orderkey % 5 AS f FROM lineitem),
m AS (SELECT g.f, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d JOIN (SELECT DISTINCT f FROM d) g ON d.f <> g.f GROUP BY g.f)
SELECT 'lm' AS setting, round(avg(rmse), 4) AS metric
FROM (SELECT d.f, sqrt(avg((y - a - b * x) ^ 2)) AS rmse FROM d JOIN m ON d.f = m.f GROUP BY d.f)""")
def q_cross_validate_lm(t):
    """5-fold error of a linear model, from one scan of sums per fold."""
    d = t.lineitem.select("l_extendedprice", "l_quantity", (F.col("l_orderkey") % 5).cast("int").alias("fold"))
    return MD.cross_validate(d, "l_extendedprice ~ l_quantity", "fold", "lm").withColumn("metric", F.round("metric", 4))


@register("cross_validate_glm")
def q_cross_validate_glm(t):
    """5-fold error of a logistic model of quality, all folds fitted together."""
    d = labelled_docs(t).withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    return MD.cross_validate(d, "quality ~ n_chars + lang", "fold", "glm")


@register("glm_fit_gamma", sql="""
WITH g AS (SELECT o_orderpriority AS p, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p) AS i, count(*) OVER () AS k FROM g),
b AS (SELECT m AS m0 FROM r WHERE i = k)
SELECT CASE WHEN i = k THEN '(Intercept)' ELSE 'o_orderpriority_' || p END AS term,
       round(CASE WHEN i = k THEN ln(m0) ELSE ln(m / m0) END, 4) AS estimate FROM r, b""")
def q_glm_fit_gamma(t):
    """Gamma GLM, log link, of order value on priority: with one factor the fit is the log of the group means."""
    fit = MD.glm_fit(t.orders, "o_totalprice ~ o_orderpriority", "gamma", "log")
    return fit.select("term", F.round("estimate", 4).alias("estimate"))


# ------------------------------------------------------------------ 2.11
@register("row_map", sql="SELECT l_orderkey, l_linenumber, l_extendedprice * 2.0 + 1.0 AS price_mapped FROM lineitem")
def q_row_map(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return U.row_map(li, "l_extendedprice", lambda s: s * 2.0 + 1.0, "double", "price_mapped").drop("l_extendedprice")


@register("group_map", sql="""
SELECT o_custkey, count(*) AS n,
       round(regr_slope(o_totalprice, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))), 4) AS slope
FROM orders GROUP BY o_custkey""")
def q_group_map(t):
    o = t.orders.select("o_custkey", "o_totalprice",
                        F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("day"))
    # split-apply-combine in two levels: partial sums per run of a customer in a
    # batch, all runs of a batch in one call and before the shuffle, then the slope per customer from its partial rows
    r = U.group_map(o, "o_custkey",
                    U.ols_moments_runs("day", "o_totalprice", "o_custkey", shift_x=10957.0, shift_y=250000.0),
                    "o_custkey long, " + U.MOMENT_SCHEMA, kind="arrow_runs",
                    combine=U.ols_slope_combine_spark("o_custkey"))
    return r.withColumn("slope", F.round("slope", 4))


@register("group_map_batches", sql="""
SELECT o_orderpriority, count(*) AS n, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1""")
def q_group_map_batches(t):
    """A user function that sees each priority as an iterator of batches."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def spread(batches):
        n, low, high, key = 0, None, None, None
        for b in batches:
            key = b.column("o_orderpriority")[0].as_py()
            got = pc.min_max(b.column("o_totalprice")).as_py()
            n += b.num_rows
            low = got["min"] if low is None else min(low, got["min"])
            high = got["max"] if high is None else max(high, got["max"])
        yield pa.RecordBatch.from_pydict({"o_orderpriority": [key], "n": [n], "spread": [high - low]})

    r = U.group_map(t.orders.select("o_orderpriority", "o_totalprice"), "o_orderpriority", spread,
                    "o_orderpriority string, n long, spread double", "arrow_batches")
    return r.withColumn("spread", F.round("spread", 2))


@register("group_reduce", sql="""
SELECT o_orderpriority, round(exp(avg(ln(o_totalprice))), 4) AS geo_mean FROM orders GROUP BY 1""")
def q_group_reduce(t):
    """Geometric mean per priority: a user aggregate (sum of logs)
    reduced in two levels, so no worker holds a whole priority group."""
    o = t.orders
    r = U.group_reduce(o, "o_orderpriority", "o_totalprice", U.sum_of_logs, "double", "log_sum",
                       combine=U.plain_sum)
    n = o.groupBy("o_orderpriority").agg(F.count("o_totalprice").alias("__n"))
    return r.join(n, "o_orderpriority").select(
        "o_orderpriority", F.round(F.exp(F.col("log_sum") / F.col("__n")), 4).alias("geo_mean"))


@register("trimmed_mean", sql="""
WITH r AS (SELECT o_orderpriority, o_totalprice,
                  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn,
                  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS trimmed_mean FROM r
WHERE rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1) GROUP BY 1""")
def q_trimmed_mean(t):
    """10% trimmed mean per priority, exact and distributed (the non-decomposable
    aggregate done with the running-count recipe instead of a per-group UDF)."""
    r = A.trimmed_mean(t.orders, "o_orderpriority", "o_totalprice", 0.1)
    return r.withColumn("trimmed_mean", F.round("trimmed_mean", 4))
