"""Values of fitted models against numpy and closed forms (no SQL expresses the fits)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.operators import models as MD
from tessera.operators import stats as ST
from tessera.operators import survival as SV


@pytest.fixture(scope="module")
def docs(spark, medium_dir):
    d, lab = (spark.read.parquet(f"{medium_dir}/{t}.parquet") for t in ("documents", "labels"))
    return d.select("doc_id", "lang", "n_chars").join(lab.select("doc_id", "quality"), "doc_id")


def test_poisson_fit_of_one_factor_is_the_log_of_group_means(spark, medium_dir):
    got = {r.term: r.estimate for r in E.queries()["glm_fit_poisson"](spark, medium_dir).collect()}
    per = spark.read.parquet(f"{medium_dir}/orders.parquet").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    cust = spark.read.parquet(f"{medium_dir}/customer.parquet")
    means = {r.s: r.m for r in per.join(cust, per.o_custkey == cust.c_custkey).groupBy(F.col("c_mktsegment").alias("s"))
             .agg(F.avg("n").alias("m")).collect()}
    base = got.pop("(Intercept)")
    seen = set()
    for term, e in got.items():
        seg = next(s for s in means if term.endswith(s))
        seen.add(seg)
        assert math.isclose(base + e, math.log(means[seg]), abs_tol=1e-5)
    (ref,) = set(means) - seen
    assert math.isclose(base, math.log(means[ref]), abs_tol=1e-5)


def test_logit_fit_meets_its_equations(spark, docs):
    fit = {r.term: r.estimate for r in MD.glm_fit(docs.withColumn("x", F.col("n_chars") / 1000), "quality ~ x", "binomial").collect()}
    pdf = docs.toPandas()
    x = pdf.n_chars.to_numpy() / 1000
    p = 1 / (1 + np.exp(-(fit["(Intercept)"] + fit["x"] * x)))
    g = pdf.quality.to_numpy() - p
    assert abs(g.sum()) < 1e-3 and abs((g * x).sum()) < 1e-2


def test_cluster_errors_with_two_regressors(spark, medium_dir):
    li = spark.read.parquet(f"{medium_dir}/lineitem.parquet").where("l_orderkey < 2000")
    got = {r.term: r.std_error for r in ST.robust_se(li, "l_extendedprice", ["l_quantity", "l_discount"], cluster="l_orderkey").collect()}
    p = li.toPandas()
    x = np.column_stack([np.ones(len(p)), p.l_quantity, p.l_discount])
    y = p.l_extendedprice.to_numpy()
    b = np.linalg.solve(x.T @ x, x.T @ y)
    s = np.array([x[i].T @ (y - x @ b)[i] for i in p.groupby("l_orderkey").indices.values()])
    n, k, g = len(p), 3, len(s)
    bread = np.linalg.inv(x.T @ x)
    want = np.sqrt(np.diag(bread @ (s.T @ s) @ bread) * g / (g - 1) * (n - 1) / (n - k))
    assert np.allclose([got["(Intercept)"], got["l_quantity"], got["l_discount"]], want, rtol=1e-6)


def test_drop_correlated_against_numpy(spark, medium_dir):
    li = spark.read.parquet(f"{medium_dir}/lineitem.parquet").withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    cols = ["l_quantity", "l_extendedprice", "l_net", "l_discount", "l_tax"]
    r = np.abs(np.corrcoef(li.select(*cols).toPandas().to_numpy().T))
    alive, want = list(range(5)), []
    while True:
        sub = r[np.ix_(alive, alive)] - np.eye(len(alive))
        i, j = np.unravel_index(np.argmax(sub), sub.shape)
        if sub[i, j] <= 0.5:
            break
        m = sub.sum(1)
        v = alive[i] if m[i] >= m[j] else alive[j]
        want.append(cols[v])
        alive.remove(v)
    assert [x.column for x in ST.drop_correlated(li, cols, 0.5).collect()] == want


def test_classification_tree(spark):
    rows = [(i, float(i % 10), "hi" if i % 10 > 6 else "lo" if i % 10 < 3 else "mid") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x double, y string")
    rules = MD.tree_fit(df, "y ~ x", depth=3, min_n=5, kind="classification").collect()
    assert len(rules) == 3


def test_aft_recovers_a_planted_effect(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, 4000)
    t = np.exp(2 + 0.8 * x) * rng.weibull(2.0, 4000)
    c = rng.exponential(40, 4000)
    df = spark.createDataFrame([(float(min(a, b)), int(a <= b), float(z)) for a, b, z in zip(t, c, x)], "d double, e int, x double")
    fit = {r.term: r.estimate for r in SV.aft_fit(df, "d", "e", ["x"]).collect()}
    assert abs(fit["x"] - 0.8) < 0.08 and abs(fit["(Intercept)"] - 2) < 0.08 and abs(fit["log(scale)"] - math.log(0.5)) < 0.08


def test_linear_svm_separates(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 600))
    df = spark.createDataFrame([(float(u), float(v), int(2 * u - v > 0.3)) for u, v in zip(a, b)], "a double, b double, y int")
    w = {r.term: r.coefficient for r in MD.svm_linear(df, "y ~ a + b").collect()}
    s = w["a"] * a + w["b"] * b + w["(Intercept)"]
    assert ((s > 0) == (2 * a - b > 0.3)).mean() > 0.97


def test_break_dates_against_all_cuts(spark):
    from tessera.operators.change import breakpoints
    rng = np.random.default_rng(7)
    y = np.concatenate([rng.normal(0, 1, 20), rng.normal(3, 1, 18), rng.normal(-2, 1, 22)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t long, y double")
    got = breakpoints(df, "t", "y", max_breaks=2, min_frac=0.1).where("n_breaks = 2").orderBy("break_index").collect()
    def rss(v):
        return ((v - v.mean()) ** 2).sum()
    best = min((rss(y[:i]) + rss(y[i:j]) + rss(y[j:]), i, j) for i in range(6, 49) for j in range(i + 6, 55))
    assert [r.break_order for r in got] == [best[1] - 1, best[2] - 1] and math.isclose(got[0].rss, best[0], rel_tol=1e-9)


def test_cluster_errors_of_two_regressors(spark, medium_dir):
    rows = E.queries()["robust_se_cluster_two"](spark, medium_dir).collect()
    names = ["l_orderkey", "l_extendedprice", "l_quantity", "l_discount"]
    pdf = spark.read.parquet(f"{medium_dir}/lineitem.parquet").select(names).dropna().toPandas().astype(float)
    y, x = pdf.l_extendedprice.to_numpy(), np.column_stack([np.ones(len(pdf)), pdf.l_quantity, pdf.l_discount])
    inverse = np.linalg.inv(x.T @ x)
    b = inverse @ x.T @ y
    _, at = np.unique(pdf.l_orderkey, return_inverse=True)
    g, n = at.max() + 1, len(y)
    score = np.zeros((g, 3))
    np.add.at(score, at, x * (y - x @ b)[:, None])
    v = inverse @ score.T @ score @ inverse * (g / (g - 1)) * ((n - 1) / (n - 3))
    assert [r.term for r in rows] == ["(Intercept)", "l_quantity", "l_discount"]
    assert np.allclose([r.estimate for r in rows], b, rtol=1e-6, atol=1e-3)
    assert np.allclose([r.std_error for r in rows], np.sqrt(np.diag(v)), rtol=1e-6, atol=1e-3)
