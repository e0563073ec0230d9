"""Break points by functional pruning, sliding medians, Cox states, cross-validation from fold sums."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import change as C
from tessera.operators import crossval as CV
from tessera.operators import models as MD
from tessera.operators import survival as SV
from tessera.operators import windows as W
from tessera.operators.sliding import SlidingMedian


# --- break points

def plain_costs(v, max_breaks, min_size):
    """Every start for every end."""
    n = len(v)
    c1, c2 = np.concatenate([[0.0], np.cumsum(v)]), np.concatenate([[0.0], np.cumsum(v * v)])
    seg = lambda i, j: c2[j] - c2[i] - (c1[j] - c1[i]) ** 2 / (j - i)
    cost = np.full((max_breaks + 1, n + 1), np.inf)
    for j in range(min_size, n + 1):
        cost[0, j] = seg(0, j)
    for m in range(1, max_breaks + 1):
        for j in range((m + 1) * min_size, n + 1):
            cost[m, j] = min(cost[m - 1, i] + seg(i, j) for i in range(m * min_size, j - min_size + 1))
    return cost


@pytest.mark.parametrize("seed", range(12))
def test_pruned_costs_equal_the_plain_programme(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 70))
    kind = seed % 4
    v = rng.normal(size=n) + (np.arange(n) > n // 2) * 3 if kind == 0 else rng.integers(0, 3, n).astype(float) if kind == 1 \
        else np.cumsum(rng.normal(size=n)) if kind == 2 else np.full(n, 7.0)
    for min_size in (1, 2, 5):
        got, back = C.segment_costs(v, 4, min_size)
        want = plain_costs(v - v.mean(), 4, min_size)
        both = np.isfinite(want)
        assert (np.isfinite(got) == both).all()
        assert np.allclose(got[both], want[both], rtol=1e-9, atol=1e-8)
        for m in range(1, 5):  # the starts belong to the costs
            for j in np.flatnonzero(np.isfinite(got[m])):
                i = back[m, j]
                seg = v[i:j]
                assert j - i >= min_size and math.isclose(got[m, j], got[m - 1, i] + ((seg - seg.mean()) ** 2).sum(), rel_tol=1e-7, abs_tol=1e-7)


def test_breaks_of_a_hundred_thousand_points(spark):
    n = 100_000
    level = F.when(F.col("id") < 30_000, 0.0).when(F.col("id") < 75_000, 2.0).otherwise(-1.0)
    df = spark.range(n).select(F.col("id").alias("t"), (level + F.randn(3)).alias("y"))
    start = time.time()
    rows = [(r.break_index, r.break_order) for r in C.breakpoints(df, "t", "y", max_breaks=2, min_frac=0.1).where("n_breaks = 2").collect()]
    assert time.time() - start < 120
    assert [i for i, _ in sorted(rows)] == [1, 2]
    assert abs(sorted(rows)[0][1] - 29_999) < 20 and abs(sorted(rows)[1][1] - 74_999) < 20


def test_breakpoints_leave_out_nulls_and_take_each_series_share(spark):
    rows = [("a", i, 0.0 if i < 10 else 5.0) for i in range(20)] + [("b", i, float(i >= 50)) for i in range(100)] + [("a", None, 1.0), ("a", 99, None), ("c", 1, 1.0)]
    out = C.breakpoints(spark.createDataFrame(rows, "k string, t int, y double"), "t", "y", by="k", max_breaks=1)
    got = {(r.series, r.n_breaks): r.break_order for r in out.collect()}
    assert got == {("a", 0): None, ("a", 1): 9, ("b", 0): None, ("b", 1): 49}


def test_cusum_of_one_series_has_no_single_window(spark):
    rng = random.Random(3)
    rows = [(i, None if i == 7 else rng.gauss(0, 1)) for i in range(50)]
    df = spark.createDataFrame(rows, "t int, y double")
    one = {r.t: (r.resid, r.cusum, r.max_abs) for r in C.ols_cusum(df, "t", "y").collect()}
    whole = {r.t: (r.resid, r.cusum, r.max_abs) for r in C.ols_cusum(df.withColumn("k", F.lit(1)), "t", "y", by="k").collect()}
    for t, want in whole.items():
        assert one[t] == pytest.approx(want)


# --- sliding medians

def test_sliding_median_state():
    rng = random.Random(1)
    xs = [rng.choice([None, float("nan"), 1.0, 2.0, 2.0, rng.random()]) for _ in range(300)]
    for k in (1, 2, 5):
        state = SlidingMedian(k)
        for i, x in enumerate(xs):
            got, frame = state.push(x), [y for y in xs[max(0, i - k + 1):i + 1] if y is not None]
            if i < k - 1 or not frame:
                assert got is None
                continue
            s = sorted(frame, key=lambda y: (y != y, y))
            want = s[len(s) // 2] if len(s) % 2 else (s[len(s) // 2 - 1] + s[len(s) // 2]) / 2
            assert got == want or got != got and want != want


@pytest.mark.parametrize("align,k", [("right", 4), ("center", 5), ("center", 1), ("right", 50)])
@pytest.mark.parametrize("hot", [None, 10])
def test_rolling_median(spark, align, k, hot):
    rng = random.Random(k)
    rows = [(i, rng.choice([1, 2, None]), rng.randint(0, 500), rng.choice([None, rng.gauss(0, 1)])) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, g int, t int, v double")
    got = {r.id: r.m for r in W.rolling_rows(df, "g", ["t", "id"], "v", k, "median", align, "m", hot_rows=hot).collect()}
    assert len(got) == len(rows)
    for g in (1, 2, None):
        seq = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(seq):
            lo, hi = (i - k + 1, i) if align == "right" else (i - k // 2, i + k // 2)
            frame = [x[3] for x in seq[max(lo, 0):hi + 1] if x[3] is not None]
            want = float(np.median(frame)) if lo >= 0 and hi < len(seq) and frame else None
            assert got[r[0]] == (None if want is None else pytest.approx(want))


def test_wide_rolling_median_is_near_the_rolling_mean(spark):
    df = spark.range(60_000).select((F.col("id") % 4).alias("g"), "id", F.rand(5).alias("v"))
    took = {}
    for fn in ("median", "mean", "median", "mean"):
        start = time.time()
        W.rolling_rows(df, "g", ["id"], "v", 10_001, fn, hot_rows=None).write.format("noop").mode("overwrite").save()
        took[fn] = time.time() - start
    assert took["median"] < 3 * took["mean"] + 1


# --- Cox

def cox_numpy(t, e, x, steps=60):
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        r = np.exp(x @ b)
        u, info, ll = np.zeros(len(b)), np.zeros((len(b), len(b))), 0.0
        for i in np.flatnonzero(e):
            risk = t >= t[i]
            w = r[risk] / r[risk].sum()
            m = w @ x[risk]
            u += x[i] - m
            info += (x[risk].T * w) @ x[risk] - np.outer(m, m)
            ll += x[i] @ b - np.log(r[risk].sum())
        b = b + np.linalg.solve(info, u)
    return b, np.sqrt(np.diag(np.linalg.inv(info))), ll


def test_cox_converges(spark):
    rng = np.random.default_rng(2)
    n = 120
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n)])
    t = np.round(rng.exponential(np.exp(-(x @ [0.8, -0.5]))) * 10 + 1)
    e = rng.random(n) < 0.7
    df = spark.createDataFrame([(float(a), int(b), float(c), float(d) + 1000.0) for a, b, (c, d) in zip(t, e, x)], "t double, e int, x double, z double")
    rows = SV.cox_fit(df, "t", "e", ["x", "z"]).collect()
    b, se, ll = cox_numpy(t, e, x)
    assert [r.status for r in rows] == ["converged"] * 2
    assert [r.estimate for r in rows] == pytest.approx(list(b), abs=1e-7) and [r.std_error for r in rows] == pytest.approx(list(se), rel=1e-5)
    assert rows[0].loglik == pytest.approx(ll, rel=1e-8)


def test_cox_states(spark):
    rows = [(float(i), 1, float(i < 10), 3.0) for i in range(20)]  # group 1 fails first, entirely
    df = spark.createDataFrame(rows, "t double, e int, x double, c double")
    got = SV.cox_fit(df, "t", "e", ["x"]).first()
    assert got.status == "separated" and got.estimate > 5
    assert {r.status for r in SV.cox_fit(df, "t", "e", ["x", "c"]).collect()} <= {"separated", "singular"}
    same = SV.cox_fit(df.withColumn("x", F.col("t") % 3), "t", "e", ["x", "c"]).collect()
    assert {r.status for r in same} == {"singular"} and same[1].std_error is None
    none = SV.cox_fit(df.withColumn("e", F.lit(0)), "t", "e", ["x"]).first()
    assert (none.status, none.estimate, none.loglik) == ("no_events", None, None)
    assert SV.cox_fit(df.limit(0), "t", "e", ["x"]).first().status == "no_events"


# --- cross-validation

@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(9)
    n = 240
    x = np.column_stack([rng.normal(5, 2, n), rng.normal(size=n)])
    y = 3 + x @ [1.5, -2.0] + rng.normal(size=n)
    d = (rng.random(n) < 1 / (1 + np.exp(-(x @ [0.6, -1.0] - 3)))).astype(float)
    f = rng.integers(0, 4, n)
    rows = [(float(a), float(b), float(c), float(q), int(k)) for (a, b), c, q, k in zip(x, y, d, f)]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 0)], "a double, b double, y double, d double, fold int"), x, y, d, f


def test_linear_folds_equal_refitting(folded):
    df, x, y, _, f = folded
    got = CV.cv_linear(df, "y", ["a", "b"], "fold").orderBy("fold").collect()
    design = np.column_stack([np.ones(len(y)), x])
    for r in got:
        b = np.linalg.lstsq(design[f != r.fold], y[f != r.fold], rcond=None)[0]
        rest = y[f == r.fold] - design[f == r.fold] @ b
        assert r.coefficients == pytest.approx(list(b)) and r.rmse == pytest.approx(math.sqrt((rest ** 2).mean()))
        assert (r.n_train, r.n_test) == ((f != r.fold).sum(), (f == r.fold).sum())


def test_logistic_folds_equal_refitting(folded):
    df, x, _, d, f = folded
    got = CV.cv_logistic(df, "d", ["a", "b"], "fold").orderBy("fold").collect()
    design = np.column_stack([np.ones(len(d)), x])
    for r in got:
        z, q, b = design[f != r.fold], d[f != r.fold], np.zeros(3)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-z @ b))
            b = b + np.linalg.solve((z.T * (mu * (1 - mu))) @ z, z.T @ (q - mu))
        mu = 1 / (1 + np.exp(-design[f == r.fold] @ b))
        assert r.coefficients == pytest.approx(list(b), rel=1e-6) and r.rmse == pytest.approx(math.sqrt(((d[f == r.fold] - mu) ** 2).mean()))


def test_folds_without_a_training_set(folded):
    df = folded[0]
    one = df.withColumn("fold", F.lit(0))
    for fn, y in ((CV.cv_linear, "y"), (CV.cv_logistic, "d")):
        r = fn(one, y, ["a"], "fold").first()
        assert (r.n_train, r.rmse, r.coefficients) == (0, None, None)
        assert fn(df.limit(0), y, ["a"], "fold").count() == 0


def test_cross_validate_takes_the_mean(folded):
    df = folded[0]
    for model, fn, y in (("lm", CV.cv_linear, "y"), ("glm", CV.cv_logistic, "d")):
        got = MD.cross_validate(df, f"{y} ~ a + b", "fold", model).first()
        assert got.setting == model and got.metric == pytest.approx(np.mean([r.rmse for r in fn(df, y, ["a", "b"], "fold").collect()]))
