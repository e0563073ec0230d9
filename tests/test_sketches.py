"""KLL sketches: stated rank error, merging, and the operators that take them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate as A
from tessera.operators import profile as P
from tessera.operators import rfm
from tessera.operators import verbs as V
from tessera.operators.ranking import merged_sketches, quantile_sketches, sketch_quantiles, sketch_rank_error

PROBS = [0.01, 0.25, 0.5, 0.9, 0.99]


@pytest.fixture(scope="module")
def values(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 17 > 0, F.exp(3 * F.randn(7))).alias("v"))
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.cache()


def rank_errors(values, table, names):
    by = {g: np.sort(x["v"].dropna().to_numpy()) for g, x in values.toPandas().groupby("g")}
    return [abs(np.searchsorted(by[r.g], r[n], "right") / len(by[r.g]) - p) for r in table.collect() for n, p in zip(names, PROBS)]


@pytest.mark.parametrize("k", [200, 2000])
def test_rank_error(values, k):
    names = [f"q{i}" for i in range(len(PROBS))]
    q = A.quantiles_by(values, "g", "v", PROBS, names=names, sketch=k)
    assert max(rank_errors(values, q, names)) <= sketch_rank_error(k) * 1.5


def test_stated_error():
    assert sketch_rank_error(200) == pytest.approx(0.0133, abs=2e-4) and sketch_rank_error(2000) < 0.0015


def test_sketches_merge(values):
    parts = [quantile_sketches(values.where(F.col("g") == g), "v", "g") for g in range(3)]
    whole = merged_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    q = sketch_quantiles(whole, [0.5], names=["m"], count_name="n").first()
    x = np.sort(values.toPandas()["v"].dropna().to_numpy())
    assert q.n == len(x) and abs(np.searchsorted(x, q.m) / len(x) - 0.5) < 2 * sketch_rank_error()


def test_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", float("nan")), (None, 2.0)], "g string, v double")
    got = {r.g: r.q for r in sketch_quantiles(quantile_sketches(df, "v", "g"), [0.5], "g", ["q"]).collect()}
    assert got == {"a": 1.0, "b": None, "c": None, None: 2.0}
    assert sketch_quantiles(quantile_sketches(df.limit(0), "v"), [0.5], names=["q"]).first().q is None
    assert merged_sketches(quantile_sketches(df, "v", "g")).first().n == 2


def test_operators_with_sketches(spark, values):
    p = {r.column: r for r in P.profile_numeric(values, ["v", "g"], sketch=2000).collect()}
    exact = {r.column: r for r in P.profile_numeric(values, ["v", "g"]).collect()}
    x = np.sort(values.toPandas()["v"].dropna().to_numpy())
    assert p["v"].n == exact["v"].n and p["v"].mean == pytest.approx(exact["v"].mean) and p["g"].p50 == exact["g"].p50
    assert abs(np.searchsorted(x, p["v"].p95) / len(x) - 0.95) < 0.004
    assert P.profile_numeric(values.where("v is null"), ["v"], sketch=200).first().p50 is None
    box = P.box_summary(values, "g", "v", sketch=2000).collect()
    assert len(box) == 3 and all(r.q1 < r.median < r.q3 for r in box)
    sizes = [r["count"] for r in V.bin_equal_freq(values.where("v is not null"), "v", 4, sketch=2000).groupBy("bin").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 0.01 * sum(sizes)


def test_rfm_with_sketches(spark, small_dir):
    o = spark.read.parquet(f"{small_dir}/orders.parquet")
    args = (o, "o_custkey", "o_orderdate", "o_totalprice", "2001-08-02")
    a, b = (x.toPandas().set_index("customer").sort_index() for x in (rfm.rfm_orders(*args), rfm.rfm_orders(*args, sketch=4000)))
    # below 4000 customers a sketch keeps all values; its quantiles are values, not points between them
    assert (abs(a[["r_score", "f_score", "m_score"]] - b[["r_score", "f_score", "m_score"]]) <= 1).all().all()
