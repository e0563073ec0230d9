"""Group functions without a size switch: partial results before the shuffle, groups as batches."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import udf as U


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), float(rng.randint(1, 9)), i) for i in range(400)] + [("hot", 1, 2.0, -1)] * 300
    return spark.createDataFrame(data, "k string, j int, v double, i int").repartition(5)


def totals(rows, *by):
    out = {}
    for r in rows.collect():
        key = tuple(r[b] for b in by)
        n, s = out.get(key, (0, 0.0))
        out[key] = (n + 1, s + r.v)
    return out


def arrow_sums(t: pa.Table) -> pa.Table:
    v = t.column("v").to_numpy()
    return pa.table({"j": t.column("j").slice(0, 1), "k": t.column("k").slice(0, 1), "n": pa.array([len(v)]), "s": pa.array([float(v.sum())])})


def pandas_sums(p: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"k": p["k"].iloc[:1], "j": p["j"].iloc[:1].astype("Int32"), "n": [len(p)], "s": [p["v"].sum()]})


@pytest.mark.parametrize("kind,fn", [("arrow", arrow_sums), ("pandas", pandas_sums)])
def test_combine_before_the_shuffle(spark, rows, kind, fn):
    out = U.group_map(rows, ["k", "j"], fn, "k string, j int, n long, s double", kind,
                      combine=lambda p: p.groupBy("k", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    assert {(r.k, r.j): (r.n, r.s) for r in out.collect()} == totals(rows, "k", "j")
    plan = out._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.rindex("MapInArrow"):]
    assert "hashpartitioning" not in before  # raw rows are not dealt by their group


def test_combine_function_per_group(rows):
    def add(t: pa.Table) -> pa.Table:
        return pa.table({"k": t.column("k").slice(0, 1), "n": [sum(t.column("n").to_pylist())], "s": [sum(t.column("s").to_pylist())]})

    def part(t: pa.Table) -> pa.Table:
        return arrow_sums(t).select(["k", "n", "s"])
    out = U.group_map(rows, "k", part, "k string, n long, s double", "arrow", combine=add, combine_schema="k string, n long, s double")
    assert {(r.k,): (r.n, r.s) for r in out.collect()} == totals(rows, "k")


def test_runs_of_a_batch_in_one_call(spark):
    """Twenty thousand groups, one with NULL key: the function is called once per batch, not once per group."""
    rng = random.Random(8)
    data = [(i % 20_000 or None, float(rng.randint(0, 50)), rng.choice([None, rng.uniform(-9, 9)]) if i % 7 == 0 else rng.uniform(-9, 9)) for i in range(60_000)]
    df = spark.createDataFrame(data, "k long, x double, y double").coalesce(1)
    sums = U.ols_moments_runs("x", "y", "k", 25.0)

    def counted(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        out = sums(rows, starts)
        return out.append_column("calls", pa.array([1] + [0] * (len(out) - 1)))

    calls = U.group_map(df, "k", counted, "k long, calls long", "arrow_runs", combine=lambda p: p.agg(F.sum("calls").alias("calls")))
    assert calls.first().calls <= 60_000 // 10_000 + 1
    got = U.group_map(df, "k", sums, "k long, " + U.MOMENT_SCHEMA, "arrow_runs",
                      combine=lambda p: p.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")]))
    want = {}
    for k, x, y in data:
        x, y = x - 25.0, math.nan if y is None else y
        want[k] = [a + b for a, b in zip(want.get(k, [0] * 5), (1, x, y, x * x, x * y))]
    assert {r.k: list(r)[1:] for r in got.collect()} == {k: pytest.approx(v, nan_ok=True) for k, v in want.items()}
    assert U.group_map(df.limit(0), "k", sums, "k long, " + U.MOMENT_SCHEMA, "arrow_runs", combine=lambda p: p).count() == 0
    with pytest.raises(ValueError):
        U.group_map(df, "k", sums, "k long, n long", "arrow_runs")


def test_a_group_in_batches(spark):
    """Ten million rows of one key: the function sees them batch by batch."""
    n = 10_000_000
    df = spark.range(n).select(F.when(F.col("id") % 1000 == 0, "few").otherwise("many").alias("k"), F.col("id").cast("double").alias("v"))

    def count(batches):
        total, rows, most = 0.0, 0, 0
        for b in batches:
            total, rows, most = total + float(b.column("v").to_numpy().sum()), rows + b.num_rows, max(most, b.num_rows)
        yield pa.RecordBatch.from_pydict({"rows": [rows], "total": [total], "most": [most]})

    got = sorted((r.rows, r.total, r.most) for r in U.group_map(df, "k", count, "rows long, total double, most long", "arrow_batches").collect())
    assert [g[0] for g in got] == [n // 1000, n - n // 1000] and sum(g[1] for g in got) == pytest.approx(n * (n - 1) / 2)
    assert max(g[2] for g in got) <= 10_000


def test_pandas_batches(rows):
    def head(frames):
        n = sum(len(f) for f in frames)
        yield pd.DataFrame({"n": [n]})
    got = sorted(r.n for r in U.group_map(rows, "k", head, "n long", "pandas_batches").collect())
    assert got == sorted(n for n, _ in totals(rows, "k").values())


def test_group_reduce_ways_agree(rows):
    want = {k: math.log(1) + s for k, s in ((k, sum(math.log(r.v) for r in rows.collect() if (r.k,) == k)) for k in totals(rows, "k"))}
    ways = [U.group_reduce(rows, "k", "v", U.sum_of_logs, name="s"),
            U.group_reduce(rows, "k", "v", U.sum_of_logs, name="s", combine=U.plain_sum),
            U.group_reduce(rows, "k", "v", lambda series: sum(U.sum_of_logs(s) for s in series), name="s", batches=True)]
    for out in ways:
        assert {(r.k,): r.s for r in out.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    assert all(U.group_reduce(rows.limit(0), "k", "v", U.sum_of_logs, **kw).count() == 0 for kw in ({}, {"combine": U.plain_sum}, {"batches": True}))


def test_batches_left_unread(rows):
    out = U.group_reduce(rows, "k", "v", lambda series: 1.0, name="s", batches=True)
    assert {(r.k, r.s) for r in out.collect()} <= {(k[0], 1.0) for k in totals(rows, "k")}


def test_run_starts():
    b = pa.RecordBatch.from_pydict({"a": [None, None, 1, 1, 2], "b": ["x", "x", "x", None, None], "c": [[1], [1], [1], [1], [2]]})
    assert U.run_starts(b, ["a", "b"]) == [0, 2, 3, 4] and U.run_starts(b, []) == [0] and U.run_starts(b, ["c"]) == [0, 4]
    assert U.run_starts(b.slice(0, 0), ["a"]) == []
    assert np.diff(U.run_starts(b, ["a"])).tolist() == [2, 2]


def test_unknown_kind(rows):
    with pytest.raises(ValueError):
        U.group_map(rows, "k", None, "n long", "polars")
    with pytest.raises(ValueError):
        U.group_map(rows, "k", None, "n long", "arrow_batches", combine=lambda p: p)
