"""Spearman on pairwise complete rows, level positions, profiles of odd names."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import factors as FA
from tessera.operators import profile as P
from tessera.operators.ranking import numbered


def ranks(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def spearman(a, b):
    both = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    if not both:
        return None
    ra, rb = ranks([x for x, _ in both]), ranks([y for _, y in both])
    n, ma, mb = len(both), sum(ra) / len(ra), sum(rb) / len(rb)
    va, vb = sum((x - ma) ** 2 for x in ra), sum((y - mb) ** 2 for y in rb)
    return sum((x - ma) * (y - mb) for x, y in zip(ra, rb)) / (va * vb) ** 0.5 if va * vb > 0 and n > 1 else None


def test_spearman_on_complete_pairs(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (3, 5), (4, 4)], "a int, b int")
    assert P.correlations(df, ["a", "b"], "spearman").first().r == pytest.approx(0.5)


def test_spearman_equals_a_plain_ranking(spark):
    rng = random.Random(4)
    rows = [tuple(None if rng.random() < p else rng.randint(0, 12) for p in (0.0, 0.3, 0.6, 1.0)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, `b.c` int, d int, e int")
    got = {(r.var1, r.var2): r.r for r in P.correlations(df, ["a", "b.c", "d", "e"], "spearman").collect()}
    cols = dict(zip(["a", "b.c", "d", "e"], zip(*rows)))
    assert len(got) == 6
    for (x, y), r in got.items():
        want = spearman(cols[x], cols[y])
        assert r is None if want is None else r == pytest.approx(want)


def test_profile_of_a_dotted_name(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y")], "`a.b` double, c string")
    got = {r.column: (r.n_null, r.n_distinct) for r in P.profile_table(df).collect()}
    assert got == {"a.b": (1, 1), "c": (0, 2)}
    assert P.profile_numeric(df, ["a.b"]).first().p50 == 1.0


def test_once_only_levels_are_spread(spark):
    n = 60_000
    df = spark.range(n).select(F.format_string("Customer#%09d", F.col("id")).alias("c"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges this small would be joined
    try:
        at = numbered(df.groupBy("c").agg(F.count(F.lit(1)).alias("n")), [F.col("n").desc(), F.col("c")], ["n"])
        sizes = [r["count"] for r in at.groupBy(F.floor(F.col("position") / n), F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(sizes) < n / 2  # no task has all levels of one count
    wrong = FA.factor_order(df, "c").where(F.col("position") != F.substring("c", 10, 9).cast("int") + 1)
    assert wrong.count() == 0
    f = P.freq_table(df, "c")
    assert f.where(F.col("position") != F.substring("c", 10, 9).cast("int") + 1).count() == 0
    assert f.agg(F.max("cum_pct")).first()[0] == pytest.approx(100.0)


def test_positions_need_no_window_by_count(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "c string")
    for out in (P.freq_table(df, "c"), FA.factor_order(df, "c")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(n#" not in plan and "windowspecdefinition(__down#" not in plan
    assert [(r.c, r.n, r.position) for r in P.freq_table(df, "c").orderBy("position").collect()] == [("b", 2, 1), ("a", 1, 2), (None, 1, 3)]
    assert P.freq_table(df.limit(0), "c").count() == 0
