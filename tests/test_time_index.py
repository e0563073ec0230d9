"""Range joins on intervals of any length and long regular series."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import windows as W

T0 = dt.datetime(2000, 1, 1)


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(1)
    lengths = [0, 1, 7, 8, 60, 3600, 86_400, 30 * 86_400, 365 * 86_400, 30 * 365 * 86_400]
    iv = [(i, rng.choice("ab"), T0 + dt.timedelta(seconds=rng.randint(0, 10 ** 9)), rng.choice(lengths)) for i in range(150)]
    iv = [(i, k, lo, lo + dt.timedelta(seconds=n, microseconds=rng.choice([0, 500_000]))) for i, k, lo, n in iv]
    iv += [(900, "a", T0, None), (901, "a", None, T0), (902, None, T0, T0 + dt.timedelta(days=9999)), (903, "a", T0 + dt.timedelta(days=1), T0)]
    pts = [(i, rng.choice("ab"), T0 + dt.timedelta(seconds=rng.randint(0, 10 ** 9), microseconds=rng.choice([0, 250_000]))) for i in range(300)]
    pts += [(1000 + i, k, lo) for i, k, lo, _ in iv[:60]] + [(2000 + i, k, hi) for i, k, _, hi in iv[:60]] + [(3000, "a", None), (3001, None, T0)]
    points = spark.createDataFrame(pts, "p long, k string, at timestamp_ntz")
    intervals = spark.createDataFrame(iv, "i long, k string, lo timestamp_ntz, hi timestamp_ntz")
    for closed in ("left", "both"):
        got = sorted((r.p, r.i) for r in J.join_range(points, intervals, "at", "lo", "hi", ["k"], closed=closed).collect())
        want = sorted((p, i) for p, k, t in pts for i, q, lo, hi in iv if None not in (t, lo, hi, k) and k == q
                      and lo <= t and (t < hi or closed == "both" and t == hi))
        assert got == want


def test_range_join_of_mixed_lengths_makes_short_arrays(spark):
    """A 30-year interval beside 10^6 of one second."""
    start = F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")
    short = spark.range(1_000_000).select("id", (start + F.make_dt_interval(secs=F.col("id") * 900)).alias("lo"))
    short = short.withColumn("hi", F.col("lo") + F.expr("INTERVAL 1 SECOND"))
    long = spark.range(1).select((F.col("id") - 1).alias("id"), start.alias("lo"), (start + F.expr("INTERVAL 30 YEAR")).alias("hi"))
    points = spark.range(1000).select(F.col("id").alias("p"), (start + F.make_dt_interval(secs=F.col("id") * 900_000)).alias("at"))
    got = J.join_range(points, short.unionByName(long), "at", "lo", "hi")
    n = got.groupBy((F.col("id") == -1).alias("long")).count().collect()
    assert {r.long: r["count"] for r in n} == {True: 1000, False: 1000}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan.split("Join Inner")[0]


def test_range_join_without_intervals(spark):
    points = spark.createDataFrame([(1, T0)], "p long, at timestamp_ntz")
    none = spark.createDataFrame([], "i long, lo timestamp_ntz, hi timestamp_ntz")
    assert J.join_range(points, none, "at", "lo", "hi").count() == 0
    assert J.join_range(points.limit(0), none, "at", "lo", "hi").count() == 0


def test_long_series_in_stretches(spark):
    rows = [("a", T0, 1.0), ("a", T0 + dt.timedelta(seconds=3_000_000), 2.0), ("b", T0, 5.0), (None, T0, 1.0),
            (None, T0 + dt.timedelta(seconds=4), 1.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")
    out = W.time_bucket_agg(df, "k", "t", "second", {"n": F.count(F.lit(1)), "s": F.sum("v")}, fill={"n": 0, "s": 0.0})
    got = {r.k: (r.rows, r.n, r.s, r.lo, r.hi) for r in out.groupBy("k").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).collect()}
    assert got == {"a": (3_000_001, 2, 3.0, T0, T0 + dt.timedelta(seconds=3_000_000)), "b": (1, 1, 5.0, T0, T0),
                   None: (5, 2, 2.0, T0, T0 + dt.timedelta(seconds=4))}
    assert out.columns == ["k", "bucket", "n", "s"]


def test_stretch_length_changes_nothing(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice("xy"), T0 + dt.timedelta(hours=rng.randint(-4000, 4000))) for _ in range(40)], "k string, t timestamp_ntz")
    for unit, width in (("hour", 5), ("week", 1), ("month", 2), ("year", 1)):
        one, many = (sorted((r.k, r.bucket, r.n or 0) for r in W.time_bucket_agg(df, "k", "t", unit, {"n": F.count(F.lit(1))}, width=width, chunk=c).collect())
                     for c in (10 ** 6, 3))
        assert one == many and len(one) == len({x[:2] for x in one})
