"""Hot-group splitting gives the same answers as one window per group."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import hotsplit as H


def _orders(spark, small_dir):
    # every customer has ~10 orders at sf0.001; a threshold of 4 rows splits them
    return spark.read.parquet(f"{small_dir}/orders.parquet").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")


def test_running_matches_plain_window(spark, small_dir):
    o = _orders(spark, small_dir)
    order = ["o_orderdate", "o_orderkey"]
    aggs = {"s": ("sum", F.col("o_totalprice")), "n": ("count", F.col("o_totalprice")),
            "lo": ("min", F.col("o_totalprice")), "hi": ("max", F.col("o_totalprice")),
            "any_f": ("any", F.col("o_orderstatus") == "F"), "all_f": ("all", F.col("o_orderstatus") == "F")}
    got = H.running(o, "o_custkey", order, aggs, hot_rows=4).toPandas().set_index("o_orderkey").sort_index()
    w = Window.partitionBy("o_custkey").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = o.select("o_orderkey", F.sum("o_totalprice").over(w).alias("s"), F.count("o_totalprice").over(w).alias("n"),
                    F.min("o_totalprice").over(w).alias("lo"), F.max("o_totalprice").over(w).alias("hi"),
                    F.bool_or(F.col("o_orderstatus") == "F").over(w).alias("any_f"),
                    F.bool_and(F.col("o_orderstatus") == "F").over(w).alias("all_f")).toPandas() \
        .set_index("o_orderkey").sort_index()
    assert (abs(got["s"] - want["s"]) < 1e-6).all()
    for c in ("n", "lo", "hi", "any_f", "all_f"):
        assert (got[c] == want[c]).all(), c


def test_ranks_match_plain_window(spark, small_dir):
    o = _orders(spark, small_dir).withColumn("yr", F.year("o_orderdate"))
    kinds = ["row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile"]
    for order in (["yr", "o_orderkey"], ["yr"], ["-o_totalprice", "o_orderkey"]):
        got = H.ranks(o, "o_custkey", order, kinds, ntile=3, hot_rows=4).toPandas()
        w = Window.partitionBy("o_custkey").orderBy(*H.order_spec(order))
        want = o.select("*", F.row_number().over(w).alias("row_number"), F.rank().over(w).alias("rank"),
                        F.dense_rank().over(w).alias("dense_rank"), F.percent_rank().over(w).alias("percent_rank"),
                        F.cume_dist().over(w).alias("cume_dist"), F.ntile(3).over(w).alias("ntile")).toPandas()
        if order == ["yr"]:  # row_number and ntile are arbitrary among ties
            kinds_cmp = ["rank", "dense_rank", "percent_rank", "cume_dist"]
        else:
            kinds_cmp = kinds
        m = got.merge(want, on="o_orderkey", suffixes=("_g", "_w"))
        assert len(m) == len(o.toPandas())
        for k in kinds_cmp:
            assert (abs(m[f"{k}_g"] - m[f"{k}_w"]) < 1e-12).all(), (order, k)


def test_fill_forward_matches_plain_window(spark, small_dir):
    e = spark.read.parquet(f"{small_dir}/events.parquet").withColumn(
        "value", F.when(F.col("value") >= 5, F.col("value")))
    order = ["ts", "event_id"]
    for gap in (None, 1):
        got = H.fill_forward(e, "user_id", order, "value", "f", max_gap=gap, hot_rows=3).toPandas()
        w = Window.partitionBy("user_id").orderBy(*order)
        rn = F.row_number().over(w)
        d = e.withColumn("rn", rn).withColumn("kn", F.when(F.col("value").isNotNull(), F.col("rn")))
        up = w.rowsBetween(Window.unboundedPreceding, 0)
        d = d.select("event_id", "rn", F.last("value", True).over(up).alias("lv"), F.last("kn", True).over(up).alias("lk"))
        want = d.select("event_id", (F.col("lv") if gap is None else F.when(F.col("rn") - F.col("lk") <= gap, F.col("lv")))
                        .alias("f")).toPandas()
        m = got.merge(want, on="event_id", suffixes=("_g", "_w"))
        assert len(m) == len(got)
        assert ((m["f_g"].fillna(-1) - m["f_w"].fillna(-1)).abs() < 1e-12).all(), gap


def test_global_window_split(spark, small_dir):
    o = _orders(spark, small_dir)
    got = H.ranks(o, [], ["o_totalprice", "o_orderkey"], ["row_number"], hot_rows=100).toPandas()
    want = o.toPandas().sort_values(["o_totalprice", "o_orderkey"]).reset_index(drop=True)
    want["row_number"] = range(1, len(want) + 1)
    m = got.merge(want[["o_orderkey", "row_number"]], on="o_orderkey")
    assert (m["row_number_x"] == m["row_number_y"]).all()
    assert pd.Series(got["row_number"]).is_unique


def test_time_halo_matches_plain_window(spark, small_dir):
    e = spark.read.parquet(f"{small_dir}/events.parquet").select("event_id", "user_id", "ts", "value")

    def cols(part):
        p = ", ".join(part)
        return [F.expr(f"sum(value) OVER (PARTITION BY {p} ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS "
                       f"PRECEDING AND CURRENT ROW)").alias("s"),
                F.expr(f"count(value) OVER (PARTITION BY {p} ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS "
                       f"PRECEDING AND CURRENT ROW)").alias("n")]

    got = H.with_time_halo(e, "user_id", "ts", 6 * 3600, cols, hot_rows=3).toPandas().set_index("event_id").sort_index()
    want = e.select("*", *cols(["user_id"])).toPandas().set_index("event_id").sort_index()
    assert len(got) == len(want)
    assert ((got["s"] - want["s"]).abs() < 1e-9).all() and (got["n"] == want["n"]).all()


def test_two_level_udfs_match_one_level(spark, small_dir):
    from tessera.operators import udf as U
    o = spark.read.parquet(f"{small_dir}/orders.parquet").select(
        "o_custkey", "o_orderpriority", "o_totalprice",
        F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("day"))
    two = U.group_map(o, "o_custkey", U.ols_moments_arrow("day", "o_totalprice", "o_custkey", 10957.0, 250000.0),
                      "o_custkey long, " + U.MOMENT_SCHEMA, kind="arrow",
                      combine=U.ols_slope_combine_arrow("o_custkey"),
                      combine_schema="o_custkey long, n long, slope double").toPandas()
    one = U.group_map(o, "o_custkey", U.ols_slope_per_group_arrow("day", "o_totalprice", "o_custkey"),
                      "o_custkey long, n long, slope double", kind="arrow").toPandas()
    m = two.merge(one, on="o_custkey", suffixes=("_2", "_1"))
    assert len(m) == len(one) and (m["n_2"] == m["n_1"]).all()
    both = m.dropna(subset=["slope_1", "slope_2"])
    assert len(both) == m["slope_1"].notna().sum()
    assert ((both["slope_2"] - both["slope_1"]).abs() <= 1e-6 * (1 + both["slope_1"].abs())).all()
    r2 = U.group_reduce(o, "o_orderpriority", "o_totalprice", U.sum_of_logs, combine=U.plain_sum).toPandas().set_index("o_orderpriority")
    r1 = U.group_reduce(o, "o_orderpriority", "o_totalprice", U.sum_of_logs).toPandas().set_index("o_orderpriority")
    assert ((r2["value"] - r1["value"]).abs() < 1e-6).all()


def test_halo_windows_match_plain_window(spark, small_dir):
    e = spark.read.parquet(f"{small_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    order = ["ts", "event_id"]
    w = Window.partitionBy("user_id").orderBy(*order)

    def cols(wb):
        return [F.lag("value", 2).over(wb).alias("lag2"), F.lead("value", 1).over(wb).alias("lead1"),
                F.avg("value").over(wb.rowsBetween(-2, 0)).alias("roll3"),
                F.count(F.lit(1)).over(wb.rowsBetween(-1, 1)).alias("n3")]

    got = H.with_halo(e, "user_id", order, 2, 1, cols, hot_rows=3).toPandas().set_index("event_id").sort_index()
    want = e.select("*", *cols(w)).toPandas().set_index("event_id").sort_index()
    assert len(got) == len(want)
    for c in ("lag2", "lead1", "roll3", "n3"):
        assert ((got[c].fillna(-1) - want[c].fillna(-1)).abs() < 1e-9).all(), c


def test_nulls_text_and_descending_orders(spark, small_dir):
    """NULL group keys and order values, text orders, either direction, no group: split equals plain."""
    o = _orders(spark, small_dir).select(
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 4).alias("g"), "o_orderkey",
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("x"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("t"), (F.col("o_orderkey") * 31 % 97).cast("string"))).alias("t"))
    kinds = ["row_number", "rank", "dense_rank", "cume_dist", "ntile"]
    aggs = {"s": ("sum", F.col("o_orderkey")), "n": ("count", F.col("x")), "hi": ("max", F.col("t"))}
    for by in ("g", []):
        for order in (["-x", "o_orderkey"], ["t", "o_orderkey"], ["-t", "-o_orderkey"], ["x", "o_orderkey"]):
            for fn in (lambda hot: H.ranks(o, by, order, kinds, ntile=5, hot_rows=hot),
                       lambda hot: H.running(o, by, order, aggs, hot_rows=hot),
                       lambda hot: H.fill_forward(o, by, order, "x", "f", max_gap=2, hot_rows=hot)):
                plain, split = (fn(h).toPandas().set_index("o_orderkey").sort_index() for h in (None, 50))
                pd.testing.assert_frame_equal(plain[sorted(plain.columns)], split[sorted(plain.columns)], check_dtype=False)


def test_no_job_runs_while_a_window_query_is_built(spark, small_dir):
    from tessera.operators import windows as W
    o = spark.read.parquet(f"{small_dir}/orders.parquet")
    order = ["o_orderdate", "o_orderkey"]
    spark.sparkContext.setJobGroup("building", "no job may be in this group")
    built = [W.rank_family(o, "o_custkey", order), W.lead_lag(o, "o_custkey", order, "o_totalprice"), W.cumulative(o, "o_custkey", order, "o_totalprice"),
             W.rolling_rows(o, "o_custkey", order, "o_totalprice", 3), W.rolling_rows(o, "o_custkey", order, "o_totalprice", 3, "median"),
             W.rolling_time(o, "o_custkey", "o_orderdate", "o_totalprice", "7 DAY"), W.locf_fill(o, "o_custkey", order, "o_totalprice")]
    spark.sparkContext.setJobGroup("other", "")
    assert len(built) == 7 and not spark.sparkContext.statusTracker().getJobIdsForGroup("building")


def test_chains_do_not_multiply_their_plans(spark, small_dir):
    from tessera.operators import windows as W
    o = spark.read.parquet(f"{small_dir}/orders.parquet")
    d = o
    for i in range(4):
        d = W.locf_fill(d, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", name=f"f{i}")
    assert d._jdf.queryExecution().analyzed().collectLeaves().size() < 12
    assert d.where("f0 = f3").count() == o.count()
