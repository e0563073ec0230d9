"""Window and reshape queries (inventory sections 2.6 and 2.9)."""

from pyspark.sql import functions as F

from tessera.operators import reshape as R
from tessera.operators import windows as W
from tessera.plans.registry import register
from tessera.plans.verbs import EVENTS_GAPPY_SQL, events_gappy

_ORD_W = "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey"


@register("rank_family", sql=f"""
SELECT o_custkey, o_orderkey, o_totalprice,
  CAST(row_number() OVER ({_ORD_W}) AS INTEGER) AS row_number,
  CAST(rank() OVER ({_ORD_W}) AS INTEGER) AS rank,
  CAST(dense_rank() OVER ({_ORD_W}) AS INTEGER) AS dense_rank,
  round(percent_rank() OVER ({_ORD_W}), 6) AS percent_rank,
  round(cume_dist() OVER ({_ORD_W}), 6) AS cume_dist,
  CAST(ntile(3) OVER ({_ORD_W}) AS INTEGER) AS ntile
FROM orders""")
def q_rank_family(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    r = W.rank_family(o, "o_custkey", ["-o_totalprice", "o_orderkey"], ntile=3)
    return r.withColumns({"percent_rank": F.round("percent_rank", 6), "cume_dist": F.round("cume_dist", 6)})


_DATE_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@register("lead_lag", sql=f"""
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
  lag(o_totalprice) OVER ({_DATE_W}) AS o_totalprice_lag,
  lead(o_totalprice) OVER ({_DATE_W}) AS o_totalprice_lead,
  round(o_totalprice - lag(o_totalprice) OVER ({_DATE_W}), 2) AS o_totalprice_diff,
  round((o_totalprice - lag(o_totalprice) OVER ({_DATE_W})) / lag(o_totalprice) OVER ({_DATE_W}), 6) AS o_totalprice_growth
FROM orders""")
def q_lead_lag(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    r = W.lead_lag(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return r.withColumns({"o_totalprice_diff": F.round("o_totalprice_diff", 2),
                          "o_totalprice_growth": F.round("o_totalprice_growth", 6)})


_CUM = f"({_DATE_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@register("cumulative", sql=f"""
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus,
  round(sum(o_totalprice) OVER {_CUM}, 2) AS cum_sum, round(avg(o_totalprice) OVER {_CUM}, 6) AS cum_mean,
  min(o_totalprice) OVER {_CUM} AS cum_min, max(o_totalprice) OVER {_CUM} AS cum_max,
  bool_or(o_totalprice > 300000) OVER {_CUM} AS cum_any, bool_and(o_orderstatus = 'F') OVER {_CUM} AS cum_all
FROM orders""")
def q_cumulative(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    r = W.cumulative(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice",
                     any_flag=F.col("o_totalprice") > 300000, all_flag=F.col("o_orderstatus") == "F")
    return r.withColumns({"cum_sum": F.round("cum_sum", 2), "cum_mean": F.round("cum_mean", 6)})


_EV_W = "PARTITION BY user_id ORDER BY ts, event_id"


@register("rolling_rows", sql=f"""
SELECT event_id, user_id, ts, value,
  CASE WHEN count(*) OVER ({_EV_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
       THEN round(avg(value) OVER ({_EV_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) END AS value_roll_mean
FROM events""")
def q_rolling_rows(t):
    e = t.events.select("event_id", "user_id", "ts", "value")
    r = W.rolling_rows(e, "user_id", ["ts", "event_id"], "value", 3, "mean")
    return r.withColumn("value_roll_mean", F.round("value_roll_mean", 6))


@register("rolling_rows_center", sql=f"""
SELECT event_id, user_id, ts, value,
  CASE WHEN count(*) OVER ({_EV_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5
       THEN median(value) OVER ({_EV_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS value_roll_median
FROM events""")
def q_rolling_rows_center(t):
    e = t.events.select("event_id", "user_id", "ts", "value")
    return W.rolling_rows(e, "user_id", ["ts", "event_id"], "value", 5, "median", align="center")


_TYPE_W = "PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND CURRENT ROW"


@register("rolling_rows_median_wide", sql=f"""
SELECT event_id, event_type, ts, value,
  CASE WHEN count(*) OVER ({_TYPE_W}) = 101 THEN median(value) OVER ({_TYPE_W}) END AS value_roll_median
FROM events""")
def q_rolling_rows_median_wide(t):
    """The median of the last 101 events of a type."""
    e = t.events.select("event_id", "event_type", "ts", "value")
    return W.rolling_rows(e, "event_type", ["ts", "event_id"], "value", 101, "median")


@register("rolling_time", sql="""
SELECT event_id, user_id, ts, value,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 6) AS win_sum,
  count(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS win_count
FROM events""")
def q_rolling_time(t):
    e = t.events.select("event_id", "user_id", "ts", "value")
    r = W.rolling_time(e, "user_id", "ts", "value", "1 HOUR", ["sum", "count"])
    return r.withColumn("win_sum", F.round("win_sum", 6))


@register("locf_fill", sql=f"""
WITH g AS (SELECT event_id, user_id, ts, value, row_number() OVER ({_EV_W}) AS rn FROM {EVENTS_GAPPY_SQL} x)
SELECT event_id, user_id, ts, value,
  last_value(value IGNORE NULLS) OVER ({_EV_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value_filled,
  CASE WHEN rn - last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS)
                 OVER ({_EV_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 1
       THEN last_value(value IGNORE NULLS) OVER ({_EV_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END
    AS value_filled_gap1,
  first_value(value IGNORE NULLS) OVER ({_EV_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value_next
FROM g""")
def q_locf_fill(t):
    g = events_gappy(t).select("event_id", "user_id", "ts", "value")
    order = ["ts", "event_id"]
    g = W.locf_fill(g, "user_id", order, "value")
    g = W.locf_fill(g, "user_id", order, "value", max_gap=1, name="value_filled_gap1")
    return W.locf_fill(g, "user_id", order, "value", direction="backward", name="value_next")


@register("interpolate_linear", sql=f"""
WITH g AS (SELECT event_id, user_id, ts, value, CAST(epoch_us(ts) AS DOUBLE) AS t,
                  CASE WHEN value IS NOT NULL THEN CAST(epoch_us(ts) AS DOUBLE) END AS kt
           FROM {EVENTS_GAPPY_SQL} x),
h AS (SELECT *,
  last_value(value IGNORE NULLS) OVER ({_EV_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
  last_value(kt IGNORE NULLS) OVER ({_EV_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
  first_value(value IGNORE NULLS) OVER ({_EV_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
  first_value(kt IGNORE NULLS) OVER ({_EV_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1
  FROM g)
SELECT event_id, user_id, ts, value,
  round(CASE WHEN value IS NOT NULL THEN value WHEN t1 = t0 THEN v0
             ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS value_interp
FROM h""")
def q_interpolate_linear(t):
    g = events_gappy(t).select("event_id", "user_id", "ts", "value")
    r = W.interpolate_linear(g, "user_id", "ts", "value", order_tiebreak="event_id")
    return r.withColumn("value_interp", F.round("value_interp", 6))


@register("time_bucket_agg", sql="""
WITH g AS (SELECT event_type, date_trunc('hour', ts) AS bucket, count(*) AS n, round(sum(value), 6) AS total
           FROM events GROUP BY ALL),
b AS (SELECT event_type, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket
      FROM g GROUP BY event_type)
SELECT b.event_type, b.bucket, coalesce(g.n, 0) AS n, coalesce(g.total, 0.0) AS total
FROM b LEFT JOIN g USING (event_type, bucket)""")
def q_time_bucket_agg(t):
    r = W.time_bucket_agg(t.events, "event_type", "ts", "hour",
                          {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 6)},
                          fill={"n": 0, "total": 0.0})
    return r


# ------------------------------------------------------------------ 2.9
@register("pivot_longer", sql="""
UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part)
ON p_size, p_retailprice INTO NAME name VALUE value""")
def q_pivot_longer(t):
    return R.pivot_longer(t.part, "p_partkey", ["p_size", "p_retailprice"], value_type="double")


@register("pivot_wider", sql="""
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS n_F, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_O,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS n_P,
  round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS total_F,
  round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS total_O,
  round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS total_P
FROM orders GROUP BY 1""")
def q_pivot_wider(t):
    o = t.orders.withColumn("yr", F.year("o_orderdate"))
    return R.pivot_wider(o, "yr", "o_orderstatus", ["F", "O", "P"],
                         {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)},
                         fill={"n_F": 0, "n_O": 0, "n_P": 0})


@register("nest_unnest", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def q_nest_unnest(t):
    n = R.nest(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "lines")
    return R.unnest(n, "lines")
