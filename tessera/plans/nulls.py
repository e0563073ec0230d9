"""Grouped operators on a group key that is NULL for a seventh of the rows:
NULL is a group like any other. The oracles group by the same expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import mathx as M
from tessera.operators import aggregate as A
from tessera.operators import hotsplit as H
from tessera.operators import joins as J
from tessera.operators import profile as P
from tessera.operators import survival as S
from tessera.operators import verbs as V
from tessera.operators import windows as W
from tessera.plans.registry import register

_O = """(SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)"""


def _orders(t):
    return (t.orders.withColumn("p", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
            .withColumn("s", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus"))))


@register("quantiles_by_null_group", sql=f"""
SELECT p, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.9), 6) AS q90
FROM {_O} GROUP BY p""")
def q_quantiles(t):
    r = A.quantiles_by(_orders(t), "p", "o_totalprice", [0.25, 0.9])
    return r.withColumns({c: F.round(c, 6) for c in ("q25", "q90")})


@register("box_summary_null_group", sql=f"""
WITH o AS {_O},
q AS (SELECT p, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
             quantile_cont(o_totalprice, 0.75) AS q3 FROM o GROUP BY p)
SELECT q.p, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
       min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
       max(o_totalprice) FILTER (o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS n_out
FROM o JOIN q ON o.p IS NOT DISTINCT FROM q.p GROUP BY q.p, q1, median, q3""")
def q_box(t):
    r = P.box_summary(_orders(t), "p", "o_totalprice")
    return r.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@register("crosstab_null_level", sql=f"""
WITH g AS (SELECT p, s, count(*) AS n FROM {_O} GROUP BY ALL)
SELECT p, s, n, round(n / sum(n) OVER (PARTITION BY p), 6) AS row_share,
       round(n / sum(n) OVER (PARTITION BY s), 6) AS col_share, round(n / sum(n) OVER (), 6) AS share FROM g""")
def q_crosstab(t):
    r = A.crosstab(_orders(t), "p", "s")
    return r.withColumns({c: F.round(c, 6) for c in ("row_share", "col_share", "share")})


@register("bin_equal_freq_null_group", sql=f"""
WITH o AS {_O},
c AS (SELECT p, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
             quantile_cont(o_totalprice, 0.75) AS c FROM o GROUP BY p)
SELECT o_orderkey, 1 + CAST(o_totalprice > a AS INTEGER) + CAST(o_totalprice > b AS INTEGER)
       + CAST(o_totalprice > c AS INTEGER) AS bin
FROM o JOIN c ON o.p IS NOT DISTINCT FROM c.p""")
def q_bins(t):
    return V.bin_equal_freq(_orders(t), "o_totalprice", 4, by="p").select("o_orderkey", "bin")


@register("time_bucket_agg_null_group", sql=f"""
WITH o AS {_O},
g AS (SELECT p, date_trunc('quarter', o_orderdate) AS b, count(*) AS n FROM o GROUP BY ALL),
s AS (SELECT p, unnest(generate_series(min(b), max(b), INTERVAL 3 MONTH)) AS b FROM g GROUP BY p)
SELECT s.p, CAST(s.b AS TIMESTAMP) AS bucket, coalesce(g.n, 0) AS n
FROM s LEFT JOIN g ON s.p IS NOT DISTINCT FROM g.p AND s.b = g.b""")
def q_buckets(t):
    o = _orders(t).withColumn("ts", F.col("o_orderdate").cast("timestamp_ntz"))
    return W.time_bucket_agg(o, "p", "ts", "quarter", {"n": F.count(F.lit(1))}, fill={"n": 0})


@register("time_bucket_agg_width", sql="""
WITH g AS (SELECT event_type, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS b, count(*) AS n
           FROM events GROUP BY ALL),
s AS (SELECT event_type, unnest(generate_series(min(b), max(b), INTERVAL 2 HOUR)) AS b FROM g GROUP BY event_type)
SELECT s.event_type, s.b AS bucket, coalesce(g.n, 0) AS n
FROM s LEFT JOIN g ON s.event_type = g.event_type AND s.b = g.b""")
def q_bucket_width(t):
    return W.time_bucket_agg(t.events, "event_type", "ts", "hour", {"n": F.count(F.lit(1))}, fill={"n": 0}, width=2)


@register("km_curve_null_group", sql=f"""
WITH o AS (SELECT s, o_orderkey % 50 AS d, CAST(o_custkey % 3 > 0 AS INTEGER) AS e FROM {_O}),
g AS (SELECT s, d, sum(e) AS n_event, count(*) AS k FROM o GROUP BY ALL),
r AS (SELECT *, sum(k) OVER (PARTITION BY s ORDER BY d DESC) AS n_risk FROM g)
SELECT s, d AS time, CAST(n_risk AS BIGINT) AS n_risk, CAST(n_event AS BIGINT) AS n_event,
       CAST(k - n_event AS BIGINT) AS n_censor,
       round(CASE WHEN min(n_risk - n_event) OVER w = 0 THEN 0.0
                  ELSE exp(sum(CASE WHEN n_event < n_risk THEN ln(1 - n_event / n_risk) ELSE 0 END) OVER w) END, 6) AS survival
FROM r WINDOW w AS (PARTITION BY s ORDER BY d)""")
def q_km(t):
    o = _orders(t).select("s", (F.col("o_orderkey") % 50).alias("d"), (F.col("o_custkey") % 3 > 0).cast("int").alias("e"))
    return S.km_curve(o, "d", "e", "s").withColumn("survival", F.round("survival", 6))


@register("scale_by_group_null_group", sql=f"""
SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w, 6) AS o_totalprice_z,
       round((o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w), 6)
         AS o_totalprice_minmax
FROM {_O} WINDOW w AS (PARTITION BY p)""")
def q_scale(t):
    r = M.scale_by_group(_orders(t), "o_totalprice", "p")
    return r.select("o_orderkey", F.round("o_totalprice_z", 6).alias("o_totalprice_z"),
                    F.round("o_totalprice_minmax", 6).alias("o_totalprice_minmax"))


@register("weighted_stats_null_group", sql=f"""
WITH o AS (SELECT p, o_totalprice AS x, o_custkey % 5 + 1 AS w FROM {_O}),
m AS (SELECT p, sum(x * w) / sum(w) AS wmean, sum(w) AS wsum FROM o GROUP BY p),
v AS (SELECT o.p, sum(w * (x - wmean) ^ 2) / any_value(wsum) AS wvar FROM o JOIN m ON o.p IS NOT DISTINCT FROM m.p GROUP BY o.p),
c AS (SELECT o.p, x, sum(w) OVER (PARTITION BY o.p ORDER BY x) AS upto, wsum FROM o JOIN m ON o.p IS NOT DISTINCT FROM m.p)
SELECT m.p, round(wmean, 6) AS wmean, CAST(wsum AS BIGINT) AS wsum, round(wvar, 2) AS wvar,
       (SELECT min(x) FROM c WHERE c.p IS NOT DISTINCT FROM m.p AND upto >= 0.5 * wsum) AS wq50
FROM m JOIN v ON m.p IS NOT DISTINCT FROM v.p""")
def q_weighted(t):
    o = _orders(t).select("p", F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 5 + 1).alias("w"))
    r = A.weighted_stats(o, "p", "x", "w")
    return r.select("p", F.round("wmean", 6).alias("wmean"), "wsum", F.round("wvar", 2).alias("wvar"), "wq50")


@register("mode_median_null_group", sql=f"""
WITH o AS {_O}, c AS (SELECT p, s, count(*) AS k FROM o WHERE s IS NOT NULL GROUP BY ALL)
SELECT o.p, round(median(o_custkey), 6) AS median,
       (SELECT arg_min(s, (-k, s)) FROM c WHERE c.p IS NOT DISTINCT FROM o.p) AS mode_status
FROM o GROUP BY o.p""")
def q_mode(t):
    o = _orders(t)
    mode = A.mode_median(o.withColumn("code", F.ascii("s")), "p", "code").select("p", F.chr("mode").alias("mode_status"))
    return J.join_by(A.mode_median(o, "p", "o_custkey").select("p", F.round("median", 6).alias("median")), mode, "p")


@register("outlier_fence_null_group", sql=f"""
WITH o AS {_O},
q AS (SELECT p, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM o GROUP BY p)
SELECT o_orderkey, round(a - 0.5 * (b - a), 6) AS lower, round(b + 0.5 * (b - a), 6) AS upper,
       (o_totalprice < a - 0.5 * (b - a)) OR (o_totalprice > b + 0.5 * (b - a)) AS is_outlier
FROM o JOIN q ON o.p IS NOT DISTINCT FROM q.p""")
def q_fence(t):
    r = P.outlier_fence(_orders(t), "p", "o_totalprice", k=0.5)
    return r.select("o_orderkey", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "is_outlier")


@register("rank_family_hot_groups", sql=f"""
SELECT o_orderkey, row_number() OVER w AS row_number, rank() OVER v AS rank, dense_rank() OVER v AS dense_rank
FROM {_O} WINDOW w AS (PARTITION BY p ORDER BY s DESC NULLS LAST, o_orderkey ASC NULLS FIRST),
                 v AS (PARTITION BY p ORDER BY s DESC NULLS LAST)""")
def q_hot_ranks(t):
    """Ranks with every group split: a text order column with NULLs, descending, and a NULL group."""
    o = _orders(t).select("o_orderkey", "p", "s")
    rn = H.ranks(o, "p", ["-s", "o_orderkey"], "row_number", hot_rows=100)
    rk = H.ranks(rn, "p", "-s", ["rank", "dense_rank"], hot_rows=100)
    return rk.select("o_orderkey", *[F.col(c).cast("bigint").alias(c) for c in ("row_number", "rank", "dense_rank")])
