"""Queries for projection, filtering, recoding, joins, aggregation, sorting and
set operations (inventory sections 2.2, 2.3, 2.4, 2.7, 2.8)."""

from pyspark.sql import functions as F

from tessera.operators import aggregate as A
from tessera.operators import ranking as R
from tessera.operators import joins as J
from tessera.operators import verbs as V
from tessera.plans.registry import register

# ------------------------------------------------------------------ 2.2
@register("select_rename", sql="SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer")
def q_select_rename(t):
    return V.select_rename(t.customer, ["c_custkey", "c_name", "c_acctbal"],
                           {"c_custkey": "id", "c_name": "name"})


@register("mutate", sql="""
SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax,
       round(l_extendedprice * (1 - l_discount), 6) AS disc_price,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge
FROM lineitem""")
def q_mutate(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return V.mutate(li, {
        "disc_price": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6),
        "charge": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6),
    })


@register("mutate_across", sql="""
SELECT l_orderkey, l_linenumber,
       round(sqrt(l_quantity), 6) AS l_quantity_sqrt, round(sqrt(l_extendedprice), 6) AS l_extendedprice_sqrt,
       round(sqrt(l_discount), 6) AS l_discount_sqrt, round(sqrt(l_tax), 6) AS l_tax_sqrt
FROM lineitem""")
def q_mutate_across(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = V.mutate_across(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                          lambda c: F.round(F.sqrt(c), 6), names="{col}_sqrt")
    return out.drop("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("filter_rows", sql="""
SELECT * FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderdate >= TIMESTAMP '1998-01-01'""")
def q_filter_rows(t):
    return V.filter_rows(t.orders, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000,
                         "o_orderdate >= TIMESTAMP_NTZ'1998-01-01 00:00:00'")


@register("distinct_rows", sql="SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def q_distinct_rows(t):
    return V.distinct_rows(t.orders.select("o_orderstatus", "o_orderpriority"))


@register("distinct_rows_first", sql="""
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def q_distinct_rows_first(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return V.distinct_rows(o, keys=["o_custkey"], order=["-o_orderdate", "-o_orderkey"])


@register("case_recode", sql="""
SELECT o_orderkey, o_totalprice,
  CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'medium'
       WHEN o_totalprice < 300000 THEN 'large' ELSE 'huge' END AS size_class
FROM orders""")
def q_case_recode(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    p = F.col("o_totalprice")
    return V.case_recode(o, "o_totalprice", [(p < 50000, "small"), (p < 150000, "medium"),
                                             (p < 300000, "large")], default="huge", name="size_class")


def events_gappy(t):
    """`events` with `value` set NULL where value < 5 (the gap fixture)."""
    return t.events.withColumn("value", F.when(F.col("value") >= 5, F.col("value")))


EVENTS_GAPPY_SQL = ("(SELECT event_id, ts, user_id, event_type, "
                    "CASE WHEN value >= 5 THEN value END AS value, props FROM events)")


@register("null_handling", sql=f"""
SELECT event_id, user_id, nullif(event_type, 'error') AS event_type, value,
       coalesce(value, 0.0) AS value_filled
FROM {EVENTS_GAPPY_SQL} g
WHERE nullif(event_type, 'error') IS NOT NULL""")
def q_null_handling(t):
    g = events_gappy(t).select("event_id", "user_id", "event_type", "value")
    return V.null_handling(g, sentinel={"event_type": "error"}, coalesce={"value_filled": ["value", F.lit(0.0)]},
                           drop=["event_type"])


@register("split_unite", sql="""
SELECT p_partkey, nullif(split_part(p_name, ' ', 1), '') AS name_1, nullif(split_part(p_name, ' ', 2), '') AS name_2,
       nullif(split_part(p_name, ' ', 3), '') AS name_3, concat_ws('/', p_brand, p_type) AS brand_type
FROM part""")
def q_split_unite(t):
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    s = V.split_column(p, "p_name", ["name_1", "name_2", "name_3"], " ")
    u = V.unite_columns(s, ["p_brand", "p_type"], "brand_type", "/")
    return u.select("p_partkey", "name_1", "name_2", "name_3", "brand_type")


BREAKS = [-1000, 0, 2500, 5000, 7500, 10000]


@register("bin_fixed", sql="""
SELECT c_custkey, c_acctbal, CASE
  WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 1 WHEN c_acctbal > 0 AND c_acctbal <= 2500 THEN 2
  WHEN c_acctbal > 2500 AND c_acctbal <= 5000 THEN 3 WHEN c_acctbal > 5000 AND c_acctbal <= 7500 THEN 4
  WHEN c_acctbal > 7500 AND c_acctbal <= 10000 THEN 5 END AS bin
FROM customer""")
def q_bin_fixed(t):
    return V.bin_fixed(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", BREAKS)


@register("bin_equal_freq", sql="""
WITH c AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)
SELECT o_orderkey, o_totalprice,
  CAST(1 + CAST(q[1] < o_totalprice AS INT) + CAST(q[2] < o_totalprice AS INT)
         + CAST(q[3] < o_totalprice AS INT) AS INTEGER) AS bin
FROM orders, c""")
def q_bin_equal_freq(t):
    return V.bin_equal_freq(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 4)


# ------------------------------------------------------------------ 2.3
def _join_sides(t):
    left = t.customer.select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    right = t.orders.select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"),
        F.col("o_totalprice").alias("value"))
    return left, right


_JOIN_L = "(SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS value FROM customer)"
_JOIN_R = ("(SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS value "
           "FROM orders)")


def _join_sql(how, key):
    return (f"SELECT {key} AS custkey, l.name, l.value AS value_x, r.orderkey, r.value AS value_y "
            f"FROM {_JOIN_L} l {how} JOIN {_JOIN_R} r ON l.custkey = r.custkey")


for _how, _key in (("inner", "l.custkey"), ("left", "l.custkey"), ("right", "r.custkey"),
                   ("full", "coalesce(l.custkey, r.custkey)")):
    def _mk(how):
        def q(t):
            left, right = _join_sides(t)
            return J.join_mutating(left, right, "custkey", how)
        q.__doc__ = f"{how} join of customers with their orders"
        return q
    register(f"join_mutating_{_how}", sql=_join_sql(_how.upper(), _key))(_mk(_how))

# the inventory key itself: the left join, which keeps unmatched customers
register("join_mutating", sql=_join_sql("LEFT", "l.custkey"))(_mk("left"))


@register("join_filtering_semi", sql="""
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def q_join_semi(t):
    return J.join_filtering(t.customer.select("c_custkey", "c_name"),
                            t.orders, [("c_custkey", "o_custkey")], "semi")


@register("join_filtering", sql="""
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def q_join_filtering(t):
    """Semi and anti join stacked: each customer exactly once, in one of the two."""
    c = t.customer.select("c_custkey", "c_name")
    big = t.orders
    on = [("c_custkey", "o_custkey")]
    return J.join_filtering(c, big, on, "anti").unionByName(J.join_filtering(c, big, on, "semi"))


@register("join_filtering_anti", sql="""
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def q_join_anti(t):
    return J.join_filtering(t.customer.select("c_custkey", "c_name"),
                            t.orders, [("c_custkey", "o_custkey")], "anti")


@register("join_nested", sql="""
SELECT n_nationkey, n_name, count(s_suppkey) AS n_suppliers,
       round(coalesce(sum(s_acctbal), 0.0), 2) AS acctbal_total
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey
GROUP BY n_nationkey, n_name""")
def q_join_nested(t):
    n = J.join_nested(t.nation.select("n_nationkey", "n_name"),
                      t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal"),
                      [("n_nationkey", "s_nationkey")], name="suppliers")
    tot = F.aggregate("suppliers", F.lit(0.0), lambda a, x: a + x["s_acctbal"])
    return n.groupBy("n_nationkey", "n_name").agg(
        F.sum(F.size("suppliers")).cast("bigint").alias("n_suppliers"),
        F.round(F.sum(tot), 2).alias("acctbal_total"))


@register("expand_complete", sql="""
WITH c AS (SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n
           FROM orders GROUP BY ALL),
s AS (SELECT * FROM (SELECT DISTINCT o_orderstatus FROM c), (SELECT DISTINCT o_orderpriority FROM c),
                    (SELECT DISTINCT yr FROM c))
SELECT s.o_orderstatus, s.o_orderpriority, s.yr, coalesce(c.n, 0) AS n
FROM s LEFT JOIN c USING (o_orderstatus, o_orderpriority, yr)""")
def q_expand_complete(t):
    c = t.orders.groupBy("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"))
    return J.expand_complete(c, ["o_orderstatus", "o_orderpriority", "yr"], fill={"n": 0})


# ------------------------------------------------------------------ 2.4
@register("summarise_by", sql="""
SELECT l_returnflag, l_linestatus,
  round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_summarise_by(t):
    return A.summarise_by(t.lineitem, ["l_returnflag", "l_linestatus"], {
        "sum_qty": F.round(F.sum("l_quantity"), 2),
        "sum_base_price": F.round(F.sum("l_extendedprice"), 2),
        "sum_disc_price": F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2),
        "avg_qty": F.round(F.avg("l_quantity"), 6),
        "avg_price": F.round(F.avg("l_extendedprice"), 6),
        "avg_disc": F.round(F.avg("l_discount"), 6),
        "count_order": F.count(F.lit(1)),
    })


@register("summarise_across", sql="""
SELECT l_returnflag,
  round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean,
  min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
  round(sum(l_discount), 2) AS l_discount_sum, round(avg(l_discount), 6) AS l_discount_mean,
  min(l_discount) AS l_discount_min, max(l_discount) AS l_discount_max
FROM lineitem GROUP BY l_returnflag""")
def q_summarise_across(t):
    s = A.summarise_across(t.lineitem, "l_returnflag", ["l_quantity", "l_discount"], ["sum", "mean", "min", "max"])
    rnd = {c: F.round(c, 2 if c.endswith("_sum") else 6) for c in s.columns if c.endswith(("_sum", "_mean"))}
    return s.withColumns(rnd)


@register("count_by", sql="""
SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM orders GROUP BY o_orderpriority""")
def q_count_by(t):
    return A.count_by(t.orders, "o_orderpriority").withColumn("share", F.round("share", 6))


@register("distinct_count", sql="""
SELECT l_returnflag, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY l_returnflag""")
def q_distinct_count(t):
    return A.distinct_count(t.lineitem, "l_returnflag", "l_partkey")


@register("distinct_count_approx", sql="""
SELECT l_returnflag, count(DISTINCT l_partkey) AS n_exact, true AS within_15_percent FROM lineitem GROUP BY l_returnflag""")
def q_distinct_count_approx(t):
    """HyperLogLog++ distinct parts per return flag, beside the exact count."""
    approx = A.distinct_count(t.lineitem, "l_returnflag", "l_partkey", approx=True)
    exact = A.distinct_count(t.lineitem, "l_returnflag", "l_partkey").withColumnRenamed("n_distinct", "n_exact")
    return approx.join(exact, "l_returnflag").select(
        "l_returnflag", "n_exact", (F.abs(F.col("n_distinct") - F.col("n_exact")) <= 0.15 * F.col("n_exact")).alias("within_15_percent"))


@register("quantiles_by", sql="""
SELECT o_orderpriority,
  round(quantile_cont(o_totalprice, 0.1), 6) AS q10, round(quantile_cont(o_totalprice, 0.25), 6) AS q25,
  round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.75), 6) AS q75,
  round(quantile_cont(o_totalprice, 0.9), 6) AS q90
FROM orders GROUP BY o_orderpriority""")
def q_quantiles_by(t):
    q = A.quantiles_by(t.orders, "o_orderpriority", "o_totalprice", [0.1, 0.25, 0.5, 0.75, 0.9])
    return q.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("q10", "q25", "q50", "q75", "q90")])


@register("quantiles_by_sketch", sql="""
SELECT o_orderpriority, count(*) AS n, true AS ranks_within_half_percent FROM orders GROUP BY o_orderpriority""")
def q_quantiles_by_sketch(t):
    """Quantiles of KLL sketches merged from two halves of the orders: are their ranks within 0.5 % of what was asked?"""
    probs, names = [0.1, 0.25, 0.5, 0.75, 0.9], [f"q{i}" for i in range(5)]
    halves = [R.quantile_sketches(t.orders.where(F.col("o_orderkey") % 2 == h), "o_totalprice", "o_orderpriority") for h in (0, 1)]
    q = R.sketch_quantiles(R.merged_sketches(halves[0].unionByName(halves[1]), "o_orderpriority"), probs, "o_orderpriority", names)
    n = F.count(F.lit(1))
    near = [(F.count_if(F.col("o_totalprice") <= F.col(f"q{i}")) >= n * (p - 0.005) - 1)
            & (F.count_if(F.col("o_totalprice") < F.col(f"q{i}")) <= n * (p + 0.005) + 1) for i, p in enumerate(probs)]
    return t.orders.join(q, "o_orderpriority").groupBy("o_orderpriority").agg(
        n.alias("n"), (near[0] & near[1] & near[2] & near[3] & near[4]).alias("ranks_within_half_percent"))


@register("quantiles_by_approx", sql="""
SELECT o_orderpriority, count(*) AS n, true AS ranks_within_1_percent FROM orders GROUP BY o_orderpriority""")
def q_quantiles_by_approx(t):
    """percentile_approx quantiles per priority (asked for explicitly): are their ranks within 1 % of what was asked?"""
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    q = A.quantiles_by(t.orders, "o_orderpriority", "o_totalprice", probs, approx=True, names=[f"q{i}" for i in range(5)])
    n = F.count(F.lit(1))
    near = [(F.count_if(F.col("o_totalprice") <= F.col(f"q{i}")) >= n * (p - 0.01) - 1)
            & (F.count_if(F.col("o_totalprice") < F.col(f"q{i}")) <= n * (p + 0.01) + 1) for i, p in enumerate(probs)]
    return t.orders.join(q, "o_orderpriority").groupBy("o_orderpriority").agg(
        n.alias("n"), (near[0] & near[1] & near[2] & near[3] & near[4]).alias("ranks_within_1_percent"))


@register("weighted_stats", sql="""
WITH m AS (SELECT l_returnflag, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS wmean,
                  sum(l_quantity) AS wsum FROM lineitem GROUP BY l_returnflag),
v AS (SELECT l.l_returnflag, sum(l_quantity * (l_extendedprice - wmean) * (l_extendedprice - wmean)) / any_value(wsum) AS wvar
      FROM lineitem l JOIN m USING (l_returnflag) GROUP BY l.l_returnflag),
h AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS cw,
                sum(w) OVER (PARTITION BY l_returnflag) AS tw FROM h),
q AS (SELECT l_returnflag, min(x) FILTER (WHERE cw >= 0.5 * tw) AS wq50 FROM c GROUP BY l_returnflag)
SELECT m.l_returnflag, round(wmean, 6) AS wmean, wsum, round(wvar, 2) AS wvar, wq50
FROM m JOIN v USING (l_returnflag) JOIN q USING (l_returnflag)""")
def q_weighted_stats(t):
    li = t.lineitem.select("l_returnflag", "l_extendedprice", "l_quantity")
    w = A.weighted_stats(li, "l_returnflag", "l_extendedprice", "l_quantity", probs=[0.5])
    return w.select("l_returnflag", F.round("wmean", 6).alias("wmean"), "wsum",
                    F.round("wvar", 2).alias("wvar"), "wq50")


@register("moments_by", sql="""
WITH m AS (SELECT l_linestatus, avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sp
           FROM lineitem GROUP BY l_linestatus)
SELECT l_linestatus, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean,
       round(stddev_samp(l_extendedprice), 6) AS sd,
       round(avg(power(l_extendedprice - mu, 3)) / power(any_value(sp), 3), 6) AS skewness,
       round(kurtosis_pop(l_extendedprice), 6) AS kurtosis
FROM lineitem JOIN m USING (l_linestatus) GROUP BY l_linestatus""")
def q_moments_by(t):
    m = A.moments_by(t.lineitem, "l_linestatus", "l_extendedprice")
    return m.select("l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "skewness", "kurtosis")])


@register("mode_median", sql="""
WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS k FROM lineitem GROUP BY ALL),
mo AS (SELECT l_returnflag, l_quantity AS mode FROM c
       QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY k DESC, l_quantity) = 1)
SELECT mo.l_returnflag, mode, median
FROM mo JOIN (SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY ALL) USING (l_returnflag)""")
def q_mode_median(t):
    return A.mode_median(t.lineitem, "l_returnflag", "l_quantity")


def _cube_aggs():
    return {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)}


@register("cube_rollup", sql="""
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total,
       CAST(grouping(o_orderstatus, o_orderpriority) AS INTEGER) AS grouping_id
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def q_cube(t):
    return A.cube_rollup(t.orders, ["o_orderstatus", "o_orderpriority"], _cube_aggs(), "cube")


@register("cube_rollup_rollup", sql="""
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total,
       CAST(grouping(o_orderstatus, o_orderpriority) AS INTEGER) AS grouping_id
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def q_rollup(t):
    return A.cube_rollup(t.orders, ["o_orderstatus", "o_orderpriority"], _cube_aggs(), "rollup")


@register("crosstab", sql="""
WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n,
  round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS row_share,
  round(n / sum(n) OVER (PARTITION BY l_linestatus), 6) AS col_share,
  round(n / sum(n) OVER (), 6) AS share
FROM g""")
def q_crosstab(t):
    c = A.crosstab(t.lineitem, "l_returnflag", "l_linestatus")
    return c.withColumns({k: F.round(k, 6) for k in ("row_share", "col_share", "share")})


# ------------------------------------------------------------------ 2.7
@register("arrange_limit", sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def q_arrange_limit(t):
    return V.arrange_limit(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"),
                           ["-o_totalprice", "o_orderkey"], 10)


@register("slice_top", sql="""
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""")
def q_slice_top(t):
    return V.slice_top(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey",
                       ["-o_totalprice", "o_orderkey"], 2)


@register("slice_top_ties", sql="""
SELECT o_custkey, o_orderkey, o_orderdate FROM orders
QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) <= 1""")
def q_slice_top_ties(t):
    return V.slice_top(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey",
                       ["-o_orderdate"], 1, ties=True)


@register("sample_rows", sql="""
SELECT * FROM orders WHERE CAST('0x' || substr(md5(o_orderkey || '|7'), 1, 15) AS BIGINT) / 1152921504606846976.0 < 0.1""")
def q_sample_rows(t):
    """Repeatable 10% Bernoulli sample of orders by a seeded hash of the key."""
    return V.sample_rows(t.orders, 0.1, seed=7, key="o_orderkey")


@register("sample_rows_stratified", sql="""
SELECT * FROM orders WHERE CAST('0x' || substr(md5(o_orderkey || '|7'), 1, 15) AS BIGINT) / 1152921504606846976.0
  < CASE o_orderstatus WHEN 'F' THEN 0.2 WHEN 'O' THEN 0.05 WHEN 'P' THEN 0.05 ELSE 0 END""")
def q_sample_rows_strata(t):
    """Stratified repeatable sample: 20% of 'F' orders, 5% of the others."""
    return V.sample_rows(t.orders, {"F": 0.2, "O": 0.05, "P": 0.05}, by="o_orderstatus", seed=7,
                         key="o_orderkey")


# ------------------------------------------------------------------ 2.8
_A_KEYS = "SELECT c_custkey AS k FROM customer"
_B_KEYS = "SELECT o_custkey AS k FROM orders"


def _ab(t):
    return t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k"))


@register("set_union", sql=f"{_A_KEYS} UNION {_B_KEYS}")
def q_set_union(t):
    return V.set_union(*_ab(t))


@register("set_union_all", sql=f"{_A_KEYS} UNION ALL {_B_KEYS}")
def q_set_union_all(t):
    return V.set_union(*_ab(t), all=True)


_CN = "SELECT c_nationkey AS k FROM customer"
_SN = "SELECT s_nationkey AS k FROM supplier"


def _nk(t):
    return (t.customer.select(F.col("c_nationkey").alias("k")),
            t.supplier.select(F.col("s_nationkey").alias("k")))


@register("set_intersect", sql=f"{_CN} INTERSECT {_SN}")
def q_set_intersect(t):
    return V.set_intersect(*_nk(t))


@register("set_intersect_all", sql=f"{_CN} INTERSECT ALL {_SN}")
def q_set_intersect_all(t):
    return V.set_intersect(*_nk(t), all=True)


@register("set_except", sql="SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey AS k FROM supplier")
def q_set_except(t):
    """Customer numbers that no supplier has."""
    return V.set_except(t.customer.select(F.col("c_custkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k")))


@register("set_except_all", sql=f"{_CN} EXCEPT ALL {_SN}")
def q_set_except_all(t):
    return V.set_except(*_nk(t), all=True)


@register("bind_rows", sql="""
SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, 'customer' AS source
FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_acctbal, NULL, 'supplier' FROM supplier""")
def q_bind_rows(t):
    c = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                          F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                          F.col("s_acctbal").alias("acctbal"))
    return V.bind_rows([c, s], id_col="source", names=["customer", "supplier"])


# ------------------------------------------------------------------ 2.3 as-of / range
@register("join_asof", sql="""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT event_id AS r_event_id, user_id, ts AS r_ts, value AS r_value FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, p.ts, v.r_ts, v.r_event_id, v.r_value
FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.r_ts""")
def q_join_asof(t):
    """For each purchase, the user's last view at or before it."""
    e = t.events
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = e.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    return J.join_asof(p, v, "user_id", "ts", ["event_id", "value"])


@register("join_range", sql="""
SELECT p.event_id AS purchase_id, e.event_id
FROM events e JOIN events p ON p.event_type = 'purchase' AND e.user_id = p.user_id
 AND e.ts >= p.ts AND e.ts <= p.ts + INTERVAL 6 HOUR""")
def q_join_range(t):
    """Every event of the user inside the six hours that start at each purchase, both ends included."""
    e = t.events
    iv = e.where("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("lo"),
        (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("hi"))
    pts = e.select("event_id", "user_id", F.col("ts").alias("p_ts"))
    return J.join_range(pts, iv, "p_ts", "lo", "hi", on=["user_id"], closed="both").select("purchase_id", "event_id")


@register("join_range_keyed", sql="""
SELECT p.event_id AS purchase_id, e.event_id
FROM events e JOIN events p ON p.event_type = 'purchase' AND e.user_id = p.user_id
 AND e.ts >= p.ts - INTERVAL 1 DAY AND e.ts < p.ts""")
def q_join_range_keyed(t):
    """Events of the same user in the day before each purchase."""
    e = t.events
    iv = e.where("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"), "user_id",
        (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("lo"), F.col("ts").alias("hi"))
    pts = e.select("event_id", "user_id", F.col("ts").alias("p_ts"))
    return J.join_range(pts, iv, "p_ts", "lo", "hi", on=["user_id"]).select("purchase_id", "event_id")


_LENGTHS = {0: 1, 1: 60, 2: 3_600, 3: 30 * 86_400}


@register("join_range_mixed", sql="""
SELECT p.event_id AS purchase_id, e.event_id
FROM events p JOIN events e ON p.event_type = 'purchase' AND e.user_id = p.user_id AND e.ts >= p.ts
 AND e.ts < p.ts + to_seconds(CASE p.event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 2592000 ELSE 946080000 END)""")
def q_join_range_mixed(t):
    """Intervals from one second to thirty years in one join."""
    e = t.events
    secs = F.lit(30 * 365 * 86_400)
    for k, n in _LENGTHS.items():
        secs = F.when(F.col("event_id") % 5 == k, n).otherwise(secs)
    iv = e.where("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("lo"), (F.col("ts") + F.make_dt_interval(secs=secs)).alias("hi"))
    pts = e.select("event_id", "user_id", F.col("ts").alias("p_ts"))
    return J.join_range(pts, iv, "p_ts", "lo", "hi", on=["user_id"]).select("purchase_id", "event_id")
