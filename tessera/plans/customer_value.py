"""Customer-value queries (flagship: ``rfm_orders``)."""

from pyspark.sql import functions as F

from tessera.operators import rfm
from tessera.plans.registry import register

AS_OF = "2001-08-02"  # day after the last order date in every fixture scale

_PER_CUSTOMER_SQL = """
per AS (
  SELECT o_custkey AS customer,
         CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-02') AS INTEGER) AS recency_days,
         count(*) AS frequency,
         round(sum(o_totalprice), 2) AS monetary
  FROM orders GROUP BY o_custkey
),
cuts AS (
  SELECT quantile_cont(recency_days, [0.2, 0.4, 0.6, 0.8]) AS rc,
         quantile_cont(frequency, [0.2, 0.4, 0.6, 0.8]) AS fc,
         quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS mc
  FROM per
),
binned AS (
  SELECT customer, recency_days, frequency, monetary,
    CAST(6 - (1 + CAST(rc[1] < recency_days AS INT) + CAST(rc[2] < recency_days AS INT)
                 + CAST(rc[3] < recency_days AS INT) + CAST(rc[4] < recency_days AS INT)) AS INTEGER) AS r_score,
    CAST(1 + CAST(fc[1] < frequency AS INT) + CAST(fc[2] < frequency AS INT)
           + CAST(fc[3] < frequency AS INT) + CAST(fc[4] < frequency AS INT) AS INTEGER) AS f_score,
    CAST(1 + CAST(mc[1] < monetary AS INT) + CAST(mc[2] < monetary AS INT)
           + CAST(mc[3] < monetary AS INT) + CAST(mc[4] < monetary AS INT) AS INTEGER) AS m_score
  FROM per, cuts
),
scored AS (
  SELECT *, CAST(r_score * 100 + f_score * 10 + m_score AS INTEGER) AS rfm_score FROM binned
)"""


def rfm_orders_df(t):
    return rfm.rfm_orders(t.orders, "o_custkey", "o_orderdate", "o_totalprice", AS_OF)


@register("rfm_orders", sql="WITH" + _PER_CUSTOMER_SQL + "\nSELECT * FROM scored")
def q_rfm_orders(t):
    """Flagship: RFM scores per customer straight from `orders`."""
    return rfm_orders_df(t)


@register("rfm_customers", sql="WITH" + _PER_CUSTOMER_SQL + "\nSELECT * FROM scored")
def q_rfm_customers(t):
    """RFM from pre-aggregated customer rows (last order, count, revenue)."""
    pre = t.orders.groupBy(F.col("o_custkey").alias("customer")).agg(
        F.max("o_orderdate").alias("last_order"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("o_totalprice").alias("revenue"))
    return rfm.rfm_customers(pre, "customer", "last_order", "n_orders", "revenue", AS_OF)


def _segments_sql():
    whens = "\n".join(
        f"    WHEN r_score BETWEEN {r0} AND {r1} AND f_score BETWEEN {f0} AND {f1} "
        f"AND m_score BETWEEN {m0} AND {m1} THEN '{name}'"
        for name, r0, r1, f0, f1, m0, m1 in rfm.DEFAULT_SEGMENTS)
    return ("WITH" + _PER_CUSTOMER_SQL + "\nSELECT *, CASE\n" + whens
            + f"\n    ELSE '{rfm.DEFAULT_OTHER}' END AS segment FROM scored")


@register("rfm_segments", sql=_segments_sql())
def q_rfm_segments(t):
    """Named segments from score ranges; first matching rule wins."""
    return rfm.rfm_segments(rfm_orders_df(t))


@register("rfm_grid", sql="WITH" + _PER_CUSTOMER_SQL + """,
grid AS (SELECT CAST(r AS INTEGER) AS r_score, CAST(f AS INTEGER) AS f_score
         FROM range(1, 6) a(r), range(1, 6) b(f)),
cells AS (SELECT r_score, f_score, count(*) AS customers,
                 quantile_cont(monetary, 0.5) AS med FROM scored GROUP BY r_score, f_score)
SELECT g.r_score, g.f_score, CAST(coalesce(c.customers, 0) AS BIGINT) AS customers,
       round(c.med, 6) AS median_monetary
FROM grid g LEFT JOIN cells c USING (r_score, f_score)""")
def q_rfm_grid(t):
    """Customers and median monetary per recency x frequency score cell."""
    return rfm.rfm_grid(rfm_orders_df(t))
