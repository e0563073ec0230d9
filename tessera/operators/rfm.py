"""Recency-frequency-monetary scoring.

Contract
--------
* per customer: ``recency_days = datediff(as_of, last order)``, ``frequency =
  count of orders``, ``monetary = round(sum(amount), 2)`` (rounded before cutting);
* cut points are the exact linear-interpolation quantiles at 1/n, ..., (n-1)/n
  over customers, for each of the three measures;
* bin = 1 + number of cut points strictly below the value; the recency score is
  reversed (``n + 1 - bin``) so that recent buyers score high;
* ``rfm_score = 100 r + 10 f + m``.

Plan shape: one aggregation shuffled on the customer key, one combined
quantile job over the three measures (pre-aggregated histogram, range
partitioned), and a one-row cut table broadcast to every customer partition.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checks import require_columns
from tessera.operators.ranking import cut_bin, exact_quantiles

MEASURES = ("recency_days", "frequency", "monetary")


def _as_of_col(as_of):
    if isinstance(as_of, (dt.date, dt.datetime)):
        as_of = as_of.isoformat()[:10]
    return F.to_date(F.lit(str(as_of)))


def rfm_cut_points(per_customer: DataFrame, bins: int = 5, sketch: int | None = None) -> DataFrame:
    """One row: ``<measure>_c1 .. <measure>_c{bins-1}`` for the three measures. With ``sketch`` the cut points are those of
    KLL sketches of that many items, built by one aggregate of the customers (``ranking.sketch_rank_error``)."""
    if sketch is not None:
        one = per_customer.agg(*[F.kll_sketch_agg_double(F.col(m).cast("double"), F.lit(sketch)).alias(m) for m in MEASURES],
                               *[F.count(m).alias(f"{m}_n") for m in MEASURES])
        return one.select(*[F.when(F.col(f"{m}_n") > 0, F.kll_sketch_get_quantile_double(m, F.lit(i / bins))).alias(f"{m}_c{i}")
                            for m in MEASURES for i in range(1, bins)])
    long = per_customer.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
        for m in MEASURES])).alias("kv")).select("kv.measure", "kv.value")
    probs = [i / bins for i in range(1, bins)]
    names = [f"c{i}" for i in range(1, bins)]
    q = exact_quantiles(long, "value", probs, by=["measure"], names=names)
    wide = q.groupBy().pivot("measure", list(MEASURES)).agg(*[F.first(n).alias(n) for n in names])
    if len(names) == 1:  # pivot names a single aggregate by the pivot value alone
        wide = wide.select(*[F.col(m).alias(f"{m}_c1") for m in MEASURES])
    else:
        wide = wide.select(*[F.col(f"{m}_{n}").alias(f"{m}_{n}") for m in MEASURES for n in names])
    return wide


def rfm_customers(df: DataFrame, id_col: str, last_col: str, n_col: str, amount_col: str,
                  as_of, bins: int = 5, sketch: int | None = None) -> DataFrame:
    """Scores from pre-aggregated rows (one per customer: last date, count, revenue)."""
    require_columns(df, id_col, last_col, n_col, amount_col)
    per = df.select(
        F.col(id_col).alias("customer"),
        F.datediff(_as_of_col(as_of), F.to_date(F.col(last_col))).alias("recency_days"),
        F.col(n_col).cast("bigint").alias("frequency"),
        F.round(F.col(amount_col).cast("double"), 2).alias("monetary"),
    )
    return score_rfm(per, bins, sketch)


def score_rfm(per: DataFrame, bins: int = 5, sketch: int | None = None) -> DataFrame:
    cuts = rfm_cut_points(per, bins, sketch)
    scored = per.crossJoin(F.broadcast(cuts))  # one row, size fixed by `bins`

    def score(m):
        return cut_bin(F.col(m), [F.col(f"{m}_c{i}") for i in range(1, bins)])

    r = (F.lit(bins + 1) - score("recency_days")).cast("int")
    f = score("frequency").cast("int")
    m = score("monetary").cast("int")
    return scored.select(
        "customer", "recency_days", "frequency", "monetary",
        r.alias("r_score"), f.alias("f_score"), m.alias("m_score"),
        (r * 100 + f * 10 + m).alias("rfm_score"),
    )


def rfm_orders(orders: DataFrame, id_col: str, ts_col: str, amount_col: str, as_of,
               bins: int = 5, sketch: int | None = None) -> DataFrame:
    """Scores straight from order rows; ``sketch`` as in ``rfm_cut_points``."""
    require_columns(orders, id_col, ts_col, amount_col)
    per = orders.groupBy(id_col).agg(
        F.max(ts_col).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(amount_col).alias("_amount"),
    )
    return rfm_customers(per, id_col, "_last", "_n", "_amount", as_of, bins, sketch)


# Fixed values of this library's own choice: default segment rules, checked in order, first match wins.
# (segment, r_min, r_max, f_min, f_max, m_min, m_max), all bounds inclusive.
DEFAULT_SEGMENTS = [
    ("champions", 4, 5, 4, 5, 4, 5),
    ("loyal_customers", 3, 5, 3, 5, 3, 5),
    ("potential_loyalist", 3, 5, 1, 3, 1, 3),
    ("new_customers", 4, 5, 1, 1, 1, 5),
    ("promising", 3, 4, 1, 1, 1, 5),
    ("need_attention", 2, 3, 2, 3, 2, 3),
    ("about_to_sleep", 2, 3, 1, 2, 1, 2),
    ("cant_lose_them", 1, 1, 4, 5, 4, 5),
    ("at_risk", 1, 2, 2, 5, 2, 5),
    ("hibernating", 1, 2, 1, 2, 1, 2),
]
DEFAULT_OTHER = "others"


def rfm_segments(scored: DataFrame, rules=None, other: str = DEFAULT_OTHER) -> DataFrame:
    """Adds ``segment``: the first rule whose score ranges hold."""
    require_columns(scored, "r_score", "f_score", "m_score")
    rules = DEFAULT_SEGMENTS if rules is None else rules
    expr = None
    for name, r0, r1, f0, f1, m0, m1 in rules:
        cond = (F.col("r_score").between(r0, r1) & F.col("f_score").between(f0, f1)
                & F.col("m_score").between(m0, m1))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    seg = F.lit(other) if expr is None else expr.otherwise(F.lit(other))
    return scored.withColumn("segment", seg)


def rfm_grid(scored: DataFrame, bins: int = 5) -> DataFrame:
    """Customers and median monetary per (r_score, f_score); every cell of the
    bins x bins grid present, empty cells with 0 customers and NULL median."""
    require_columns(scored, "r_score", "f_score", "monetary")
    spark = scored.sparkSession
    # one pass: the median job also yields each cell's customer count
    # (monetary is never NULL here: it is a rounded sum of order amounts)
    med = exact_quantiles(scored, "monetary", [0.5], by=["r_score", "f_score"],
                          names=["median_monetary"], count_name="customers")
    grid = (spark.range(1, bins + 1).select(F.col("id").cast("int").alias("r_score"))
            .crossJoin(spark.range(1, bins + 1).select(F.col("id").cast("int").alias("f_score"))))
    return (grid.join(F.broadcast(med), ["r_score", "f_score"], "left")
            .select("r_score", "f_score",
                    F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"),
                    F.round("median_monetary", 6).alias("median_monetary")))
