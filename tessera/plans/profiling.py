"""Profiling queries (inventory section 2.5)."""

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.plans.registry import register

_CUST_COLS = [("c_custkey", "bigint", True, False), ("c_name", "string", False, False),
              ("c_nationkey", "int", True, False), ("c_acctbal", "double", True, True),
              ("c_mktsegment", "string", False, False)]


def _profile_table_sql():
    parts = []
    for c, ty, num, flt in _CUST_COLS:
        zero = f"count(*) FILTER (WHERE {c} = 0)" if num else "CAST(NULL AS BIGINT)"
        nan = f"count(*) FILTER (WHERE isnan({c}) OR isinf({c}))" if flt else "CAST(NULL AS BIGINT)"
        parts.append(f"SELECT '{c}' AS \"column\", '{ty}' AS type, count(*) AS n_rows, "
                     f"count(*) FILTER (WHERE {c} IS NULL) AS n_null, {zero} AS n_zero, {nan} AS n_nan_inf, "
                     f"count(DISTINCT {c}) AS n_distinct FROM customer")
    return "\nUNION ALL ".join(parts)


@register("profile_table", sql=_profile_table_sql())
def q_profile_table(t):
    return P.profile_table(t.customer)


_NUM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PNAMES = ["p01", "p05", "p25", "p50", "p75", "p95", "p99"]


def _profile_numeric_sql():
    parts = []
    for c in _NUM_COLS:
        qs = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}"
                       for p, n in zip(P.PROFILE_PROBS, _PNAMES))
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS sd, round(stddev_samp({c}) / avg({c}), 6) AS cv, "
            f"CAST(min({c}) AS DOUBLE) AS min, {qs}, CAST(max({c}) AS DOUBLE) AS max, "
            f"round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, "
            f"round(avg(power({c} - mu, 3)) / power(any_value(sp), 3), 6) AS skewness, "
            f"round(kurtosis_pop({c}), 6) AS kurtosis "
            f"FROM lineitem, (SELECT avg({c}) AS mu, stddev_pop({c}) AS sp FROM lineitem)")
    return "\nUNION ALL ".join(parts)


@register("profile_numeric", sql=_profile_numeric_sql())
def q_profile_numeric(t):
    p = P.profile_numeric(t.lineitem, _NUM_COLS)
    rnd = ["mean", "sd", "cv", *_PNAMES, "iqr", "skewness", "kurtosis"]
    return p.withColumns({c: F.round(c, 6) for c in rnd})


@register("freq_table", sql="""
WITH g AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct,
  round(sum(n) OVER (ORDER BY n DESC, o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100.0
        / sum(n) OVER (), 6) AS cum_pct,
  CAST(row_number() OVER (ORDER BY n DESC, o_orderpriority) AS INTEGER) AS position
FROM g""")
def q_freq_table(t):
    f = P.freq_table(t.orders, "o_orderpriority")
    return f.withColumns({"pct": F.round("pct", 6), "cum_pct": F.round("cum_pct", 6)})


@register("freq_table_ids", sql="""
WITH g AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct,
  round(sum(n) OVER (ORDER BY n DESC, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100.0
        / sum(n) OVER (), 6) AS cum_pct,
  CAST(row_number() OVER (ORDER BY n DESC, l_partkey) AS INTEGER) AS position
FROM g""")
def q_freq_table_ids(t):
    """Frequencies of an id column: very many levels share a count."""
    f = P.freq_table(t.lineitem, "l_partkey")
    return f.withColumns({"pct": F.round("pct", 6), "cum_pct": F.round("cum_pct", 6)})


@register("profile_numeric_sketch", sql="\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, true AS ranks_within_half_percent FROM lineitem" for c in _NUM_COLS))
def q_profile_numeric_sketch(t):
    """The profile with KLL quantiles, one aggregate: are all their ranks within 0.5 % of what was asked?"""
    p = P.profile_numeric(t.lineitem, _NUM_COLS, sketch=2000)
    one = p.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col(q))).alias(f"{c}__{q}") for c in _NUM_COLS for q in _PNAMES])
    near = []
    for c in _NUM_COLS:
        n, x = F.count(c), F.col(c)
        for q, prob in zip(_PNAMES, P.PROFILE_PROBS):
            v = F.col(f"{c}__{q}")
            near.append(((F.count_if(x <= v) >= n * (prob - 0.005) - 1) & (F.count_if(x < v) <= n * (prob + 0.005) + 1)).alias(f"{c}__{q}"))
    seen = t.lineitem.select(*_NUM_COLS).crossJoin(F.broadcast(one)).agg(*near)
    rows = seen.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.forall(F.array(*[F.col(f"{c}__{q}") for q in _PNAMES]), lambda b: b)
                                                   .alias("ranks_within_half_percent")) for c in _NUM_COLS])))
    return p.select("column", "n", F.round("mean", 6).alias("mean")).join(F.broadcast(rows), "column")


@register("outlier_fence", sql="""
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
f AS (SELECT l_returnflag, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, round(lower, 6) AS lower, round(upper, 6) AS upper,
       l_extendedprice < lower OR l_extendedprice > upper AS is_outlier
FROM lineitem JOIN f USING (l_returnflag)""")
def q_outlier_fence(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    o = P.outlier_fence(li, "l_returnflag", "l_extendedprice", "tukey")
    return o.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@register("outlier_fence_mad", sql="""
WITH m AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem GROUP BY 1),
d AS (SELECT l_returnflag, quantile_cont(abs(l_extendedprice - med), 0.5) AS mad
      FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1),
f AS (SELECT l_returnflag, med - 3.0 * 1.4826 * mad AS lower, med + 3.0 * 1.4826 * mad AS upper
      FROM m JOIN d USING (l_returnflag))
SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, round(lower, 6) AS lower, round(upper, 6) AS upper,
       l_extendedprice < lower OR l_extendedprice > upper AS is_outlier
FROM lineitem JOIN f USING (l_returnflag)""")
def q_outlier_fence_mad(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    o = P.outlier_fence(li, "l_returnflag", "l_extendedprice", "mad")
    return o.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


def _pairs_sql(expr_of):
    pairs = [(a, b) for i, a in enumerate(_NUM_COLS) for b in _NUM_COLS[i + 1:]]
    return [f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({expr_of(a)}, {expr_of(b)}), 6) AS r" for a, b in pairs]


@register("correlations", sql="\nUNION ALL ".join(s + " FROM lineitem" for s in _pairs_sql(lambda c: c)))
def q_correlations(t):
    return P.correlations(t.lineitem, _NUM_COLS).withColumn("r", F.round("r", 6))


_RANKED = ("(SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _NUM_COLS)
    + " FROM lineitem)")


@register("correlations_spearman",
          sql="\nUNION ALL ".join(s + f" FROM {_RANKED}" for s in _pairs_sql(lambda c: f"r_{c}")))
def q_correlations_spearman(t):
    c = P.correlations(t.lineitem, _NUM_COLS, "spearman")
    return c.withColumn("r", F.round("r", 6))


_GAPS = """(SELECT l_quantity, l_extendedprice, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS l_discount,
  CASE WHEN l_quantity <= 40 THEN l_tax END AS l_tax FROM lineitem)"""


def _ranked_pairs_sql():
    def ranked(c):
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    pairs = [(a, b) for i, a in enumerate(_NUM_COLS) for b in _NUM_COLS[i + 1:]]
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr(ra, rb), 6) AS r FROM (SELECT {ranked(a)} AS ra, {ranked(b)} AS rb "
        f"FROM {_GAPS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in pairs)


@register("correlations_spearman_nulls", sql=_ranked_pairs_sql())
def q_correlations_spearman_nulls(t):
    """Spearman where two columns have gaps: each pair is ranked on its own complete rows."""
    li = t.lineitem.select("l_quantity", "l_extendedprice", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("l_discount"),
                           F.when(F.col("l_quantity") <= 40, F.col("l_tax")).alias("l_tax"))
    return P.correlations(li, _NUM_COLS, "spearman").withColumn("r", F.round("r", 6))


_INFO_COLS = ["l_linestatus", "l_quantity", "l_discount"]


def _info_sql():
    parts = []
    for c in _INFO_COLS:
        parts.append(f"""SELECT '{c}' AS "column",
  (SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY {c})) AS hx,
  (SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY {c}, l_returnflag)) AS hxy,
  (SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY l_returnflag)) AS hy""")
    body = "\nUNION ALL ".join(parts)
    return (f"WITH e AS ({body})\nSELECT \"column\", round(hx, 6) AS entropy, round(hx + hy - hxy, 6) AS mutual_info, "
            "round((hx + hy - hxy) / hx, 6) AS gain_ratio FROM e")


@register("info_measures", sql=_info_sql())
def q_info_measures(t):
    i = P.info_measures(t.lineitem, _INFO_COLS, "l_returnflag")
    return i.withColumns({c: F.round(c, 6) for c in ("entropy", "mutual_info", "gain_ratio")})


def scored_in(t):
    """documents joined to labels: score = n_chars, truth = quality."""
    return t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id") \
        .select("doc_id", F.col("n_chars").alias("score"), F.col("quality").alias("truth"))


SCORED_SQL = ("(SELECT d.doc_id, d.n_chars AS score, l.quality AS truth "
              "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")


@register("target_profile", sql=f"""
WITH s AS {SCORED_SQL}, c AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM s),
b AS (SELECT s.*, CAST(1 + CAST(q[1] < score AS INT) + CAST(q[2] < score AS INT) + CAST(q[3] < score AS INT)
                         + CAST(q[4] < score AS INT) AS INTEGER) AS bin FROM s, c)
SELECT bin, count(*) AS n, CAST(sum(truth) AS BIGINT) AS positives, round(avg(truth), 6) AS rate,
       min(score) AS lo, max(score) AS hi
FROM b GROUP BY bin""")
def q_target_profile(t):
    p = P.target_profile(scored_in(t), "score", "truth", 5)
    return p.withColumns({"rate": F.round("rate", 6), "positives": F.col("positives").cast("bigint")})


@register("gain_lift", sql=f"""
WITH s AS {SCORED_SQL},
c AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM s),
b AS (SELECT s.*, CAST(11 - (1 + list_sum([CASE WHEN x < score THEN 1 ELSE 0 END FOR x IN q])) AS INTEGER) AS grp
      FROM s, c),
g AS (SELECT grp, count(*) AS n, CAST(sum(truth) AS BIGINT) AS positives FROM b GROUP BY grp),
w AS (SELECT grp, n, positives,
        sum(n) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_n,
        sum(positives) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_positives,
        sum(n) OVER () AS tn, sum(positives) OVER () AS tp FROM g)
SELECT grp, n, positives, CAST(cum_n AS BIGINT) AS cum_n, CAST(cum_positives AS BIGINT) AS cum_positives,
       round(cum_positives / tp, 6) AS gain, round((cum_positives / cum_n) / (tp / tn), 6) AS lift
FROM w""")
def q_gain_lift(t):
    g = P.gain_lift(scored_in(t), "score", "truth", 10)
    return g.withColumns({"gain": F.round("gain", 6), "lift": F.round("lift", 6)})


@register("histogram_bins", sql="""
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 20) + 1, 20) AS INTEGER) AS bin, count(*) AS n
      FROM orders, r GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(1, 20)) AS INTEGER) AS bin, lo, hi FROM r)
SELECT s.bin, round(lo + (s.bin - 1) * (hi - lo) / 20, 6) AS lo, round(lo + s.bin * (hi - lo) / 20, 6) AS hi,
       coalesce(c.n, 0) AS n
FROM s LEFT JOIN c USING (bin)""")
def q_histogram_bins(t):
    h = P.histogram_bins(t.orders, "o_totalprice", 20)
    return h.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@register("box_summary", sql="""
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
                  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderpriority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
  min(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
  max(o_totalprice) FILTER (WHERE o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
  count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS n_out
FROM orders JOIN q USING (o_orderpriority) GROUP BY o_orderpriority, q1, median, q3""")
def q_box_summary(t):
    b = P.box_summary(t.orders, "o_orderpriority", "o_totalprice")
    return b.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})
