"""Scalar-function and source queries (inventory sections 2.1 and 2.10)."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays as AR
from tessera.functions import dates as D
from tessera.functions import mathx as M
from tessera.functions import strings as S
from tessera.operators import factors as FA
from tessera.plans.registry import register
from tessera.session import scratch_path
from tessera.sources import text as TX

# ------------------------------------------------------------------ 2.10 strings
@register("string_scalars", sql="""
SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS len, upper(p_name) AS up, lower(p_brand) AS low,
  trim('  ' || p_type || ' ') AS trimmed,
  trim(regexp_replace('  ' || p_name || '   x ', '\\s+', ' ', 'g')) AS squished,
  lpad(p_brand, 12, '*') AS padded, rpad(p_type, 10, '.') AS rpadded,
  substring(p_name, 2, 4) AS sub, replace(p_brand, 'Brand#', 'B-') AS repl,
  concat_ws('|', p_brand, p_type, p_name) AS cat,
  starts_with(p_name, 'small') AS starts, ends_with(p_name, 'ring') AS ends
FROM part""")
def q_string_scalars(t):
    p = t.part
    return p.select(
        "p_partkey", S.str_length("p_name").alias("len"), S.str_case("p_name", "upper").alias("up"),
        S.str_case("p_brand", "lower").alias("low"),
        S.str_trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"),
        S.str_squish(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("squished"),
        S.str_pad("p_brand", 12, "left", "*").alias("padded"),
        S.str_pad("p_type", 10, "right", ".").alias("rpadded"),
        S.str_sub("p_name", 2, 5).alias("sub"), S.str_replace("p_brand", "Brand#", "B-").alias("repl"),
        S.str_concat("|", "p_brand", "p_type", "p_name").alias("cat"),
        S.str_starts("p_name", "small").alias("starts"), S.str_ends("p_name", "ring").alias("ends"))


@register("regex_scalars", sql="""
SELECT doc_id, regexp_matches(text, '[0-9]') AS has_digit,
  CAST(len(regexp_extract_all(text, 'é')) AS INTEGER) AS n_e_acute,
  regexp_extract(text, '[A-Za-z]+', 0) AS first_word,
  CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS INTEGER) AS n_cap_words,
  CAST(length(regexp_replace(text, '[aeiou]', '', 'g')) AS INTEGER) AS len_no_vowels,
  CAST(len(string_split_regex(text, '\n')) AS INTEGER) AS n_lines
FROM documents""")
def q_regex_scalars(t):
    d = t.documents
    return d.select(
        "doc_id", S.re_detect("text", "[0-9]").alias("has_digit"),
        S.re_count("text", "é").alias("n_e_acute"),
        S.re_extract("text", "[A-Za-z]+").alias("first_word"),
        F.size(S.re_extract("text", "[A-Z][a-z]+", all=True)).alias("n_cap_words"),
        F.length(S.re_replace("text", "[aeiou]", "")).alias("len_no_vowels"),
        F.size(S.re_split("text", "\n")).alias("n_lines"))


# ------------------------------------------------------------------ 2.10 dates
@register("date_parts", sql="""
SELECT o_orderkey, o_orderdate,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
  CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day,
  CAST(isodow(o_orderdate) AS INTEGER) AS weekday, CAST(week(o_orderdate) AS INTEGER) AS isoweek,
  CAST(dayofyear(o_orderdate) AS INTEGER) AS yday
FROM orders""")
def q_date_parts(t):
    o = t.orders.select("o_orderkey", "o_orderdate")
    return o.select("*", *[D.date_part("o_orderdate", u).alias(u) for u in
                           ("year", "quarter", "month", "day", "weekday", "isoweek", "yday")])


@register("date_round", sql="""
WITH b AS (SELECT o_orderkey, o_orderdate,
  CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS floor_month,
  CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS floor_week,
  CAST(CAST(date_trunc('week', o_orderdate + INTERVAL 1 DAY) AS DATE) - 1 AS TIMESTAMP) AS floor_week_sun,
  CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS floor_quarter
  FROM orders),
c AS (SELECT *, CASE WHEN floor_month = o_orderdate THEN floor_month
                     ELSE CAST(floor_month + INTERVAL 1 MONTH AS TIMESTAMP) END AS ceil_month FROM b)
SELECT *, CASE WHEN date_diff('second', floor_month, o_orderdate) < date_diff('second', o_orderdate, ceil_month)
               THEN floor_month ELSE ceil_month END AS round_month
FROM c""")
def q_date_round(t):
    o = t.orders.select("o_orderkey", "o_orderdate")
    out = {"floor_month": D.date_floor("o_orderdate", "month"),
           "floor_week": D.date_floor("o_orderdate", "week"),
           "floor_week_sun": D.date_floor("o_orderdate", "week", week_start=7),
           "floor_quarter": D.date_floor("o_orderdate", "quarter"),
           "ceil_month": D.date_ceiling("o_orderdate", "month"),
           "round_month": D.date_round("o_orderdate", "month")}
    return o.select("*", *[v.cast("timestamp_ntz").alias(k) for k, v in out.items()])


@register("date_arith", sql="""
SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate,
  CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS TIMESTAMP) AS plus_1m,
  CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 13 MONTH AS DATE) AS TIMESTAMP) AS minus_13m,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS ship_days,
  date_diff('hour', o_orderdate, l_shipdate) AS ship_hours,
  CAST(year(DATE '2001-08-02') - year(o_orderdate)
       - CASE WHEN month(DATE '2001-08-02') < month(o_orderdate)
                OR (month(DATE '2001-08-02') = month(o_orderdate) AND day(DATE '2001-08-02') < day(o_orderdate))
              THEN 1 ELSE 0 END AS INTEGER) AS age_years
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q_date_arith(t):
    j = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").join(
        t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate",
                    D.date_add_months("o_orderdate", 1).cast("timestamp_ntz").alias("plus_1m"),
                    D.date_add_months("o_orderdate", -13).cast("timestamp_ntz").alias("minus_13m"),
                    D.date_diff("o_orderdate", "l_shipdate", "day").alias("ship_days"),
                    D.date_diff("o_orderdate", "l_shipdate", "hour").alias("ship_hours"),
                    D.age_years("o_orderdate", F.lit("2001-08-02")).alias("age_years"))


@register("interval_ops", sql="""
WITH s AS (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey),
i AS (SELECT o_orderkey, o_orderdate AS s1, last_ship AS e1,
             TIMESTAMP '1998-01-01' AS s2, TIMESTAMP '1998-07-01' AS e2
      FROM orders JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderkey, s1, e1, greatest(s1, s2) < least(e1, e2) AS overlaps,
  s1 <= s2 AND e2 <= e1 AS contains,
  CASE WHEN greatest(s1, s2) < least(e1, e2) THEN greatest(s1, s2) END AS inter_start,
  CASE WHEN greatest(s1, s2) < least(e1, e2) THEN least(e1, e2) END AS inter_end,
  CAST(CASE WHEN greatest(s1, s2) <= least(e1, e2) THEN 0
       ELSE date_diff('day', CAST(least(e1, e2) AS DATE), CAST(greatest(s1, s2) AS DATE)) END AS INTEGER) AS gap_days
FROM i""")
def q_interval_ops(t):
    s = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("e1"))
    o = t.orders.select("o_orderkey", F.col("o_orderdate").alias("s1")).join(
        s, F.col("o_orderkey") == F.col("l_orderkey"))
    s2 = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    e2 = F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")
    ops = D.interval_ops("s1", "e1", s2, e2)
    return o.select("o_orderkey", "s1", "e1", *[v.alias(k) for k, v in ops.items()])


# The holiday list is 25 December and 1 January of 1994-2003.
HOLIDAYS = [dt.date(y, m, d) for y in range(1994, 2004) for (m, d) in ((1, 1), (12, 25))]
_HOL_SQL = ", ".join(f"(DATE '{h.isoformat()}')" for h in HOLIDAYS)


@register("business_days", sql=f"""
WITH hol AS (SELECT * FROM (VALUES {_HOL_SQL}) h(dt)),
b AS (SELECT min(d) AS lo, max(d) AS hi FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders
                                              UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem)),
days AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP) + INTERVAL 14 DAY,
                                            INTERVAL 1 DAY)) AS DATE) AS dt FROM b),
c0 AS (SELECT dt, isodow(dt) NOT IN (6, 7) AND dt NOT IN (SELECT dt FROM hol) AS is_business FROM days),
cal AS (SELECT dt, is_business,
  CAST(sum(CAST(is_business AS INTEGER)) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bd_index,
  first_value(CASE WHEN is_business THEN dt END IGNORE NULLS)
    OVER (ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_bd
  FROM c0)
SELECT l_orderkey, l_linenumber, co.is_business AS order_is_business,
       CAST(co.next_bd AS TIMESTAMP) AS order_next_bd,
       cs.bd_index - co.bd_index AS bd_to_ship
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN cal co ON co.dt = CAST(o_orderdate AS DATE) JOIN cal cs ON cs.dt = CAST(l_shipdate AS DATE)""")
def q_business_days(t):
    spark = t.spark
    hol = spark.createDataFrame([(h,) for h in HOLIDAYS], "dt date")
    j = t.lineitem.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship")).join(
        t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("od")),
        F.col("l_orderkey") == F.col("o_orderkey"))
    r = D.business_days(j, "od", "ship", hol)
    return r.select("l_orderkey", "l_linenumber", F.col("start_is_business").alias("order_is_business"),
                    F.col("start_next_bd").cast("timestamp_ntz").alias("order_next_bd"),
                    F.col("business_days").alias("bd_to_ship"))


# ------------------------------------------------------------------ 2.10 maths
@register("math_scalars", sql="""
WITH s AS (SELECT l_returnflag, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd,
                  min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 2) AS rhu,
  round(l_tax / nullif(l_discount, 0), 6) AS sdiv, round(log(10, l_extendedprice), 6) AS lg10,
  pow(l_quantity, 2) AS sq, round(abs(l_discount - 0.05), 6) AS dev,
  round((l_extendedprice - m) / sd, 6) AS l_extendedprice_z,
  round((l_extendedprice - lo) / (hi - lo), 6) AS l_extendedprice_minmax
FROM lineitem JOIN s USING (l_returnflag)""")
def q_math_scalars(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity",
                           "l_discount", "l_tax")
    sc = M.scale_by_group(li, ["l_extendedprice"], by=["l_returnflag"])
    return sc.select(
        "l_orderkey", "l_linenumber", M.round_half_up(F.col("l_extendedprice") / 7, 2).alias("rhu"),
        F.round(M.safe_div("l_tax", "l_discount"), 6).alias("sdiv"),
        F.round(M.log_base("l_extendedprice", 10), 6).alias("lg10"),
        M.pow_("l_quantity", 2).alias("sq"), F.round(M.abs_(F.col("l_discount") - 0.05), 6).alias("dev"),
        F.round("l_extendedprice_z", 6).alias("l_extendedprice_z"),
        F.round("l_extendedprice_minmax", 6).alias("l_extendedprice_minmax"))


@register("factor_lump", sql="""
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
top AS (SELECT p_brand FROM c ORDER BY n DESC, p_brand LIMIT 5)
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'Other' END AS p_brand
FROM part""")
def q_factor_lump(t):
    return FA.factor_lump(t.part.select("p_partkey", "p_brand"), "p_brand", 5)


@register("factor_order", sql="""
WITH c AS (SELECT p_brand, count(*) AS n, quantile_cont(p_retailprice, 0.5) AS key FROM part GROUP BY 1)
SELECT p_brand, n, round(key, 6) AS key, CAST(row_number() OVER (ORDER BY key, p_brand) AS INTEGER) AS position
FROM c""")
def q_factor_order(t):
    r = FA.factor_order(t.part, "p_brand", by="p_retailprice")
    return r.withColumn("key", F.round("key", 6))


@register("factor_order_freq", sql="""
WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
SELECT p_type, n, CAST(n AS DOUBLE) AS key, CAST(row_number() OVER (ORDER BY n DESC, p_type) AS INTEGER) AS position
FROM c""")
def q_factor_order_freq(t):
    return FA.factor_order(t.part, "p_type")


@register("array_scalars", sql="""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id,
  round(sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b, 0.0)), 6) AS norm,
  CAST(len(list_filter(v, lambda x: x > 0)) AS INTEGER) AS n_pos,
  round(list_reduce(v, lambda a, b: a + b, 0.0), 6) AS total,
  list_bool_or(list_transform(v, lambda x: x > 0.25)) AS any_big,
  list_bool_and(list_transform(v, lambda x: abs(x) < 0.5)) AS all_small,
  round(list_max(list_transform(v, lambda x: x * 2)), 6) AS max_doubled
FROM e""")
def q_array_scalars(t):
    v = AR.as_double_array("embedding")
    e = t.embeddings.select("vec_id", v.alias("v"))
    return e.select(
        "vec_id", F.round(AR.arr_norm("v"), 6).alias("norm"),
        F.size(AR.arr_keep("v", lambda x: x > 0)).alias("n_pos"),
        F.round(AR.arr_reduce("v", 0.0, lambda a, x: a + x), 6).alias("total"),
        AR.arr_any("v", lambda x: x > 0.25).alias("any_big"),
        AR.arr_all("v", lambda x: F.abs(x) < 0.5).alias("all_small"),
        F.round(F.array_max(AR.arr_map("v", lambda x: x * 2)), 6).alias("max_doubled"))


# ------------------------------------------------------------------ 2.1 sources
NATION_SCHEMA = T.StructType([T.StructField("n_nationkey", T.IntegerType()),
                              T.StructField("n_name", T.StringType()),
                              T.StructField("n_regionkey", T.IntegerType())])


@register("read_delimited", sql="""
SELECT n_nationkey, n_name, n_regionkey, CAST(NULL AS VARCHAR) AS _corrupt_record FROM nation""")
def q_read_delimited(t):
    path = scratch_path(t.spark, "csv_nation")
    TX.write_delimited(t.nation, path, sep=";")
    return TX.read_delimited(t.spark, path, NATION_SCHEMA, sep=";")


@register("read_delimited_multiline", sql="""
SELECT p_partkey, replace(p_name, ' ', chr(10)) || ',"' || p_brand || '"' AS p_name, p_retailprice, CAST(NULL AS VARCHAR) AS _corrupt_record FROM part""")
def q_read_delimited_multiline(t):
    """Names with line breaks, separators and quotes, written quoted and read in splits."""
    path = scratch_path(t.spark, "csv_part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("\n")), F.lit(',"'), F.col("p_brand"), F.lit('"'))
    part = t.part.select("p_partkey", name.alias("p_name"), "p_retailprice")
    TX.write_delimited(part, path)
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_retailprice", T.DoubleType())])
    return TX.read_delimited(t.spark, path, schema, multiline=True)


@register("write_partitioned", sql="""
SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1""")
def q_write_partitioned(t):
    path = scratch_path(t.spark, "orders_by_year")
    TX.write_partitioned(t.orders.withColumn("yr", F.year("o_orderdate")), path, "parquet", ["yr"])
    back = TX.read_partitioned(t.spark, path).where("yr >= 1998")
    return back.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("json_column", sql="""
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def q_json_column(t):
    e = t.events.select("event_id", "event_type", "props")
    return TX.json_column(e, "props", "k BIGINT").drop("props")


@register("html_extract", sql="""
WITH p AS (SELECT page_id, html,
  regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                 '(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>', '', 'g'), '(?s)<[^>]*>', ' ', 'g') AS body,
  regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS head FROM pages),
u AS (SELECT page_id, html,
  replace(replace(replace(replace(replace(replace(replace(body, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS body,
  replace(replace(replace(replace(replace(head, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS head FROM p)
SELECT page_id, nullif(trim(regexp_replace(head, '\\s+', ' ', 'g')), '') AS title,
       CAST(len(regexp_extract_all(html, '<a [^>]*href')) AS INTEGER) AS n_links,
       CAST(length(trim(regexp_replace(body, '\\s+', ' ', 'g'))) AS INTEGER) AS text_chars FROM u""")
def q_html_extract(t):
    """Title, link count and visible text length per page."""
    return TX.html_extract(t.pages)
