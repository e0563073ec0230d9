"""Tail probabilities against textbook critical values, and as Spark columns."""

import math

from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.functions import distributions as D


def test_scalar_tails():
    assert abs(D.chisq_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(D.chisq_sf(18.307038053275146, 10) - 0.05) < 1e-9
    assert abs(D.t_two_sided(2.228138851986274, 10) - 0.05) < 1e-9
    assert abs(D.t_two_sided(1.959963984540054, 1e9) - 0.05) < 1e-6
    assert abs(D.f_sf(4.102821015130402, 2, 10) - 0.05) < 1e-9
    assert abs(D.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    assert D.chisq_sf(0.0, 3) == 1.0 and math.isnan(D.chisq_sf(float("nan"), 3))


def test_p_values_as_columns(spark, small_dir):
    c = E.queries()["chisq_test"](spark, small_dir)
    r = c.select(D.p_chisq("statistic", "df").alias("p")).first()
    assert 0.0 <= r["p"] <= 1.0
    t = E.queries()["t_test_welch"](spark, small_dir).select(D.p_t("t", "df").alias("p")).toPandas()
    assert t["p"].between(0, 1).all()
    a = E.queries()["anova_oneway"](spark, small_dir).select(D.p_f("f", "df_between", "df_within").alias("p"))
    assert 0.0 <= a.first()["p"] <= 1.0
    z = spark.range(1).select(D.p_normal(F.lit(1.959963984540054)).alias("p")).first()["p"]
    assert abs(z - 0.05) < 1e-12
