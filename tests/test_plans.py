"""Plan-shape checks on the executed (adaptive) plans."""

import re

import __spark_entry__ as E


def executed_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(plan: str):
    return [ln for ln in plan.splitlines() if ln.strip()]


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def single_partition_windows_over_raw_rows(plan: str) -> list[str]:
    """Window operators fed by an Exchange SinglePartition whose input is not
    an aggregate (i.e. a window over ungrouped rows in one task)."""
    lines = _lines(plan)
    bad = []
    for i, ln in enumerate(lines):
        if "Exchange SinglePartition" not in ln:
            continue
        above = [lines[j] for j in range(max(0, i - 3), i)]
        if not any(re.search(r"\bWindow\b", a) for a in above):
            continue
        below = " ".join(lines[i + 1:i + 4])
        if "HashAggregate" not in below and "ObjectHashAggregate" not in below and "SortAggregate" not in below:
            bad.append(ln)
    return bad


def test_rfm_plan_shape(spark, medium_dir):
    plan = executed_plan(E.queries()["rfm_orders"](spark, medium_dir))
    assert "PushedFilters" in plan or "ReadSchema" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    assert not single_partition_windows_over_raw_rows(plan)


def test_quantile_plans_have_no_global_row_window(spark, medium_dir):
    for key in ("quantiles_by", "bin_equal_freq", "roc_auc", "correlations_spearman", "split_stratified"):
        plan = executed_plan(E.queries()[key](spark, medium_dir))
        assert not single_partition_windows_over_raw_rows(plan), key


def test_range_join_is_not_nested_loop(spark, medium_dir):
    for key in ("join_range", "join_range_keyed"):
        plan = executed_plan(E.queries()[key](spark, medium_dir))
        assert "NestedLoopJoin" not in plan, key


def test_projection_reaches_scan(spark, medium_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = executed_plan(E.queries()["filter_rows"](spark, medium_dir))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "EqualTo(o_orderstatus,F)" in plan


def test_top_k_plans(spark, medium_dir):
    assert "TakeOrderedAndProject" in executed_plan(E.queries()["arrange_limit"](spark, medium_dir))
    assert "WindowGroupLimit" in executed_plan(E.queries()["slice_top"](spark, medium_dir))


def test_rows_are_not_shuffled_on_a_group_key(spark, small_dir):
    """With tables too large to broadcast from static sizes, a counted per-group table still is."""
    from tessera.functions import mathx as M
    from tessera.operators import profile as P
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    try:
        o = spark.read.parquet(f"{small_dir}/orders.parquet")
        for df in (P.outlier_fence(o, "o_orderpriority", "o_totalprice"), P.box_summary(o, "o_orderpriority", "o_totalprice"),
                   M.scale_by_group(o, "o_totalprice", "o_orderpriority")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
