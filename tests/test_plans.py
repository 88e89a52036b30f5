"""Physical-plan properties that matter at scale, asserted on the executed plans."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from reelspark.operators import splits as sp
from reelspark.sources import testbind as tb


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df) -> str:
    df.collect()  # the frame's own execution, so that the adaptive plan is the one that ran
    p = _plan(df)
    assert "isFinalPlan=true" in p
    return p


def test_top_k_uses_window_group_limit(spark):
    p = _final_plan(E.queries()["recommend_topn"](spark, SF001))
    assert "WindowGroupLimit" in p


def test_latest_rating_is_partial_aggregate_with_pushed_filter(spark):
    df = tb.build_ratings(spark, SF001)
    p = _final_plan(df)
    assert "partial_max" in p                     # map-side combine before the shuffle
    scan = [line for line in p.splitlines() if "FileScan parquet" in line and "lineitem" in line]
    assert scan and all("PushedFilters: [" in line and "l_returnflag" in line for line in scan)


def test_scan_reads_only_needed_columns(spark):
    df = tb.build_watchlist(spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_comment" not in plan


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_no_python_udf_in_registered_plans(spark, name):
    df = E.queries()[name](spark, SF001)
    p = df._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p, f"{name} runs Python in the plan ({node})"


def test_hot_user_positions_are_exact_and_bucketed(spark):
    """One user holds a third of the rows: positions equal the single-window numbering, and the
    only row-level window is partitioned by (user, bucket), not by user alone."""
    import datetime as dt
    rows = [(0, i, 5, dt.date(2020, 1, 1)) for i in range(3000)]
    rows += [(u, i, 5, dt.date(2020, 1, 1)) for u in range(1, 601) for i in range(10)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, my_rating int, rated_at date") \
        .withColumn("k", sp.shuffle_key(42))
    got = sp.position_in_group(df, ["user_id"], sp.md5_bucket(F.col("k")), [F.col("k"), F.col("item_id")])
    ref = df.withColumn("pos2", F.row_number().over(Window.partitionBy("user_id").orderBy("k", "item_id")))
    j = got.join(ref, ["user_id", "item_id"])
    assert j.where(F.col("pos") != F.col("pos2")).count() == 0
    p = _final_plan(got)
    windows = [line for line in p.splitlines() if "Window [row_number()" in line]
    assert windows and all("_bk" in w for w in windows)


def test_materialized_tables_survive_concurrent_first_use(spark, tmp_path):
    """Several threads asking for the same normalised table get one consistent table."""
    from concurrent.futures import ThreadPoolExecutor
    calls = []

    def build():
        calls.append(1)
        return tb.build_watchlist(spark, SF001)

    name = f"concurrency_probe_{tmp_path.name}"
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda _: tb.materialized(spark, SF001, name, build).count(), range(4)))
    assert len(set(counts)) == 1 and counts[0] > 0 and len(calls) == 1


def test_fold_rows_are_shuffled_once_and_without_their_key(spark):
    p = _final_plan(sp.stratified_folds(tb.ratings(spark, SF001), 5, 42)).split("Initial Plan")[0]
    shuffles = [line for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert len([s for s in shuffles if "_bk" in s]) <= 2 and not any("coalesce" in s for s in shuffles)
    key = max(n for n, line in enumerate(p.splitlines()) if "md5" in line and "Project" in line and "_w" in line)
    assert any(n > key for n, line in enumerate(p.splitlines()) if line in shuffles)


def test_ranking_metrics_shuffle_the_joined_rows_once(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _final_plan(E.queries()["metrics_ranking"](spark, SF001)).split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    made = [x for x in p.splitlines() if "Exchange hashpartitioning(item_id" in x and "ReusedExchange" not in x]
    assert 1 <= len(made) <= 2
