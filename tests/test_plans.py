"""Shapes of physical plans."""
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
# these run jobs while they are built, or only read back what they wrote
EAGER = ("stm", "rol", "tun1", "gbt", "snk", "src", "res1_two")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_cross_or_nested_loop_join(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_scan_reads_only_used_columns(spark):
    p = plan(QUERIES["agg1_by_hour"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in p


def test_filters_reach_the_scan(spark):
    p = plan(QUERIES["fil12_high_waits"](spark, SF))
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,200.0), LessThanOrEqual(value,300.0)]" in p


def test_latest_rows_are_cut_before_the_shuffle(spark):
    p = plan(QUERIES["win16_latest_rows"](spark, SF))
    assert "WindowGroupLimit" in p and p.index("Final") < p.index("Exchange") < p.index("Partial")


def test_gap_filling_shuffles_readings_once_after_the_grid(spark):
    from slotwise.operators import fill
    from slotwise.sources.stand_ins import Tables

    t = Tables(spark, SF)
    base = plan(t.grid5).count("Exchange hashpartitioning")
    once = plan(fill.fill_gaps(t.grid5, "ride_name", "timestamp", "wait_time", "closed"))
    # rows and visiting readings both come from the grid; only the bucket shuffle is new
    assert "collect_list" in once and once.count("Exchange hashpartitioning") <= 2 * base + 1


def test_rows_are_not_shuffled_for_statistics_per_key(spark):
    """The broadcast threshold is below the size of the rows, so only a measured small side can be shipped."""
    from pyspark.sql import functions as F

    from slotwise.operators import enrich, explore, features, models

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        d = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_suppkey", "l_quantity", "l_tax")
        assert "SortMergeJoin" in plan(d.join(d.groupBy("l_suppkey").agg(F.avg("l_tax")), "l_suppkey"))
        for out in (
            features.standardise(d, "l_suppkey", ["l_quantity"]), enrich.add_group_stat(d, ["l_suppkey"], {"m": F.avg("l_quantity")}),
            explore.iqr_outliers(d, "l_suppkey", "l_quantity"), models.interval(d, d, "l_suppkey", "l_quantity", "l_tax"),
        ):
            p = plan(out)
            assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_all_baselines_in_few_shuffles(spark):
    d = QUERIES["bas10_all_baselines"](spark, SF)
    d.collect()
    final = plan(d).split("== Initial Plan ==")[0]
    assert final.count("Exchange ") - final.count("BroadcastExchange ") - final.count("ReusedExchange ") < 20
