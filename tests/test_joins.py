"""Estimates must not turn exploded rows into broadcasts."""

SF = "/root/testdata/sf0.001"


def test_exploded_rows_are_not_broadcast_on_an_estimate(spark):
    from urbanloom.catalog.registry import queries

    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = queries()["sample_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_threshold_set_by_the_cluster_stays(spark):
    from urbanloom.scale import joins_by_true_size

    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "1MB")
    try:
        joins_by_true_size(spark)
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "1MB"
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
