"""Filters of keys, and tables cut off from their lineage."""

from pyspark.sql import functions as F

from lagwise.llm import common


def test_a_filter_of_keys_loses_none_and_rules_most_out(spark):
    df = spark.range(20_000).select((F.col("id") % 7000).alias("k"), "id", F.lit("x").alias("cell"))
    keys = spark.range(0, 7000, 100).select(F.col("id").alias("k"))
    for bits in (1 << 20, 1 << 16, 8):  # of the last, every bit is set: the join alone decides
        got = common.among(df, keys, "k", bits)
        assert got.columns == df.columns
        assert sorted(r["id"] for r in got.collect()) == [i for i in range(20_000) if i % 7000 % 100 == 0]
    filtered = common.key_filter(keys, "k")
    assert sum(len(r["bitmap"]) for r in filtered.collect()) <= common.FILTER_BITS // 8
    assert common.among(df, keys.limit(0), "k").count() == 0 and common.among(df.limit(0), keys, "k").count() == 0


def test_rows_with_null_keys_match_nothing(spark):
    df = spark.createDataFrame([(None,), (1,)], "k long")
    assert [r["k"] for r in common.among(df, df, "k").collect()] == [1]


def test_rows_without_keys_stay_and_are_not_shuffled(spark):
    """Also where the keys are too many to be broadcast; columns may be called as the filter's are."""
    df = spark.range(20_000).select((F.col("id") % 7000).alias("k"), "id", F.lit("x").alias("cell"), F.lit("y").alias("seen"))
    keys = spark.createDataFrame([(k,) for k in range(0, 7000, 100)] * 2, "k long")
    want = [i for i in range(20_000) if i % 7000 % 100]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bits, most in ((1 << 20, 2000), (8, None)):  # of 8 bits every one is set: the join alone decides
            got = common.without(df, keys, "k", bits)
            assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == want
            assert most is None or shuffled_rows(got) <= most
        assert common.without(df, keys.limit(0), "k").count() == 20_000 and common.without(df.limit(0), keys, "k").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled_rows(df) -> int:
    df.collect()
    plans, rows = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        kind, made, children = plan.getClass().getSimpleName(), plan.metrics().get("shuffleRecordsWritten"), plan.children()
        rows += made.get().value() if made.isDefined() else 0
        plans += [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [children.apply(i) for i in range(children.size())]
    return rows
