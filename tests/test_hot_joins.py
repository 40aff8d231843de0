"""A key that holds half of all rows is split where an aggregate is joined back."""

import pytest
from pyspark.sql import functions as F

from factlake.operators import aggs, graph, joins
from factlake.plans import skew


@pytest.fixture
def splitting(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark, n=200_000):
    return spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"), (F.col("id") % 7 > 0).alias("flag")
    )


def test_attach_group(spark, splitting):
    df = skew.attach_group(hot_rows(spark), ["k"], F.count("*").alias("n"))
    assert "skew=true" in final_plan(df)
    assert df.filter("k = 0").select("n").distinct().collect() == [(100_000,)]


def test_component_members(spark, splitting):
    comp = hot_rows(spark).select(F.col("v").alias("node"), F.col("k").alias("comp"))
    assert "skew=true" in final_plan(graph.component_members(comp))


def test_resolve_refs(spark, splitting):
    refs = hot_rows(spark).select(F.col("v").alias("ref"), F.col("k").cast("string").alias("name"))
    defs = hot_rows(spark, 1000).select(F.col("v").alias("def"), F.col("k").cast("string").alias("name"))
    hints = spark.createDataFrame([("5", 1)], "name string, target bigint")
    df = joins.resolve_refs(refs, defs, hints, ref_id="ref", def_id="def", match_cols=["name"], hint_key="name")
    assert "skew=true" in final_plan(df)
    assert df.filter("name = '0'").select("status").distinct().collect() == [("ambiguous",)]


def test_groups_of_flags(spark, splitting):
    rows = hot_rows(spark).withColumn("outer", F.col("v") % 3)
    assert "skew=true" in final_plan(aggs.any_of_group(rows, ["outer"], "k", "flag"))
    assert "skew=true" in final_plan(aggs.all_of_group(rows, ["outer"], "k", "flag"))


def test_overlapping_members(spark, splitting):
    rows = hot_rows(spark).select(F.lit(1).alias("grp"), F.col("v").alias("owner"), F.col("k").alias("elem"), F.lit(1).alias("size"))
    df = joins.overlapping_members(rows, group="grp", owner="owner", element="elem", size="size")
    assert "skew=true" in final_plan(df) and df.count() == 100_000


def test_null_keys_match_nothing(spark):
    rows = spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "k bigint, v bigint")
    got = skew.attach_group(rows, ["k"], F.count("*").alias("n")).select("v", "n").collect()
    assert sorted(tuple(r) for r in got) == [(1, None), (2, 2), (3, 2)]
