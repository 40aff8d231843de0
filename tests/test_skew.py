"""Sliced windows give the same rows as plain ones."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factlake.plans import skew
from tests.helpers import rows, table


@pytest.fixture
def log(spark):
    rnd = random.Random(1)
    data = [(0 if rnd.random() < 0.6 else rnd.randrange(1, 20), rnd.randrange(9), i, rnd.choice([None, i])) for i in range(300)]
    data += [(None, 1, 1000 + i, i) for i in range(20)]
    return table(spark, data, "k bigint, t bigint, id bigint, v bigint")


def _window():
    return Window.partitionBy("k").orderBy("t", "id")


def _check(got, log, expected):
    want = log.withColumn("out", expected)
    assert rows(got, "k", "id", "out") == rows(want, "k", "id", "out")


def test_slices_are_used(log, hot):
    parts = skew.slice_groups(log, ["k"], ["t", "id"])
    assert parts.df.filter("k = 0").select("_slice").distinct().count() > 1
    assert parts.df.count() == log.count()


def test_small_groups_are_not_cut(spark, hot):
    parts = skew.slice_groups(spark.range(3000).selectExpr("id", "id div 3 AS k"), ["k"], ["id"])
    assert parts.cut is None
    assert parts.df.filter("_slice <> 0").isEmpty()


def test_groups_within_groups_share_a_shuffle(spark, hot):
    some = spark.range(3000).selectExpr("id", "id div 30 AS k", "id % 2 AS f")
    once = skew.next_value(some, ["k"], ["id"], F.col("id"), "a", nullable=False)
    twice = skew.next_value(once, ["k", "f"], ["id"], F.col("id"), "b", nullable=False)
    assert twice._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = some.filter("id % 30 < 28").selectExpr("id", "id + 1 AS a", "id + 2 AS b")
    assert rows(twice.filter("b IS NOT NULL"), "id", "a", "b") == rows(want, "id", "a", "b")


def test_running_sum(log, hot):
    before = _window().rowsBetween(Window.unboundedPreceding, -1)
    got = skew.running_sum(log, ["k"], ["t", "id"], F.col("id"), "out")
    _check(got, log, F.coalesce(F.sum("id").over(before), F.lit(0)))


def test_previous_value(log, hot):
    before = _window().rowsBetween(Window.unboundedPreceding, -1)
    got = skew.previous_value(log, ["k"], ["t", "id"], F.col("v"), "out")
    _check(got, log, F.last("v", ignorenulls=True).over(before))


def test_next_value(log, hot):
    got = skew.next_value(log, ["k"], ["t", "id"], F.col("id"), "out")
    _check(got, log, F.lead("id").over(_window()))


def test_attach_group(log, hot):
    got = skew.attach_group(log, ["k"], F.count(F.lit(1)).alias("out"))
    want = F.when(F.col("k").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("k")))
    _check(got, log, want)


def test_global_row_number(log):
    got = skew.global_row_number(log, [F.col("t").desc(), "id"], "out")
    ordered = [r["id"] for r in got.orderBy("out").collect()]
    want = [r["id"] for r in log.orderBy(F.col("t").desc(), "id").collect()]
    assert ordered == want
    assert rows(got, "out") == [(i,) for i in range(1, len(want) + 1)]


def test_no_cluster_without_checkpoint_folder(spark, monkeypatch):
    from factlake.plans import scratch

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        scratch.scratch_root(Session())
