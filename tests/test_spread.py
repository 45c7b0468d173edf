"""Sliced building blocks against plain windows and joins, with one hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticklane.plans import spread


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = [("hot", t, float(t % 17)) for t in rng.sample(range(-50, 400), 300)]
    data += [(f"k{i}", t, float(i)) for i in range(20) for t in rng.sample(range(100), 5)]
    return spark.createDataFrame(data, "k string, t int, v double")


def as_set(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_neighbours(rows, size):
    got = spread.with_neighbours(rows, "k", "t", ["v"], ["t", "v"], size)
    w = Window.partitionBy("k").orderBy("t")
    expected = rows.select(
        "k", "t", "v",
        F.lag("v").over(w).alias("prev_v"),
        F.lead("t").over(w).alias("next_t"),
        F.lead("v").over(w).alias("next_v"),
    )
    assert as_set(got.select(expected.columns)) == as_set(expected)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_running_totals(rows, size):
    got = spread.running_totals(rows, "k", "t", {"n": F.lit(1), "s": F.col("v")}, size)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    expected = rows.select(
        "k", "t", "v", F.count("*").over(w).alias("n"), F.sum("v").over(w).alias("s")
    )
    assert as_set(got.select(expected.columns)) == as_set(expected)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join(spark, rows, how):
    dim = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "k string, d int")
    got = spread.spread_join(rows, dim, "k", spread.slice_of("t", 5), how)
    expected = rows.join(dim, "k", how)
    assert as_set(got.select(expected.columns)) == as_set(expected)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_a_copied_dimension_moves_no_facts(spark, rows, how):
    dim = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "k string, d int")
    got = spread.spread_join(rows, dim, "k", spread.slice_of("t", 5), how, keep_slice=True, copied=True)
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()
    expected = rows.join(dim, "k", how).withColumn("_slice", spread.slice_of("t", 5))
    assert as_set(got.select(expected.columns)) == as_set(expected)
    assert spread.few(dim, 3) and not spread.few(dim, 2)


def test_hot_key_is_spread(spark, rows):
    """No shuffle of raw rows is by the key alone."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        dim = spark.createDataFrame([("hot", 1)], "k string, d int")
        joined = spread.spread_join(rows, dim, "k", spread.slice_of("t", 5))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        top = plan[: plan.index("HashAggregate")]
        assert "hashpartitioning(k" in top and "slice" in top
        parts = spark.conf.get("spark.sql.shuffle.partitions")
        placed = rows.withColumn("slice", spread.slice_of("t", 5)).repartition(
            int(parts), "k", "slice"
        )
        sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 250  # of 300 rows of the hot key and 100 others
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
