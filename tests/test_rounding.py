import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticklane.functions.rounding import py_round


def _check(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 3):
        for row in frame.select("x", py_round("x", digits).alias("y")).collect():
            assert row.y == round(row.x, digits), (row.x, digits)


def test_hard_values(spark):
    base = [0.05, 0.0005, 0.15, 0.25, 12.25, 12.35, 2.675, 0.95, 1e-9, 0.0, 1e15, 123456789.0625]
    ties = [k / 2000 for k in range(1, 400, 2)] + [k / 20 for k in range(1, 400, 2)]
    near = [math.nextafter(t, math.inf) for t in ties] + [math.nextafter(t, 0) for t in ties]
    _check(spark, [s * v for v in base + ties + near for s in (1, -1)])


def test_many_random_values(spark):
    rng = random.Random(5)
    _check(spark, [rng.uniform(-500, 500) for _ in range(5000)])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12), min_size=50, max_size=200))
def test_any_values(spark, values):
    _check(spark, values)


def test_not_numbers(spark):
    row = spark.range(1).select(
        py_round("double('nan')", 1).alias("nan"),
        py_round("double('-inf')", 3).alias("inf"),
        py_round("cast(null as double)", 3).alias("null"),
    ).first()
    assert math.isnan(row.nan) and row.inf == -math.inf and row["null"] is None
    assert pytest.approx(12.3) == spark.range(1).select(py_round("12.35D", 1)).first()[0]
    assert spark.range(1).select(F.round(F.lit(12.35), 1)).first()[0] == 12.4
