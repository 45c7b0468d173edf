"""Evaluating an expensive expression once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Like withColumn, for values that later steps use several times.

    The optimizer may copy a column's expression into every filter and projection
    above it. It does not look through a generator, so the value comes from one.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))
