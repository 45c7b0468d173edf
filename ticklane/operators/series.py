"""Series of a run for charts, for all runs at once."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklane import constants as c
from ticklane.plans.spread import TICK_SLICE, slice_of


def tick_counts(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("run_id").agg(F.count("*").alias("ticks"))


def points(telemetry: DataFrame) -> DataFrame:
    return telemetry.select("run_id", *c.POINT_FIELDS)


def _check(max_points: int) -> None:
    if not c.MIN_MAX_POINTS <= max_points <= c.MAX_MAX_POINTS:
        raise ValueError(f"max_points must be in [{c.MIN_MAX_POINTS}, {c.MAX_MAX_POINTS}]")


def stride_of(ticks: int, max_points: int) -> int:
    """The stride of a run with so many ticks."""
    _check(max_points)
    return max(1, -(-ticks // max_points))


def every(telemetry: DataFrame, stride: int) -> DataFrame:
    """Points at multiples of a stride."""
    return points(telemetry.filter(F.col("tick") % stride == 0))


def downsample(
    telemetry: DataFrame, max_points: int = c.DEFAULT_MAX_POINTS, size: int = TICK_SLICE
) -> DataFrame:
    """Points whose tick is a multiple of the run's stride.

    The stride comes from the number of ticks, the choice from tick values, so
    gaps in the ticks change how many points remain.
    """
    _check(max_points)
    sliced = points(telemetry).withColumn("slice", slice_of("tick", size))
    # Counted per slice and summed over the run's slices; the ticks then meet their
    # stride by (run, slice), so a long run is not gathered anywhere.
    total = F.sum("n").over(Window.partitionBy("run_id"))
    strides = (
        sliced.groupBy("run_id", "slice")
        .agg(F.count("*").alias("n"))
        .select("run_id", "slice", F.ceil(total / F.lit(max_points)).alias("stride"))
    )
    kept = sliced.join(strides, ["run_id", "slice"]).filter(F.col("tick") % F.col("stride") == 0)
    return kept.select("run_id", *c.POINT_FIELDS)


def in_tick_order(series: DataFrame) -> DataFrame:
    """Global order by run and tick (range partitions, so a long run is split)."""
    return series.orderBy("run_id", "tick")


def speed_series(telemetry: DataFrame) -> DataFrame:
    return telemetry.select("run_id", "tick", "speed")


def lane_series(telemetry: DataFrame) -> DataFrame:
    """Deviation with the upper and lower border of the safe zone."""
    return telemetry.select(
        "run_id",
        "tick",
        "cte",
        F.lit(c.IN_LANE_CTE).alias("upper"),
        F.lit(-c.IN_LANE_CTE).alias("lower"),
    )


def track_path(telemetry: DataFrame) -> DataFrame:
    return telemetry.select("run_id", "tick", "pos_x", "pos_y")
