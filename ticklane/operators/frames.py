"""Camera frames: which ticks have one, and the frame to show at a tick."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklane.constants import FRAME_EVERY_TICKS
from ticklane.plans.spread import TICK_SLICE, slice_of


def frame_ticks(telemetry: DataFrame) -> DataFrame:
    """Ticks at which a frame is saved."""
    return telemetry.filter(F.col("tick") % FRAME_EVERY_TICKS == 0).select("run_id", "tick")


def frame_at(frames: DataFrame, at_tick: int) -> DataFrame:
    """Per run the last frame at or before one tick; runs with none are absent."""
    return (
        frames.filter(F.col("frame_tick") <= at_tick)
        .groupBy("run_id")
        .agg(F.max("frame_tick").alias("frame_tick"))
    )


def frames_asof(
    probes: DataFrame, frames: DataFrame, size: int = TICK_SLICE, unique: bool = False
) -> DataFrame:
    """(run_id, at_tick, frame_tick): the last frame at or before each probed tick.

    frame_tick is null when the run has no frame that early. The answer depends on
    (run_id, at_tick) alone, so each distinct probe gets one row. ``unique`` says that
    neither probes nor frames repeat, which saves a shuffle. Probes and frames are
    lined up in windows over (run, tick slice); a slice starts with the last frame of
    the slices before it.
    """
    rows = (
        probes.select("run_id", F.col("at_tick").alias("tick"), F.lit(1).alias("is_probe"))
        .union(frames.select("run_id", F.col("frame_tick").alias("tick"), F.lit(0)))
        .withColumn("slice", slice_of("tick", size))
    )
    frame = F.when(F.col("is_probe") == 0, F.col("tick"))

    earlier = Window.partitionBy("run_id").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        rows.groupBy("run_id", "slice")
        .agg(F.max(frame).alias("last_frame"))
        .select("run_id", F.max("last_frame").over(earlier).alias("tick"), F.lit(0), "slice")
        .filter("tick is not null")
    )
    # is_probe sorts a frame before a probe of the same tick.
    in_order = Window.partitionBy("run_id", "slice").orderBy("tick", "is_probe").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        (rows if unique else rows.distinct())
        .union(carried)
        .withColumn("frame_tick", F.max(frame).over(in_order))
        .filter("is_probe = 1")
        .select("run_id", F.col("tick").alias("at_tick"), "frame_tick")
    )
