"""Text sensor packets such as ``(angle 0.1)(track 1 2 3)``."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane import constants as c
from ticklane.functions.numbers import double_sql, words_sql
from ticklane.operators.features import clamp
from ticklane.plans.once import with_computed
from ticklane.plans.spread import OFFSET_SLICE, slice_of, spread_join


def parsed(packets: DataFrame) -> DataFrame:
    """Add sensors, MAP<STRING, ARRAY<DOUBLE>>; of a repeated key the last counts."""
    pattern = F.lit(c.PACKET_PATTERN)
    found = with_computed(packets, "_keys", F.regexp_extract_all("msg", pattern, F.lit(1)))
    found = found.withColumn("_texts", F.regexp_extract_all("msg", pattern, F.lit(2)))
    sensors = F.expr(
        "map_from_entries(transform(filter(arrays_zip(_keys, _texts), "
        "(p, i) -> i = size(_keys) - array_position(reverse(_keys), p._keys)), "
        f"p -> struct(p._keys, transform({words_sql('p._texts')}, t -> {double_sql('t')}))))"
    )
    return with_computed(found, "sensors", sensors).drop("_keys", "_texts")


def is_stop(msg: Column) -> Column:
    stop = F.lit(False)
    for mark in c.STOP_MARKS:
        stop = stop | msg.contains(mark)
    return stop


def drive_packets(
    packets: DataFrame, log: str = "log_id", order: str = "pkt_id", size: int = OFFSET_SLICE
) -> DataFrame:
    """Sensor packets of each log before its first stop, handshakes left out."""
    msg = F.col("msg")
    stops = packets.groupBy(log).agg(
        F.min(F.when(is_stop(msg), F.col(order))).alias("_stop")
    )
    return (
        spread_join(packets, stops, log, slice_of(order, size))
        .filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
        .filter(~msg.contains(c.HANDSHAKE_MARK))
        .drop("_stop")
    )


def conforming(parsed_packets: DataFrame) -> DataFrame:
    """Packets in which every value is a number."""
    return parsed_packets.filter(~_has_gap(F.col("sensors")))


def rejected(parsed_packets: DataFrame) -> DataFrame:
    return parsed_packets.filter(_has_gap(F.col("sensors")))


def _has_gap(sensors: Column) -> Column:
    return F.exists(F.map_values(sensors), lambda v: F.exists(v, lambda x: x.isNull()))


def scalar(name: str, sensors: str = "sensors") -> Column:
    return F.get(F.try_element_at(sensors, F.lit(name)), F.lit(0))


def control_columns() -> dict[str, Column]:
    """The rule-based driver's answer to a packet."""
    speed = scalar("speedX")
    steer = (scalar("angle") - scalar("trackPos") * F.lit(c.TRACK_GAIN)) / F.lit(c.STEER_LOCK)
    gear = F.lit(1) + F.floor(speed / F.lit(c.SPEED_PER_GEAR))
    return {
        "act_accel": F.when(speed < F.lit(c.TARGET_SPEED), c.ACCEL_BELOW_TARGET).when(
            speed.isNotNull(), 0.0
        ),
        "act_brake": F.lit(0.0),
        "act_gear": F.when(
            speed.isNotNull(), F.greatest(F.lit(c.MIN_GEAR), F.least(F.lit(c.MAX_GEAR), gear))
        ).cast("int"),
        "act_steer": clamp(steer, -1.0, 1.0),
    }


def controls(parsed_packets: DataFrame) -> DataFrame:
    return parsed_packets.select(
        "*", *[value.alias(name) for name, value in control_columns().items()]
    )
