"""CSV exports with a header taken from the data."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.operators import packets as packet_ops


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames with the sorted union of their columns, gaps as null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.select(*sorted(rows.columns))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files, each with a header; nulls are empty fields."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def sensor_widths(parsed_packets: DataFrame) -> DataFrame:
    """(sensor, width, place): the most values of each sensor that occurs, and its first
    place in a packet, to choose the columns of packet_rows from."""
    return (
        parsed_packets.select(F.posexplode(F.map_entries("sensors")).alias("place", "sensor"))
        .groupBy("sensor.key")
        .agg(F.max(F.size("sensor.value")).alias("width"), F.min("place").alias("place"))
        .select(F.col("key").alias("sensor"), "width", "place")
    )


def packet_rows(parsed_packets: DataFrame, widths: dict[str, int], *keep: str) -> DataFrame:
    """Sensors flattened to columns, then the act_ control columns.

    widths: values per sensor, as the wire format has them. A sensor of width 1 is a column of
    its name; of a wider one, value i is <name>_i, also where a packet has a lone value.
    """
    sensor = lambda name, i: F.get(F.try_element_at("sensors", F.lit(name)), F.lit(i))
    columns = []
    for name, width in widths.items():
        if width == 1:
            columns.append(sensor(name, 0).alias(name))
        else:
            columns += [sensor(name, i).alias(f"{name}_{i}") for i in range(width)]
    acts = [value.alias(name) for name, value in packet_ops.control_columns().items()]
    return parsed_packets.select(*keep, *columns, *acts)
