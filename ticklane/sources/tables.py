"""Stored tables."""

from pyspark.sql import DataFrame, SparkSession

from ticklane import schemas

_DDL = {
    "seasons": schemas.SEASONS,
    "runs": schemas.RUNS,
    "telemetry": schemas.TELEMETRY,
    "log": schemas.LOG,
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(_DDL[name]).parquet(f"{root}/{name}")


def write_telemetry(telemetry: DataFrame, root: str) -> None:
    """Files cover narrow (run_id, tick) ranges, so that a request for one run
    skips most of them. The range shuffle also splits a very long run."""
    ordered = telemetry.repartitionByRange("run_id", "tick").sortWithinPartitions("run_id", "tick")
    ordered.write.mode("overwrite").parquet(f"{root}/telemetry")
