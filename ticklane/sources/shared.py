"""Where intermediate tables are written."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local session."""
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="ticklane-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(frame: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts lineage."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
