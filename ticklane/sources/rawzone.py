"""Raw zone: telemetry as JSON lines, appended per season, and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane import constants as c
from ticklane import schemas

_RECORD = [name.split(" ")[0] for name in schemas.TELEMETRY.split(", ")]


def append(telemetry: DataFrame, path: str) -> None:
    """Append records under ``season_id=<id>``; markers are not part of the zone."""
    records = telemetry.select(F.lit(c.TELEMETRY).alias("type"), "season_id", *_RECORD)
    records.write.mode("append").partitionBy("season_id").json(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Records with season_id; a filter on it reads only the season's files."""
    ddl = f"type string, {schemas.TELEMETRY}, season_id string"
    return spark.read.schema(ddl).json(path)
