"""Camera frames on disk: ``<root>/<season>/runs/<run>/frames/<tick>.jpg``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATH = r"/([^/]+)/runs/([^/]+)/frames/([^/]*)\.jpg$"


def scan_frames(spark: SparkSession, root: str) -> DataFrame:
    """(season_id, run_id, frame_tick, path); names that are no tick are skipped.

    Only paths are selected, so file contents are never read.
    """
    path = F.col("path")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.jpg")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )
    stem = F.regexp_extract(path, _PATH, 3)
    return files.filter(stem.rlike(r"^\d+$")).select(
        F.regexp_extract(path, _PATH, 1).alias("season_id"),
        F.regexp_extract(path, _PATH, 2).alias("run_id"),
        stem.try_cast("int").alias("frame_tick"),
        "path",
    ).filter("frame_tick is not null")


def frame_name(tick: str = "frame_tick"):
    """File name of a tick: six digits, more when needed."""
    return F.format_string("%06d.jpg", F.col(tick))


def frame_path(season: str = "season_id", run: str = "run_id", tick: str = "frame_tick"):
    """Path of a frame's file below the root; null where there is no frame."""
    return F.when(
        F.col(tick).isNotNull(),
        F.concat(F.col(season), F.lit("/runs/"), F.col(run), F.lit("/frames/"), frame_name(tick)),
    )
