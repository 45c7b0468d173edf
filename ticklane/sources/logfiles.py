"""The message log in files, and a streaming source over them that counts messages.

``<root>/rows/append=<id>`` holds the rows of one append as Parquet files that cover ranges of
log_offset, written in parallel; ``<root>/index/<n>.json`` lists these files with their first and
last offset and number of rows, and is written last. The source ``ticklane_log`` reads the index,
so it takes in whole appends in offset order, at most so many offsets (messages, where there are
no gaps) a batch, and a task per range of a file. Ranges are sized by rows, and files
have small row groups, so that a task reads little besides its range.
"""

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ticklane import constants as c
from ticklane import schemas
from ticklane.sources import paths

NAME = "ticklane_log"
#: Messages of a range that one task reads, about, and bytes of a row group.
RANGE, GROUP_BYTES = 10_000, 2 << 20


def write_log(log: DataFrame, root: str) -> None:
    """Append log rows. Their offsets have to be higher than those of earlier appends.

    Files come from range partitions of the offset; of each, one row of four values
    reaches the driver. Columns of a log row that are not there are null.
    """
    spark = log.sparkSession
    kinds = dict(part.split(" ") for part in schemas.LOG.split(", "))
    missing = {n: F.lit(None).cast(k) for n, k in kinds.items() if n not in log.columns}
    folder = f"{root}/rows/append={uuid.uuid4().hex}"
    rows = log.withColumns(missing).select(*kinds).filter("log_offset is not null")
    placed = rows.repartitionByRange("log_offset").sortWithinPartitions("log_offset")
    placed.write.option("parquet.block.size", GROUP_BYTES).parquet(folder)
    files = spark.read.schema(schemas.LOG).parquet(folder).groupBy(F.col("_metadata.file_path").alias("file"))
    ranges = files.agg(F.min("log_offset").alias("first"), F.max("log_offset").alias("last"), F.count("*").alias("rows"))
    found = [[r["file"], r["first"], r["last"], r["rows"]] for r in ranges.orderBy("first").collect()]
    number = len(paths.names(spark, f"{root}/index"))
    paths.write_text(spark, f"{root}/index/{number:09d}.json", json.dumps(found))


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all finished appends."""
    index = [json.loads(paths.read_text(spark, f"{root}/index/{n}")) for n in paths.names(spark, f"{root}/index")]
    folders = {os.path.dirname(file) for files in index for file, *_ in files}
    return spark.read.schema(schemas.LOG).parquet(*folders) if folders else spark.createDataFrame([], schemas.LOG)


def stream_log(
    spark: SparkSession, root: str, checkpoint: str, messages: int = c.BATCH_MESSAGES, per_task: int = RANGE
) -> DataFrame:
    """The log as a stream. ``checkpoint`` is that of the query, which a restart goes on from."""
    spark.dataSource.register(LogSource)
    options = {"path": root, "checkpoint": checkpoint, "messages": str(messages), "perTask": str(per_task)}
    return spark.readStream.format(NAME).options(**options).load()


class LogSource(DataSource):
    """Options: path, checkpoint, messages (offsets a batch), perTask (messages a task, about)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return schemas.LOG

    def streamReader(self, schema) -> "LogReader":
        return LogReader(self.options)


class OffsetRange(InputPartition):
    """Rows of a file with first <= log_offset < end."""

    def __init__(self, file: str, first: int, end: int):
        self.file, self.first, self.end = file, first, end


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{os.path.abspath(path)}")


class LogReader(DataSourceStreamReader):
    """Offsets are {"next": the lowest offset not yet taken in}."""

    def __init__(self, options: dict):
        self.path, self.checkpoint = options["path"], options["checkpoint"]
        self.messages, self.per_task = int(options["messages"]), int(options["perTask"])
        self.at: int | None = None
        self.files: list[tuple[str, int, int, int]] = []
        self.indexed = 0

    def _refresh(self) -> None:
        """Read index files that are new since the last time."""
        from pyarrow import fs

        files, folder = _open(f"{self.path}/index")
        listed = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = sorted(x.path for x in listed if x.path.endswith(".json"))
        for name in names[self.indexed :]:
            with files.open_input_stream(name) as stream:
                found = json.loads(stream.readall())
            # An index of before rows were counted: as if there were no gaps.
            self.files += [(file, first, last, *(rows or [last - first + 1])) for file, first, last, *rows in found]
        self.indexed = len(names)

    def _planned(self) -> int | None:
        """The end of the last batch that the query has planned, as its checkpoint says."""
        from pyarrow import fs

        files, folder = _open(f"{self.checkpoint}/offsets")
        listed = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        batches = {int(x.base_name): x.path for x in listed if x.base_name.isdigit()}
        if not batches:
            return None
        with files.open_input_stream(batches[max(batches)]) as stream:
            return json.loads(stream.readall().decode().strip().split("\n")[-1])["next"]

    def initialOffset(self) -> dict:
        self._refresh()
        return {"next": self.files[0][1] if self.files else 0}

    def latestOffset(self) -> dict:
        self._refresh()
        if self.at is None:
            planned = self._planned()
            self.at = self.initialOffset()["next"] if planned is None else planned
        ahead = [max(first, self.at) for _, first, last, _ in self.files if last >= self.at]
        if not ahead:
            return {"next": self.at}
        end = max(last for _, _, last, _ in self.files) + 1
        return {"next": min(ahead[0] + self.messages, end)}  # a gap in the offsets is skipped

    def partitions(self, start: dict, end: dict) -> list[OffsetRange]:
        self._refresh()
        low, high = start["next"], end["next"]
        self.at = max(self.at or high, high)
        ranges = []
        for file, first, last, rows in self.files:
            width = max(1, self.per_task * (last + 1 - first) // rows)
            for at in range(max(first, low), min(last + 1, high), width):
                ranges.append(OffsetRange(file, at, min(at + width, last + 1, high)))
        return ranges

    def read(self, partition: OffsetRange):
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, path = _open(partition.file)
        wanted = [("log_offset", ">=", partition.first), ("log_offset", "<", partition.end)]
        kinds = [part.split(" ")[0] for part in schemas.LOG.split(", ")]
        rows = pq.read_table(path, filesystem=files, columns=kinds, filters=wanted, coerce_int96_timestamp_unit="us")
        place = rows.schema.get_field_index("log_ts")
        rows = rows.set_column(place, "log_ts", rows.column(place).cast(pa.timestamp("us", "UTC")))
        yield from rows.to_batches()
