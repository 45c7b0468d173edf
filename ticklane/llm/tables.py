"""Small helpers shared by the operators: columns, sized broadcasts, stored steps, samples."""

import ctypes
import gc
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.sources.shared import stored

#: Rows of a side that may be broadcast: ids or short keys, so some tens of MB at most.
BROADCAST_ROWS = 1_000_000
#: Rows that go to a Python worker at a time, unless the session says so: whole texts are large.
ARROW_ROWS = 1_000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sets the session up for Python workers: they get the package, once, if they can't import
    it anyway, and texts in small batches."""
    if spark.conf.get(_ARROW) == "10000":  # Spark's default
        spark.conf.set(_ARROW, ARROW_ROWS)
    package = Path(__file__).resolve().parents[1]
    known = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    if package.parent in (Path(p).resolve() for p in known) or spark.sparkContext.applicationId in _shipped:
        return
    base = os.path.realpath(tempfile.mkdtemp(prefix="ticklane-"))
    archive = shutil.make_archive(os.path.join(base, package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)


def texts(docs: DataFrame, column: str = "text", *keep: str) -> DataFrame:
    """(doc_id, text), plus the columns in keep; a null text becomes empty. Other columns go."""
    ship(docs.sparkSession)
    return docs.select("doc_id", *keep, F.coalesce(F.col(column), F.lit("")).alias("text"))


def sized(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast only if it was counted and is small enough.

    Beyond the limit Spark joins it by a shuffle. The frame should be a stored table,
    as counting runs it.
    """
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def share(key: str, wanted: int, total: int) -> Column:
    """Keeps about wanted of total rows, chosen by a hash of the key; all if there are fewer."""
    parts = 1_000_003
    return F.pmod(F.xxhash64(F.lit(77), F.col(key)), F.lit(parts)) < int(parts * min(1.0, wanted / max(total, 1))) + 1


def tidied(parts: Iterable) -> Iterator:
    """What a task in a Python worker yields; at its end the memory that it needed goes back.

    Workers are kept for later tasks, and what an idle one holds counts with its executor.
    """
    yield from parts
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


__all__ = ["BROADCAST_ROWS", "share", "ship", "sized", "stored", "texts", "tidied"]
