"""The ticks of a run that are known, as bitmaps: an exact key set of constant size per page.

A page is a range of 32,768 ticks, so a run is spread over pages, and a look-up or an update
costs as much as the new ticks do, however many there are already.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.plans.spread import uncopied

SCHEMA = "run_id string, page bigint, ticks binary"
# Spark's bitmaps count from 1, ticks from 0.
_PAGE = lambda tick: F.bitmap_bucket_number(tick.cast("bigint") + 1)
_PLACE = lambda tick: F.bitmap_bit_position(tick.cast("bigint") + 1)


def pages(ticks: DataFrame) -> DataFrame:
    """(run_id, page, ticks) of rows (run_id, tick); repeated rows count once."""
    return ticks.groupBy("run_id", _PAGE(F.col("tick")).alias("page")).agg(
        F.bitmap_construct_agg(_PLACE(F.col("tick"))).alias("ticks")
    )


def united(parts: DataFrame) -> DataFrame:
    """One row per (run, page) from several."""
    return parts.groupBy("run_id", "page").agg(F.bitmap_or_agg("ticks").alias("ticks"))


def unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (run_id, tick, ...) whose tick is in no page of ``known``."""
    place = _PLACE(F.col("tick"))
    byte = F.substring("_ticks", F.floor(place / 8).cast("int") + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (place % 8).cast("int")) == 1
    pages_of = known.select("run_id", F.col("page").alias("_page"), F.col("ticks").alias("_ticks"))
    found = rows.withColumn("_page", _PAGE(F.col("tick"))).join(uncopied(pages_of), ["run_id", "_page"], "left")
    return found.filter(F.col("_ticks").isNull() | ~is_set).select(rows.columns)
