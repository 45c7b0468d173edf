"""Continuous ingest: the log as a stream, the tables kept up to date.

Each micro-batch applies the batch replay rules to its own messages and to the state that
earlier batches left: runs, a KPI summary per tick slice, and the set of known ticks. It
reads and rewrites the buckets of its runs, never the ticks of earlier batches, except
those of a slice into which a late tick falls. The state is in the tables, so a batch that is
repeated after a failure gives the same result, and a restart goes on from the checkpoint.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ticklane import constants as c
from ticklane import schemas
from ticklane.operators import decode, kpi, replay, ticksets
from ticklane.plans.spread import TICK_SLICE, few, slice_of, spread_join, uncopied
from ticklane.sources import paths
from ticklane.streaming import tables

SeasonsReader = Callable[[SparkSession], DataFrame]
_SLICE = ["run_id", "_slice"]


def touched_buckets(spark: SparkSession, root: str, run_ids: DataFrame) -> list[int]:
    """Buckets that hold these runs: at most as many numbers as buckets."""
    bucket = tables.run_bucket(F.col("run_id"), tables.buckets_of(spark, root))
    return sorted(r["b"] for r in run_ids.select(bucket.alias("b")).distinct().collect())


def ingest_batch(
    batch: DataFrame, batch_id: int, root: str, read_seasons: SeasonsReader | None = None
) -> None:
    """Store one micro-batch of log rows.

    What several steps need is written below ``<root>/work`` and read from there, so that each
    step is a small plan and a lost executor repeats little. No step copies a table to every task
    that grows with the runs or ticks: the driver would have to hold it.
    """
    spark = batch.sparkSession
    work = f"{root}/work/batch_id={batch_id}"

    def held(rows: DataFrame, name: str, *partition_by: str) -> DataFrame:
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{work}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{work}/{name}")

    messages = held(decode.decode(batch), "messages", "kind")
    seasons = read_seasons(spark) if read_seasons else None
    good = decode.conforming(messages)
    before = tables.snapshot(spark, root, batch_id)
    here = touched_buckets(spark, root, good)

    known = tables.read_state(spark, root, "runs", before, here)
    started = (
        replay.run_starts(good, seasons)
        .join(uncopied(known.select("run_id")), "run_id", "left_anti")
        .withColumn("status", F.lit(c.OPEN_STATUS))
    )
    runs = held(known.unionByName(started, allowMissingColumns=True), "runs")
    small = few(runs)  # then no tick has to move to meet its run
    per_run = (lambda rows: rows) if small else uncopied
    runs = per_run(runs)
    pages = tables.read_state(spark, root, "pages", before, here)
    new = replay.kept_telemetry(good, runs, few=small, known=pages)
    tables.append(new, root, "telemetry", batch_id)
    ticks = tables.read_batch(spark, root, batch_id, here)
    tables.replace_state(ticksets.united(pages.unionByName(ticksets.pages(ticks))), root, "pages", batch_id)

    ends = per_run(held(replay.run_ends(good, runs, small), "ends"))
    slices = tables.read_state(spark, root, "slices", before, here)
    scored = counted(ticks, ends, small)
    parts = held(kpi.slices(scored, apart=["counted"]), "parts")
    late = overlapping(slices, parts)
    if late.isEmpty():
        now, then = _joined(slices, parts), _joined(slices, parts.filter("counted"))
    else:
        late = held(late, "late")
        late = F.broadcast(late) if few(late) else uncopied(late)
        stored = tables.read(spark, root, "telemetry", before).filter(F.col("run_bucket").isin(here))
        stored = stored.select("run_id", *kpi.COLUMNS, F.lit(True).alias("counted"))
        now = _again(slices, parts, late, stored.unionByName(scored))
        then = _again(slices, parts.filter("counted"), late, stored.unionByName(scored.filter("counted")))
    tables.replace_state(now, root, "slices", batch_id)
    summary = kpi.report_for(ends.select("run_id"), then.join(ends.select("run_id"), "run_id", "left_semi"))
    tables.replace_state(new_runs(runs, ends, per_run(held(summary, "summary"))), root, "runs", batch_id)

    bad = replay.quarantine(good, decode.rejected(messages), runs, seasons, small)
    tables.append(bad, root, "quarantine", batch_id)
    tables.append(decode.type_counts(messages), root, "counts", batch_id)
    tables.commit(spark, root, batch_id, before, here)
    paths.remove(spark, work)


def counted(ticks: DataFrame, ends: DataFrame, few: bool = False) -> DataFrame:
    """Ticks of this batch; counted tells that a run_end of the batch comes after them.

    A summary is of all ticks of earlier batches and of these. ``few``: so are the ends.
    """
    rows = ticks.select("run_id", *kpi.COLUMNS, "log_offset")
    cutoffs = ends.select("run_id", "last_end_offset")
    rows = spread_join(rows, cutoffs, "run_id", slice_of("tick", TICK_SLICE), "left", copied=few)
    before = F.coalesce(F.col("log_offset") < F.col("last_end_offset"), F.lit(False))
    return rows.select("run_id", *kpi.COLUMNS, before.alias("counted"))


def overlapping(slices: DataFrame, parts: DataFrame) -> DataFrame:
    """The (run, slice) pairs into whose stored range a new tick falls: they can't be merged."""
    ranges = [x.filter("first_tick is not null").select(*_SLICE, "first_tick", "last_tick") for x in (slices, parts)]
    so_far = Window.partitionBy(*_SLICE).orderBy("first_tick", "last_tick").rowsBetween(Window.unboundedPreceding, -1)
    both = ranges[0].join(uncopied(parts.select(*_SLICE).distinct()), _SLICE, "left_semi").unionByName(ranges[1])
    high = both.withColumn("high", F.max("last_tick").over(so_far))
    return high.filter("high >= first_tick").select(*_SLICE).distinct()


def _joined(slices: DataFrame, parts: DataFrame) -> DataFrame:
    return kpi.merged(slices.unionByName(parts.drop("counted")))


def _again(slices: DataFrame, parts: DataFrame, late: DataFrame, ticks: DataFrame) -> DataFrame:
    """Slices of ``late`` from all their ticks, the others from what is stored and the parts."""
    placed = ticks.drop("counted").withColumn("_slice", slice_of("tick", TICK_SLICE))
    again = kpi.slices(placed.join(late, _SLICE, "left_semi"), placed=True)
    rest = slices.unionByName(parts.drop("counted")).join(late, _SLICE, "left_anti")
    return kpi.merged(rest).unionByName(again)


def new_runs(runs: DataFrame, ends: DataFrame, summary: DataFrame) -> DataFrame:
    """The runs of the touched buckets after this batch."""
    ends = ends.select(
        "run_id",
        F.col("status").alias("end_status"),
        F.col("ended_at").alias("end_time"),
        F.col("close_offset").alias("end_offset"),
    )
    summary = summary.select("run_id", F.struct(*schemas.KPI_FIELDS).alias("new_summary"))
    changed = runs.join(ends, "run_id", "left").join(summary, "run_id", "left")
    # Only an open run is closed; the summary is renewed in any case.
    closes = F.col("close_offset").isNull()
    close = lambda new, old: F.when(closes, F.coalesce(new, old)).otherwise(F.col(old))
    return changed.select(
        "run_id",
        "season_id",
        "driver",
        close("end_status", "status").alias("status"),
        "started_at",
        close("end_time", "ended_at").alias("ended_at"),
        "start_offset",
        close("end_offset", "close_offset").alias("close_offset"),
        F.coalesce("new_summary", "summary").alias("summary"),
    )


def let_go(spark: SparkSession) -> None:
    """Free what the jobs of a batch have left on the driver.

    Spark drops copied tables and shuffles when the driver's garbage is collected. A driver whose heap
    is mostly idle does that late, so its heap would grow from batch to batch up to its bound.
    """
    spark._jvm.System.gc()


def start(
    log: DataFrame,
    root: str,
    checkpoint: str,
    read_seasons: SeasonsReader | None = None,
    interval: str = c.BATCH_INTERVAL,
    buckets: int = tables.RUN_BUCKETS,
) -> StreamingQuery:
    """Start ingesting a streaming log into the tables under ``root``.

    The checkpoint moves on only after a batch is stored.
    """
    tables.create(log.sparkSession, root, buckets)

    def store(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, root, read_seasons)
        let_go(batch.sparkSession)

    return (
        log.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )


def catch_up(log: DataFrame, root: str, checkpoint: str, **options) -> None:
    """Ingest what is there, in batches of the size that the log's bound gives, and stop."""
    query = start(log, root, checkpoint, interval="0 seconds", **options)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
