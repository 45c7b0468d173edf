"""Runs, telemetry and summaries as a function of the whole message log.

Order is always that of ``log_offset``:

- a run exists from its first run_start, which fixes its season and driver;
- of several ticks with the same (run_id, tick), the first after that stays;
- the first run_end after the start closes the run, later ones do not;
- the summary covers the ticks that arrived before the last run_end.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane import constants as c
from ticklane import schemas
from ticklane.operators import kpi, ticksets
from ticklane.plans.spread import OFFSET_SLICE, TICK_SLICE, slice_of, spread_join
from ticklane.sources.shared import stored

_LOG = dict(part.split(" ") for part in schemas.LOG.split(", "))


def known_seasons(starts: DataFrame, seasons: DataFrame) -> DataFrame:
    return starts.join(seasons.select(F.col("id").alias("season_id")), "season_id", "left_semi")


def unknown_seasons(starts: DataFrame, seasons: DataFrame) -> DataFrame:
    return starts.join(seasons.select(F.col("id").alias("season_id")), "season_id", "left_anti")


def run_starts(messages: DataFrame, seasons: DataFrame | None = None) -> DataFrame:
    """One row per run: run_id, season_id, driver, started_at, start_offset."""
    starts = messages.filter(F.col("kind") == c.RUN_START)
    if seasons is not None:
        starts = known_seasons(starts, seasons)
    first = F.min_by(F.struct("season_id", "driver", "log_ts"), "log_offset").alias("first")
    return (
        starts.groupBy("run_id")
        .agg(first, F.min("log_offset").alias("start_offset"))
        .select(
            "run_id",
            F.col("first.season_id").alias("season_id"),
            F.coalesce("first.driver", F.lit(c.DEFAULT_DRIVER)).alias("driver"),
            F.col("first.log_ts").alias("started_at"),
            "start_offset",
        )
    )


def _after_start(
    rows: DataFrame, starts: DataFrame, how: str = "inner", few: bool = False
) -> DataFrame:
    return spread_join(
        rows,
        starts.select("run_id", "start_offset"),
        "run_id",
        slice_of("log_offset", OFFSET_SLICE),
        how,
        copied=few,
    )


def run_ends(messages: DataFrame, starts: DataFrame, few: bool = False) -> DataFrame:
    """One row per closed run: status, ended_at, close_offset, last_end_offset.

    ``few``, here and below: the starts are a stored table of few rows, see ``spread.few``.
    """
    ends = messages.filter(F.col("kind") == c.RUN_END).select(
        "run_id", "status", "log_ts", "log_offset"
    )
    return (
        _after_start(ends, starts, few=few)
        .filter("log_offset > start_offset")
        .groupBy("run_id")
        .agg(
            F.min_by(F.struct("status", "log_ts"), "log_offset").alias("first"),
            F.min("log_offset").alias("close_offset"),
            F.max("log_offset").alias("last_end_offset"),
        )
        .select(
            "run_id",
            F.coalesce("first.status", F.lit(c.DEFAULT_END_STATUS)).alias("status"),
            F.col("first.log_ts").alias("ended_at"),
            "close_offset",
            "last_end_offset",
        )
    )


def first_arrivals(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per (run_id, tick) the row with the lowest log_offset; of several such rows the least.

    Ticks in ``known``, pages of ``ticksets``, are left out; the narrow columns are looked up.

    The lowest offset is a hash aggregate over three narrow columns, so copies are
    reduced before the shuffle; the rows then semi-join it on all three. Rows that share
    the offset too are reduced where the join has placed them.
    """
    place = ["run_id", "tick", "log_offset"]
    first = rows.groupBy("run_id", "tick").agg(F.min("log_offset").alias("log_offset"))
    if known is not None:
        first = ticksets.unknown(first, known)
    rest = F.struct(*[n for n in rows.columns if n not in place])
    least = F.sort_array(F.collect_set(rest))[0].alias("row")
    return rows.join(first, place, "left_semi").groupBy(*place).agg(least).select(*place, "row.*")


def kept_telemetry(
    messages: DataFrame,
    starts: DataFrame,
    columns: Sequence[str] = schemas.TELEMETRY_COLUMNS,
    few: bool = False,
    known: DataFrame | None = None,
) -> DataFrame:
    """The telemetry table, or some of its columns, plus log_offset; without ``known`` ticks."""
    ticks = messages.filter(F.col("kind") == c.TELEMETRY).select("run_id", *columns, "log_offset")
    started = _after_start(ticks, starts, few=few).filter("log_offset > start_offset")
    return first_arrivals(started.drop("start_offset"), known)


def orphan_telemetry(messages: DataFrame, starts: DataFrame, few: bool = False) -> DataFrame:
    """Ticks that arrived before any start of their run."""
    ticks = messages.filter(F.col("kind") == c.TELEMETRY)
    return _after_start(ticks, starts, "left", few).filter(
        "start_offset is null or log_offset < start_offset"
    )


def summaries(kept: DataFrame, ends: DataFrame, size: int = TICK_SLICE) -> DataFrame:
    """run_id and KPI fields for each closed run."""
    cutoffs = ends.select("run_id", "last_end_offset")
    before_end = spread_join(
        kept, cutoffs, "run_id", slice_of("tick", size), keep_slice=True
    ).filter("log_offset < last_end_offset")
    return kpi.report_for(ends.select("run_id"), kpi.slices(before_end, size, placed=True))


def runs_table(starts: DataFrame, ends: DataFrame, summary_rows: DataFrame) -> DataFrame:
    """The runs table; open runs have status running and no summary."""
    summary = summary_rows.select("run_id", F.struct(*schemas.KPI_FIELDS).alias("summary"))
    return (
        starts.join(ends, "run_id", "left")
        .join(summary, "run_id", "left")
        .select(
            F.col("run_id").alias("id"),
            "season_id",
            "driver",
            F.coalesce("status", F.lit(c.OPEN_STATUS)).alias("status"),
            "started_at",
            "ended_at",
            "summary",
        )
    )


def quarantine(
    messages: DataFrame,
    rejected: DataFrame,
    starts: DataFrame,
    seasons: DataFrame | None = None,
    few: bool = False,
) -> DataFrame:
    """The log columns, kind and reason: each rejected message once per reason.

    The message is kept whole (value, key, time, topic partition and offset), so that it can
    be repaired and replayed when the topic has let go of it. ``messages`` conform by
    themselves; some still refer to something unknown.
    """

    def kept(rows: DataFrame, reason) -> DataFrame:
        missing = {n: F.lit(None).cast(k) for n, k in _LOG.items() if n not in rows.columns}
        return rows.withColumns({**missing, "reason": reason}).select(*_LOG, "kind", "reason")

    found = kept(rejected, F.explode("reasons"))
    found = found.unionByName(kept(orphan_telemetry(messages, starts, few), F.lit("unknown:run_id")))
    if seasons is not None:
        lost = unknown_seasons(messages.filter(F.col("kind") == c.RUN_START), seasons)
        found = found.unionByName(kept(lost, F.lit("unknown:season_id")))
    return found


def replay(
    messages: DataFrame, seasons: DataFrame | None = None, size: int = TICK_SLICE
) -> tuple[DataFrame, DataFrame]:
    """(runs, telemetry) from conforming messages.

    ``messages`` is read several times, narrowly; pass a stored table, written by
    ``kind``, so that the marker passes touch only marker files. The telemetry is
    written to the shared folder before it is summarised, so that it is built once.
    """
    starts = run_starts(messages, seasons)
    ends = run_ends(messages, starts)
    kept = stored(kept_telemetry(messages, starts), "telemetry")
    return runs_table(starts, ends, summaries(kept, ends, size)), kept.drop("log_offset")


def replay_runs(
    messages: DataFrame, seasons: DataFrame | None = None, size: int = TICK_SLICE
) -> DataFrame:
    """The runs alone: of telemetry only the columns of the KPI report are read."""
    starts = run_starts(messages, seasons)
    ends = run_ends(messages, starts)
    kept = kept_telemetry(messages, starts, kpi.COLUMNS)
    return runs_table(starts, ends, summaries(kept, ends, size))
