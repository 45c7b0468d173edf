"""Season and run queries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane import constants as c
from ticklane import schemas
from ticklane.plans.spread import TICK_SLICE, slice_of, spread_join

#: Place of runs without a start time, after all others.
NO_START = -(2**62)


def season_rows(seasons: DataFrame) -> DataFrame:
    return seasons.select(*schemas.SEASON_COLUMNS)


def run_rows(runs: DataFrame) -> DataFrame:
    return runs.select(*[name for name in schemas.RUN_COLUMNS if name in runs.columns])


def season_by_id(seasons: DataFrame, season_id: str) -> DataFrame:
    return seasons.filter(F.col("id") == season_id)


def run_by_ids(runs: DataFrame, season_id: str, run_id: str) -> DataFrame:
    return runs.filter((F.col("id") == run_id) & (F.col("season_id") == season_id))


def telemetry_of(telemetry: DataFrame, run_id: str) -> DataFrame:
    return telemetry.filter(F.col("run_id") == run_id)


def seasons_with_driver(seasons: DataFrame, runs: DataFrame, driver: str) -> DataFrame:
    """Seasons that have a run by this driver; the season's own driver is not asked."""
    with_run = (
        runs.filter(F.col("driver") == driver).select(F.col("season_id").alias("id")).distinct()
    )
    return seasons.join(with_run, "id", "left_semi")


def _positions(runs: DataFrame) -> DataFrame:
    """Runs with position, from 0 for the newest of their season; ties go to the higher id.

    Runs are placed by (season, hour of start), so that a hot season is no single window;
    only the numbers of runs per hour are added up across a season.
    """
    hour = F.coalesce(F.expr("unix_micros(started_at) div 3600000000"), F.lit(NO_START))
    placed = runs.withColumn("_hour", hour)
    later = Window.partitionBy("season_id").orderBy(F.desc("_hour")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    newer = (
        placed.groupBy("season_id", "_hour")
        .agg(F.count("*").alias("_n"))
        .select("season_id", "_hour", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_newer"))
    )
    within = Window.partitionBy("season_id", "_hour").orderBy(F.desc("started_at"), F.desc("id"))
    counted = placed.withColumn("_rank", F.row_number().over(within) - 1)
    return (
        counted.join(newer, ["season_id", "_hour"])
        .withColumn("position", F.col("_rank") + F.col("_newer"))
        .drop("_hour", "_rank", "_newer")
    )


def season_detail(seasons: DataFrame, runs: DataFrame) -> DataFrame:
    """Seasons with their runs, one row per run, and one row for a season without any.

    Columns: those of the season, position (0 for the newest run) and the run's as
    run_<name>; position and run columns are null in a season without runs.
    """
    named = _positions(runs).select(
        F.col("season_id").alias("id"),
        "position",
        *[F.col(n).alias(f"run_{n}") for n in runs.columns if n != "season_id"],
    )
    return seasons.join(named, "id", "left")


def season_with_runs(seasons: DataFrame, runs: DataFrame, season_id: str) -> DataFrame:
    """One season as a request for it is answered: its runs nested, newest first."""
    entry = F.struct("started_at", *[n for n in ("id", *runs.columns) if n != "started_at"])
    own = runs.filter(F.col("season_id") == season_id).select(entry.alias("run"))
    nested = own.agg(F.sort_array(F.collect_list("run"), asc=False).alias("runs"))
    nested = nested.select(F.lit(season_id).alias("id"), "runs")
    return season_by_id(seasons, season_id).join(nested, "id")


def runs_of(runs: DataFrame, season_id: str) -> DataFrame:
    return newest_first(runs.filter(F.col("season_id") == season_id))


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy("season_id", F.desc("started_at"), F.desc("id"))


def newest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each season, the one shown first. Ties go to the higher id.

    The latest start is a hash aggregate over two narrow columns; only runs that started
    then are looked at whole.
    """
    latest = runs.groupBy(F.col("season_id").alias("_season")).agg(F.max("started_at").alias("_latest"))
    at_last = runs.join(
        latest,
        runs.season_id.eqNullSafe(F.col("_season")) & runs.started_at.eqNullSafe(F.col("_latest")),
        "left_semi",
    )
    higher = Window.partitionBy("season_id").orderBy(F.desc("id"))
    return at_last.withColumn("_rank", F.row_number().over(higher)).filter("_rank = 1").drop("_rank")


def orphan_runs(runs: DataFrame, seasons: DataFrame) -> DataFrame:
    """Runs whose season does not exist."""
    return runs.join(seasons.select(F.col("id").alias("season_id")), "season_id", "left_anti")


def orphan_ticks(telemetry: DataFrame, runs: DataFrame, size: int = TICK_SLICE) -> DataFrame:
    """Ticks whose run does not exist."""
    known = runs.select(F.col("id").alias("run_id"), F.lit(True).alias("_known"))
    return (
        spread_join(telemetry, known, "run_id", slice_of("tick", size), "left")
        .filter(F.col("_known").isNull())
        .drop("_known")
    )


def cascade(
    doomed: DataFrame, runs: DataFrame, telemetry: DataFrame, size: int = TICK_SLICE
) -> tuple[DataFrame, DataFrame]:
    """(runs, telemetry) that go when the seasons in ``doomed`` (id) are deleted."""
    gone_runs = runs.join(doomed.select(F.col("id").alias("season_id")), "season_id", "left_semi")
    gone_ticks = spread_join(
        telemetry, gone_runs.select(F.col("id").alias("run_id")), "run_id", slice_of("tick", size)
    )
    return gone_runs, gone_ticks


def survivors(
    doomed: DataFrame, runs: DataFrame, telemetry: DataFrame, size: int = TICK_SLICE
) -> tuple[DataFrame, DataFrame]:
    """(runs, telemetry) that stay: what a rewrite of the tables would keep."""
    gone_runs = runs.join(doomed.select(F.col("id").alias("season_id")), "season_id", "left_semi")
    kept_runs = runs.join(doomed.select(F.col("id").alias("season_id")), "season_id", "left_anti")
    marked = gone_runs.select(F.col("id").alias("run_id"), F.lit(True).alias("_gone"))
    kept_ticks = (
        spread_join(telemetry, marked, "run_id", slice_of("tick", size), "left")
        .filter(F.col("_gone").isNull())
        .drop("_gone")
    )
    return kept_runs, kept_ticks


def enriched(
    telemetry: DataFrame, runs: DataFrame, seasons: DataFrame, size: int = TICK_SLICE
) -> DataFrame:
    """Ticks with run and season attributes, along season -> run -> tick."""
    dims = runs.join(seasons.withColumnRenamed("id", "season_id"), "season_id").select(
        F.col("id").alias("run_id"),
        "season_id",
        runs["driver"].alias("driver"),
        "status",
        "track_id",
        "os",
    )
    ticks = telemetry.drop("season_id")
    return spread_join(ticks, dims, "run_id", slice_of("tick", size))


def kpi_cards(runs: DataFrame) -> DataFrame:
    """The four cards of a run as text; a dash where there is no summary."""
    s = F.col("summary")

    def card(value: Column) -> Column:
        return F.coalesce(F.when(s.isNotNull(), value.cast("string")), F.lit(c.MISSING_CARD))

    return runs.select(
        F.col("id").alias("run_id"),
        card(F.concat(_plain(s["pct_in_lane"]), F.lit("%"))).alias("pct_in_lane"),
        card(_plain(s["avg_speed"])).alias("avg_speed"),
        card(s["collisions"]).alias("collisions"),
        card(s["laps"]).alias("laps"),
    )


def _plain(x: Column) -> Column:
    """A number of up to three decimals as text, without trailing zeros."""
    return F.call_function("format_number", x, F.lit("0.###"))


def short_id(identifier: str) -> Column:
    return F.substring(identifier, 1, c.SHORT_ID_LENGTH)


def _utc(timestamp: str, form: str) -> Column:
    """A time as text in UTC, whatever the session's time zone."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), F.col(timestamp).cast("timestamp_ntz")), form)


def run_labels(runs: DataFrame) -> DataFrame:
    return runs.select(
        "id",
        short_id("id").alias("short_id"),
        F.concat_ws(
            c.LABEL_SEPARATOR, "driver", "status", _utc("started_at", "HH:mm:ss")
        ).alias("label"),
    )


def season_labels(seasons: DataFrame) -> DataFrame:
    return seasons.select(
        "id",
        short_id("id").alias("short_id"),
        F.concat_ws(
            c.LABEL_SEPARATOR, _utc("created_at", "yyyy-MM-dd HH:mm:ss"), "track_id"
        ).alias("label"),
    )
