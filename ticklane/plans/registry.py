"""The queries of this library over data derived from the supplied tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane import constants as c
from ticklane import schemas
from ticklane.operators import (
    catalog,
    decode,
    features,
    frames,
    kpi,
    packets,
    records,
    replay,
    series,
)
from ticklane.plans import derive
from ticklane.sources import csvfiles, framefiles, kafka, logfiles, rawzone, shared
from ticklane.streaming import ingest, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def epoch(timestamp: str) -> Column:
    """Timestamps leave as epoch seconds."""
    return (F.unix_micros(timestamp) / F.lit(1000000.0)).alias(timestamp)


def lap_text(lap_times: Column) -> Column:
    texts = F.transform(
        lap_times, lambda t: F.call_function("format_number", t, F.lit("0.0"))
    )
    return F.array_join(texts, ",").alias("lap_times")


def _flat_report(rows: DataFrame) -> DataFrame:
    others = [name for name in rows.columns if name != "lap_times"]
    return rows.select(*others, lap_text(F.col("lap_times")))


# --- KPI -------------------------------------------------------------------


@query
def kpi_report(spark, sf_dir):
    return _flat_report(kpi.report(derive.telemetry(spark, sf_dir)))


@query
def kpi_basic(spark, sf_dir):
    return kpi.basics(derive.telemetry(spark, sf_dir))


@query
def kpi_duration(spark, sf_dir):
    return kpi.basics(derive.telemetry(spark, sf_dir)).select("run_id", "duration_s")


@query
def kpi_pct_in_lane(spark, sf_dir):
    return kpi.basics(derive.telemetry(spark, sf_dir)).select("run_id", "ticks", "pct_in_lane")


@query
def kpi_cte_speed(spark, sf_dir):
    return kpi.basics(derive.telemetry(spark, sf_dir)).select(
        "run_id", "mean_abs_cte", "max_abs_cte", "avg_speed", "max_speed"
    )


@query
def kpi_laps(spark, sf_dir):
    return kpi.basics(derive.telemetry(spark, sf_dir)).select("run_id", "laps")


@query
def collisions(spark, sf_dir):
    return kpi.report(derive.telemetry(spark, sf_dir)).select("run_id", "collisions")


@query
def offtrack_events(spark, sf_dir):
    return kpi.report(derive.telemetry(spark, sf_dir)).select("run_id", "offtrack_events")


@query
def lap_times(spark, sf_dir):
    return kpi.lap_rows(derive.telemetry(spark, sf_dir))


@query
def empty_run_report(spark, sf_dir):
    """Reports for one run per customer; most of them never drove."""
    wanted = derive.table(spark, sf_dir, "customer").select(
        derive.padded(derive.RUN_PREFIX, F.col("c_custkey")).alias("run_id")
    )
    return _flat_report(kpi.report_for(wanted, kpi.slices(derive.telemetry(spark, sf_dir))))


# --- series ----------------------------------------------------------------


@query
def run_tick_counts(spark, sf_dir):
    return series.tick_counts(derive.telemetry(spark, sf_dir))


@query
def telemetry_points(spark, sf_dir):
    return series.points(derive.telemetry(spark, sf_dir))


@query
def downsample_10(spark, sf_dir):
    return series.in_tick_order(series.downsample(derive.telemetry(spark, sf_dir), 10))


@query
def downsample_1000(spark, sf_dir):
    return series.in_tick_order(series.downsample(derive.telemetry(spark, sf_dir), 1000))


@query
def speed_series(spark, sf_dir):
    return series.speed_series(derive.telemetry(spark, sf_dir))


@query
def cte_series_band(spark, sf_dir):
    return series.lane_series(derive.telemetry(spark, sf_dir))


@query
def track_path(spark, sf_dir):
    return series.in_tick_order(series.track_path(derive.telemetry(spark, sf_dir)))


# --- seasons and runs ------------------------------------------------------


@query
def season_rows(spark, sf_dir):
    rows = catalog.season_rows(derive.seasons(spark, sf_dir))
    return rows.select(
        "id",
        "user_id",
        "os",
        "sdk_version",
        "simulator_version",
        "track_id",
        F.variant_get("car_config", "$.body", "string").alias("car_body"),
        "driver",
        epoch("created_at"),
        epoch("updated_at"),
    )


@query
def seasons_by_driver(spark, sf_dir):
    return catalog.seasons_with_driver(
        derive.seasons(spark, sf_dir), derive.runs(spark, sf_dir), "rl"
    ).select("id", "track_id", "driver")


@query
def season_detail(spark, sf_dir):
    detail = catalog.season_detail(
        derive.seasons(spark, sf_dir).select("id", "track_id", "driver"), derive.runs(spark, sf_dir)
    )
    times = {n: epoch(n) for n in ("run_started_at", "run_ended_at")}
    return detail.withColumns(times)


@query
def season_by_id(spark, sf_dir):
    wanted = derive.SEASON_PREFIX + "000000000007"
    return catalog.season_by_id(derive.seasons(spark, sf_dir), wanted).select("id", "track_id", "driver")


@query
def run_by_ids(spark, sf_dir):
    rows = catalog.run_by_ids(
        derive.runs(spark, sf_dir), derive.SEASON_PREFIX + "000000000003", derive.RUN_PREFIX + "000000000013"
    )
    return rows.select("id", "season_id", "driver", "status", epoch("started_at"), epoch("ended_at"))


@query
def telemetry_of_run(spark, sf_dir):
    """One run from a stored table whose files are in the order of such requests."""
    rows = catalog.telemetry_of(derive.stored_telemetry(spark, sf_dir), derive.RUN_PREFIX + "000000000013")
    return rows.select("run_id", "tick", "ts", "speed", "cte", "hit", "lap_count", "terminated")


@query
def season_runs(spark, sf_dir):
    rows = catalog.run_rows(catalog.newest_first(derive.runs(spark, sf_dir)))
    return rows.select(
        "season_id", "id", "driver", "status", epoch("started_at"), epoch("ended_at")
    )


@query
def newest_run(spark, sf_dir):
    return catalog.newest_runs(derive.runs(spark, sf_dir)).select(
        "season_id", "id", "status", epoch("started_at")
    )


@query
def orphan_runs(spark, sf_dir):
    return catalog.orphan_runs(
        derive.runs(spark, sf_dir), derive.seasons(spark, sf_dir)
    ).select("id", "season_id")


@query
def orphan_ticks(spark, sf_dir):
    """Ticks of runs that were never registered: every twentieth is left out here."""
    known = derive.runs(spark, sf_dir).filter(derive.run_number("id") % 20 != 3)
    return catalog.orphan_ticks(derive.telemetry(spark, sf_dir), known).select("run_id", "tick")


def _doomed(spark, sf_dir):
    return derive.seasons(spark, sf_dir).filter(F.col("driver") == "rl").select("id")


@query
def cascade_set(spark, sf_dir):
    runs, ticks = catalog.cascade(
        _doomed(spark, sf_dir), derive.runs(spark, sf_dir), derive.telemetry(spark, sf_dir)
    )
    gone = runs.select(F.lit("run").alias("kind"), F.col("id").alias("run_id"), F.lit(-1).alias("tick"))
    return gone.unionByName(ticks.select(F.lit("tick").alias("kind"), "run_id", "tick"))


@query
def cascade_survivors(spark, sf_dir):
    runs, ticks = catalog.survivors(
        _doomed(spark, sf_dir), derive.runs(spark, sf_dir), derive.telemetry(spark, sf_dir)
    )
    kept = runs.select(F.lit("run").alias("kind"), F.col("id").alias("run_id"), F.lit(-1).alias("tick"))
    return kept.unionByName(ticks.select(F.lit("tick").alias("kind"), "run_id", "tick"))


@query
def run_enriched(spark, sf_dir):
    return catalog.enriched(
        derive.telemetry(spark, sf_dir).select("run_id", "tick", "speed", "cte"),
        derive.runs(spark, sf_dir),
        derive.seasons(spark, sf_dir),
    )


@query
def run_labels(spark, sf_dir):
    return catalog.run_labels(derive.runs(spark, sf_dir))


@query
def season_labels(spark, sf_dir):
    return catalog.season_labels(derive.seasons(spark, sf_dir))


@query
def driver_backfill(spark, sf_dir):
    old = derive.seasons(spark, sf_dir).withColumn(
        "driver", F.when(F.col("driver") == "rl", F.col("driver"))
    )
    return decode.backfill_driver(old).select("id", "driver")


@query
def season_conformance(spark, sf_dir):
    """Part rows as season input: names, brands and types of any length."""
    part = derive.table(spark, sf_dir, "part")
    given = part.select(
        "p_partkey",
        F.col("p_brand").alias("os"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")).alias("sdk_version"),
        F.col("p_type").alias("simulator_version"),
        F.repeat("p_name", F.lit(6)).alias("track_id"),
        F.when(F.col("p_size") % 3 == 0, "rl").when(F.col("p_size") % 3 == 1, "random").otherwise(
            "human"
        ).alias("driver"),
    )
    return decode.season_problems(given).select(
        "p_partkey", F.array_join("reasons", ",").alias("reasons")
    )


# --- frames ----------------------------------------------------------------


@query
def frame_cadence(spark, sf_dir):
    return frames.frame_ticks(derive.telemetry(spark, sf_dir))


@query
def frame_floor(spark, sf_dir):
    return frames.frame_at(derive.frames(spark, sf_dir), 42)


@query
def frame_asof(spark, sf_dir):
    """The frame to show at each tick, with its path below the frame root."""
    probes = derive.telemetry(spark, sf_dir).select("run_id", F.col("tick").alias("at_tick"))
    # (run_id, tick) is the key of both tables.
    found = frames.frames_asof(probes, derive.frames(spark, sf_dir), unique=True)
    season = derive.season_of(derive.run_number())
    return found.withColumn("season_id", season).select(
        "run_id", "at_tick", "frame_tick", framefiles.frame_path().alias("path")
    )


@query
def frame_names(spark, sf_dir):
    return derive.frames(spark, sf_dir).select(
        "run_id", "frame_tick", framefiles.frame_name().alias("name")
    )


# --- message log -----------------------------------------------------------


def _messages(spark, sf_dir):
    return derive.messages(spark, sf_dir)


def _starts(spark, sf_dir):
    good = decode.conforming(_messages(spark, sf_dir))
    return good, replay.run_starts(good, derive.seasons(spark, sf_dir))


@query
def log_type_counts(spark, sf_dir):
    return decode.type_counts(_messages(spark, sf_dir))


@query
def quarantine(spark, sf_dir):
    """Rejected messages; whole tells that the text is that of the log."""
    good, starts = _starts(spark, sf_dir)
    bad = decode.rejected(_messages(spark, sf_dir))
    found = replay.quarantine(good, bad, starts, derive.seasons(spark, sf_dir))
    sent = derive.log(spark, sf_dir).select("log_offset", F.col("value").alias("sent"))
    return found.join(sent, "log_offset").select(
        "log_offset", "kind", "reason", epoch("log_ts"), "key", (F.col("value") == F.col("sent")).alias("whole")
    )


@query
def replay_runs(spark, sf_dir):
    good, starts = _starts(spark, sf_dir)
    return (
        starts.join(replay.run_ends(good, starts), "run_id", "left")
        .select(
            "run_id",
            "season_id",
            "driver",
            F.coalesce("status", F.lit(c.OPEN_STATUS)).alias("status"),
            epoch("started_at"),
            epoch("ended_at"),
        )
    )


@query
def replay_telemetry(spark, sf_dir):
    good, starts = _starts(spark, sf_dir)
    return replay.kept_telemetry(good, starts).select(
        "run_id", "tick", "ts", "speed", "cte", "hit", "lap_count", "terminated"
    )


@query
def replay_summary(spark, sf_dir):
    good, starts = _starts(spark, sf_dir)
    ends = replay.run_ends(good, starts)
    kept = replay.kept_telemetry(good, starts, kpi.COLUMNS)
    return _flat_report(replay.summaries(kept, ends))


@query
def kpi_cards(spark, sf_dir):
    good = decode.conforming(_messages(spark, sf_dir))
    return catalog.kpi_cards(replay.replay_runs(good, derive.seasons(spark, sf_dir)))


# --- features --------------------------------------------------------------


def _spread_vector(name: str, column: str) -> list[Column]:
    return [F.col(column)[i].alias(f"{name}_{part}") for i, part in enumerate(features.STATE_NAMES)]


@query
def state_vector(spark, sf_dir):
    rows = features.state_vectors(derive.telemetry(spark, sf_dir))
    return rows.select("run_id", "tick", *_spread_vector("s", "state"))


@query
def shaped_reward(spark, sf_dir):
    return features.shaped_rewards(derive.telemetry(spark, sf_dir))


@query
def action(spark, sf_dir):
    return features.actions(derive.telemetry(spark, sf_dir)).select(
        "run_id",
        "tick",
        F.col("action")[0].alias("steering"),
        F.col("action")[1].alias("throttle"),
    )


@query
def transitions(spark, sf_dir):
    rows = features.transitions(derive.telemetry(spark, sf_dir))
    return rows.select(
        "run_id",
        "tick",
        *_spread_vector("s", "state"),
        F.col("action")[0].alias("a_steering"),
        F.col("action")[1].alias("a_throttle"),
        "reward",
        *_spread_vector("n", "next_state"),
        "done",
    )


# --- text packets ----------------------------------------------------------


def _parsed(spark, sf_dir):
    return packets.parsed(packets.drive_packets(derive.packets(spark, sf_dir)))


@query
def packet_parse(spark, sf_dir):
    track = F.col("sensors")["track"]
    return packets.conforming(_parsed(spark, sf_dir)).select(
        "log_id",
        "pkt_id",
        packets.scalar("angle").alias("angle"),
        packets.scalar("trackPos").alias("trackpos"),
        packets.scalar("speedX").alias("speedx"),
        *[track[i].alias(f"track_{i}") for i in range(3)],
        packets.scalar("gear").alias("gear"),
    )


@query
def packet_controls(spark, sf_dir):
    return packets.controls(_parsed(spark, sf_dir)).select(
        "log_id", "pkt_id", "act_accel", "act_brake", "act_gear", "act_steer"
    )


# --- records ---------------------------------------------------------------


@query
def record_defaults(spark, sf_dir):
    rows = records.build_records(derive.info_records(spark, sf_dir))
    return rows.select(
        *[n for n in rows.columns if n not in ("info", "bad_fields")],
        F.size("bad_fields").alias("n_bad"),
    )


@query
def vector_component(spark, sf_dir):
    rows = records.with_variant(derive.info_records(spark, sf_dir))
    return rows.select(
        "event_id",
        *[
            records.component(F.col("_info"), "gyro", i).alias(f"gyro_{axis}")
            for i, axis in enumerate(records.AXES)
        ],
    )


@query
def flatten_vectors(spark, sf_dir):
    ticks = derive.telemetry(spark, sf_dir).select(
        "run_id",
        "tick",
        F.array("pos_x", "pos_y", "pos_z").alias("pos"),
        F.array("vel_x", "vel_y", "vel_z").alias("vel"),
        "speed",
    )
    return records.flatten_arrays(ticks, {"pos": 3, "vel": 3})


@query
def flatten_fields(spark, sf_dir):
    return records.flatten_fields(derive.info_records(spark, sf_dir), "event_id")


@query
def flatten_wide(spark, sf_dir):
    long = records.flatten_fields(derive.info_records(spark, sf_dir), "event_id")
    return records.widen(long, "event_id", derive.INFO_FIELDS)


# --- sources and sinks -----------------------------------------------------


@query
def raw_zone_roundtrip(spark, sf_dir):
    path = shared.new_path(spark, "rawzone")
    rawzone.append(derive.telemetry(spark, sf_dir), path)
    return rawzone.scan(spark, path).select(
        "season_id", "run_id", "tick", "ts", "speed", "cte", "hit", "lap_count", "terminated"
    )


@query
def topic_roundtrip(spark, sf_dir):
    """Published messages written as JSON lines, read back and decoded."""
    path = shared.new_path(spark, "topic")
    ticks = derive.telemetry(spark, sf_dir)
    records_out = ticks.select(
        F.lit(c.TELEMETRY).alias("type"), "season_id", "run_id", *schemas.TELEMETRY_COLUMNS
    )
    kafka.publish_to_files(records_out, path)
    back = spark.read.schema("key string, value string").json(path)
    return decode.conforming(decode.decode(back)).select(
        "key", "season_id", "run_id", "tick", "ts", "speed"
    )


@query
def csv_union_export(spark, sf_dir):
    ticks = derive.telemetry(spark, sf_dir)
    rows = csvfiles.union_columns([series.speed_series(ticks), series.track_path(ticks)])
    path = shared.new_path(spark, "csv-union")
    csvfiles.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query
def csv_packet_export(spark, sf_dir):
    rows = packets.conforming(_parsed(spark, sf_dir))
    flat = csvfiles.packet_rows(rows, derive.PACKET_SENSORS, "log_id", "pkt_id")
    path = shared.new_path(spark, "csv-packets")
    csvfiles.write_csv(flat, path)
    back = spark.read.schema(flat.schema).option("header", True).csv(path)
    return back.select(*[F.col(n).alias(n.lower()) for n in back.columns])


# --- streaming -------------------------------------------------------------

#: Batches of each round; the stream is restarted in between. Buckets for one machine.
ROUNDS, STREAM_BUCKETS = (2, 1), 16
_stream_roots: dict[tuple[str, str], str] = {}


def _streamed(spark, sf_dir) -> str:
    """Root of tables that took in the log in rounds, with a restart after each.

    The stream runs once per session and table folder, for all queries on it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stream_roots:
        _stream_roots[key] = _run_stream(spark, sf_dir)
    return _stream_roots[key]


def _run_stream(spark, sf_dir) -> str:
    log = derive.log(spark, sf_dir)
    root = shared.new_path(spark, "stream")
    first, highest = log.agg(F.min("log_offset"), F.max("log_offset")).first()
    if first is None:
        tables.create(spark, f"{root}/tables")
        return f"{root}/tables"
    step = (highest - first) // sum(ROUNDS) + 1
    for batches in ROUNDS:
        end = first + batches * step
        logfiles.write_log(log.filter(F.col("log_offset").between(first, end - 1)), f"{root}/log")
        first = end
        ingest.catch_up(
            logfiles.stream_log(spark, f"{root}/log", f"{root}/checkpoint", step),
            f"{root}/tables",
            f"{root}/checkpoint",
            read_seasons=lambda session: derive.seasons(session, sf_dir),
            buckets=STREAM_BUCKETS,
        )
    return f"{root}/tables"


@query
def stream_runs(spark, sf_dir):
    runs = tables.current_runs(spark, _streamed(spark, sf_dir))
    return _flat_report(
        runs.select(
            F.col("id").alias("run_id"),
            "season_id",
            "driver",
            "status",
            epoch("started_at"),
            epoch("ended_at"),
            "summary.*",
        )
    )


@query
def stream_telemetry(spark, sf_dir):
    return tables.current_telemetry(spark, _streamed(spark, sf_dir)).select(
        "run_id", "tick", "ts", "speed", "cte", "hit", "lap_count", "terminated"
    )


@query
def stream_counts(spark, sf_dir):
    """Messages per kind and, in the last batch's running total, altogether."""
    root = _streamed(spark, sf_dir)
    kinds = tables.read(spark, root, "counts").groupBy("kind").agg(
        F.sum("messages").alias("messages")
    )
    total = tables.batch_totals(spark, root).agg(F.max("total").alias("messages"))
    return kinds.unionByName(total.select(F.lit("all").alias("kind"), "messages"))


@query
def live_series(spark, sf_dir):
    return tables.live_series(spark, _streamed(spark, sf_dir), derive.RUN_PREFIX + "000000000013", 10)
