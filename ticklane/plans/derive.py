"""Driving data derived from the supplied tables.

The supplied tables hold no telemetry, so each user of ``events`` becomes a run
and each event a tick. Derived tables are written once per session and table
folder, and the queries read them from there as they would read stored ones.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane import schemas
from ticklane.operators import decode
from ticklane.plans.spread import TICK_SLICE, running_totals, slice_of, spread_join
from ticklane.sources import tables
from ticklane.sources.shared import new_path, stored

EVENT_SLICE = 262_144
RUN_PREFIX = "00000000-0000-4000-a000-"
SEASON_PREFIX = "00000000-0000-4000-b000-"
UNKNOWN_SEASON = SEASON_PREFIX + "999999999999"

#: What the derived records and packets hold, as a wire format states it.
INFO_FIELDS = ["cte", "gyro", "gyro_0", "gyro_1", "gyro_2", "hit", "lap_count", "pos_0", "pos_1", "speed"]
PACKET_SENSORS = {"angle": 1, "trackPos": 1, "speedX": 1, "track": 3, "gear": 1}

_written: dict[tuple[str, str, str], DataFrame] = {}


def _once(name: str, spark: SparkSession, sf_dir: str, make, *partition_by: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = stored(make(spark, sf_dir), name, *partition_by)
    return _written[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.format_string("%012d", number.cast("bigint")))


def run_number(run_id: str = "run_id") -> Column:
    return F.substring(run_id, len(RUN_PREFIX) + 1, 12).cast("int")


def season_of(run: Column) -> Column:
    return padded(SEASON_PREFIX, run % 10)


def _make_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = running_totals(
        table(spark, sf_dir, "events"),
        "user_id",
        "event_id",
        {"seen": F.lit(1), "laps": F.when(F.col("event_type") == "signup", 1).otherwise(0)},
        EVENT_SLICE,
    ).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    value, k, zero = F.col("value"), F.col("k"), F.lit(0.0)
    side = F.when(k % 2 == 1, -1).otherwise(1)
    is_error, is_lap = F.col("event_type") == "error", F.col("event_type") == "signup"
    fields = {
        "tick": F.col("seen") - 1,
        "ts": F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0),
        "steering": ((F.col("event_id") % 241) - 120) / F.lit(100.0),
        "throttle": F.lit(0.3),
        "speed": value / F.lit(9.7),
        "forward_vel": value / F.lit(11.3),
        # no negative zero, whose sign not every engine keeps
        "cte": F.when(value == 50.0, 0.0).otherwise(side * (value - F.lit(50.0)) / F.lit(37.0)),
        "pos_x": value,
        "pos_y": k,
        "vel_x": value / F.lit(3.0),
        "vel_z": k / F.lit(7.0),
        "gyro_z": (k - 50) / F.lit(100.0),
        "hit": F.when(~is_error, "none").when(k % 2 == 0, "pole").otherwise("cone"),
        "reward": value / F.lit(100.0),
        "lap_count": F.col("laps") % 4,
        "last_lap_time": F.when(is_lap & (k % 10 != 0), value).otherwise(zero),
        "terminated": is_error & (k > 95),
    }
    return events.select(
        (F.col("event_id") + 1).alias("arrival"),
        season_of(F.col("user_id")).alias("season_id"),
        padded(RUN_PREFIX, F.col("user_id")).alias("run_id"),
        *[
            fields.get(name, zero).cast(kind).alias(name)
            for name, kind in schemas.TELEMETRY_FIELDS
        ],
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with arrival (the order of all events), season_id and run_id."""
    return _once("telemetry", spark, sf_dir, _make_telemetry)


def stored_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stored table, laid out for requests for one run."""
    key = (spark.sparkContext.applicationId, sf_dir, "tables")
    if key not in _written:
        root = new_path(spark, "tables")
        tables.write_telemetry(telemetry(spark, sf_dir).select("run_id", *schemas.TELEMETRY_COLUMNS), root)
        _written[key] = tables.read_table(spark, root, "telemetry")
    return _written[key]


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    number = F.col("n_nationkey")
    created = F.timestamp_seconds(F.lit(1704067200) + number * 3600)
    return nation.select(
        padded(SEASON_PREFIX, number).alias("id"),
        F.lit(None).cast("string").alias("user_id"),
        F.when(number % 2 == 0, "windows").otherwise("linux").alias("os"),
        F.lit("1.0").alias("sdk_version"),
        F.lit("22.11").alias("simulator_version"),
        F.concat(F.lit("track-"), F.col("n_regionkey").cast("string")).alias("track_id"),
        F.parse_json(F.concat(F.lit('{"body":"'), F.col("n_name"), F.lit('"}'))).alias(
            "car_config"
        ),
        F.when(number % 3 == 0, "rl").otherwise("random").alias("driver"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def _make_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = (
        telemetry(spark, sf_dir)
        .groupBy("run_id", "season_id")
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    n = run_number()
    return spans.select(
        F.col("run_id").alias("id"),
        F.when(n % 50 == 7, UNKNOWN_SEASON).otherwise(F.col("season_id")).alias("season_id"),
        F.when(n % 3 == 0, "rl").otherwise("random").alias("driver"),
        F.when(n % 4 == 0, "running").when(n % 4 == 1, "crashed").otherwise("completed").alias(
            "status"
        ),
        F.timestamp_micros(F.round(F.col("first_ts") * 1000000).cast("bigint")).alias(
            "started_at"
        ),
        F.when(
            n % 4 != 0, F.timestamp_micros(F.round(F.col("last_ts") * 1000000).cast("bigint"))
        ).alias("ended_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("runs", spark, sf_dir, _make_runs)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, frame_tick): every fifth tick, with holes."""
    ticks = telemetry(spark, sf_dir)
    return ticks.filter((F.col("tick") % 5 == 0) & (F.col("pos_y") % 3 != 0)).select(
        "run_id", F.col("tick").alias("frame_tick")
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text sensor packets: (log_id, pkt_id, msg), one log per thousand orders.

    Every third log is stopped late in it, by either of the two marks.
    """
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    log = F.floor(order / 1000)
    two = lambda n: F.format_string("%02d", n.cast("bigint"))
    text = lambda n: n.cast("string")
    sensors = F.concat(
        F.lit("(angle 0."), two(cust % 100),
        F.lit(")(trackPos "), F.when(order % 2 == 0, "-").otherwise(""), F.lit("0."),
        two(order % 100),
        F.lit(")(speedX "), text(order % 300),
        F.lit(")(track "), text(cust % 200), F.lit(" "), text(order % 200), F.lit(" 7)"),
        F.when(order % 9 == 4, F.concat(F.lit("(angle 0."), two(order % 90), F.lit(")"))).otherwise(
            ""
        ),
        F.lit("(gear 1)"),
    )
    mark = (
        F.when(order % 1000 == 0, "***identified***")
        .when((order % 1000 == 930) & (log % 6 == 1), "***shutdown***")
        .when((order % 1000 == 930) & (log % 6 == 4), "***restart***")
        .otherwise(sensors)
    )
    return table(spark, sf_dir, "orders").select(
        text(log).alias("log_id"),
        order.alias("pkt_id"),
        mark.alias("msg"),
    )


def info_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, info): simulator records as JSON, with varying fields."""
    e = F.col("event_id")
    text = lambda n: n.cast("string")
    info = (
        F.when(
            e % 4 == 0,
            F.concat(
                F.lit('{"gyro":[1,2,'), text(e % 100), F.lit('],"speed":'), text(e % 30),
                F.lit(',"pos":['), text(e % 7), F.lit(",0.5],"), F.lit('"lap_count":'),
                text(e % 3), F.lit("}"),
            ),
        )
        .when(
            e % 4 == 1,
            F.concat(F.lit('{"gyro":{"x":1,"y":2,"z":'), text(e % 100), F.lit('},"cte":-1.25}')),
        )
        .when(e % 4 == 2, F.lit("{}"))
        .otherwise(F.lit('{"gyro":"bad","hit":"pole"}'))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", info.alias("info"), (e % 1000).alias("tick"), e.cast("double").alias("ts"),
        (e % 3 - 1).alias("steering"), F.lit(0.3).alias("throttle"), F.col("value").alias("reward"),
        (F.col("event_type") == "error").alias("terminated"),
    )


# --- message log -----------------------------------------------------------


def _record(kind: str, **changed: Column) -> Column:
    names = ["season_id", "run_id", *schemas.TELEMETRY_COLUMNS]
    fields = [F.lit(kind).alias("type")]
    fields += [changed.get(n, F.col(n)).alias(n) for n in names if changed.get(n, n) is not None]
    return F.to_json(F.struct(*fields))


def _marker(kind: str, **extra: Column) -> Column:
    fields = [F.lit(kind).alias("type")]
    fields += [extra.pop(n, F.col(n)).alias(n) for n in ("season_id", "run_id")]
    fields += [value.alias(name) for name, value in extra.items()]
    return F.to_json(F.struct(*fields))


def _make_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = telemetry(spark, sf_dir)
    last = ticks.groupBy("run_id").agg(F.max("tick").alias("last_tick"))
    # Ends of runs are found from the last tick; the rest needs no join.
    ends = spread_join(ticks, last, "run_id", slice_of("tick", TICK_SLICE)).filter(
        (F.col("tick") == F.col("last_tick") - 3) | (F.col("tick") == F.col("last_tick") - 1)
    )
    n, o, tick = run_number(), F.col("arrival"), F.col("tick")
    third = n % 3
    start_driver = F.when(third == 0, "rl").when(third == 1, "random")
    end_status = F.when(third == 0, "crashed").when(third == 1, "completed")

    def lines(source: DataFrame, *entries: tuple[Column, int, Column]) -> DataFrame:
        made = [
            F.when(
                condition,
                F.struct((o * 20 + shift).alias("log_offset"), value.alias("value")),
            )
            for condition, shift, value in entries
        ]
        return source.select(
            "ts", F.col("season_id").alias("key"), F.explode(F.array_compact(F.array(*made))).alias("m")
        ).select(
            "m.log_offset",
            F.timestamp_micros(F.round(F.col("ts") * 1000000).cast("bigint")).alias("log_ts"),
            "key",
            "m.value",
        )

    good = lines(
        ticks,
        (F.lit(True), 0, _record("telemetry")),
        (o % 10 == 0, 1, _record("telemetry", speed=F.col("speed") + 1)),
        ((tick == 0) & (n % 17 != 0), -1, _marker("run_start", driver=start_driver)),
        ((tick == 5) & (n % 4 == 0), 2, _marker("run_start", driver=F.lit("rl"))),
        (o % 97 == 0, 5, _marker("heartbeat")),
    )
    closing = lines(
        ends,
        (
            (tick == F.col("last_tick") - 3) & (n % 7 != 0),
            3,
            _marker("run_end", status=end_status, last_tick=tick),
        ),
        (
            (tick == F.col("last_tick") - 1) & (n % 5 == 0),
            4,
            _marker("run_end", status=F.lit("crashed"), last_tick=tick),
        ),
    )
    whole = _record("telemetry")
    swap = lambda pattern, to: F.regexp_replace(whole, pattern, to)
    bad = lines(
        ticks,
        (o % 101 == 1, 6, F.concat(F.lit('{"type":"telemetry","run_id":"'), F.col("run_id"))),
        (o % 103 == 2, 7, swap('"run_id":"[^"]*",', "")),
        (o % 107 == 3, 8, swap('"run_id":"[^"]*"', '"run_id":"not-a-run"')),
        (o % 109 == 4, 9, swap('"tick":[0-9]+', '"tick":1.5')),
        (o % 113 == 5, 10, swap('"cte":[^,]*', '"cte":NaN')),
        (o % 127 == 6, 11, _record("telemetry", hit=F.repeat(F.lit("x"), 101))),
        (o % 131 == 7, 12, swap('"speed":[^,]*', '"speed":null')),
        (
            o % 137 == 8,
            13,
            F.concat(
                F.lit('{"type":"run_start","season_id":"'), F.col("season_id"),
                F.lit('","run_id":"'), F.col("run_id"), F.lit('","driver":null}'),
            ),
        ),
        (
            o % 139 == 9,
            14,
            _marker("run_start", season_id=F.lit(UNKNOWN_SEASON), driver=F.lit("rl")),
        ),
    )
    return reduce(DataFrame.unionByName, [good, closing, bad])


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_offset, log_ts, key, value): the wire log with repeats and bad lines."""
    return _once("log", spark, sf_dir, _make_log)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded log, stored by kind so that marker passes read marker files only."""
    return _once("messages", spark, sf_dir, lambda *at: decode.decode(log(*at)), "kind")
