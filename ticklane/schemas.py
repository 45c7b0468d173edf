"""Table schemas, as Spark DDL strings."""

from ticklane.constants import TELEMETRY_FIELDS

TELEMETRY_COLUMNS = [name for name, _ in TELEMETRY_FIELDS]
DOUBLE_COLUMNS = [name for name, kind in TELEMETRY_FIELDS if kind == "double"]

_TELEMETRY_DDL = ", ".join(f"{name} {kind}" for name, kind in TELEMETRY_FIELDS)

TELEMETRY = f"run_id string, {_TELEMETRY_DDL}"

MESSAGE = (
    "type string, season_id string, run_id string, driver string, status string, "
    f"last_tick int, {_TELEMETRY_DDL}"
)

LOG = "log_partition int, log_offset bigint, log_ts timestamp, key string, value string"

KPI = (
    "duration_s double, ticks bigint, laps int, lap_times array<double>, "
    "mean_abs_cte double, max_abs_cte double, pct_in_lane double, avg_speed double, "
    "max_speed double, collisions bigint, offtrack_events bigint"
)
KPI_FIELDS = [part.strip().split(" ")[0] for part in KPI.split(",")]

SEASONS = (
    "id string, user_id string, os string, sdk_version string, simulator_version string, "
    "track_id string, car_config variant, driver string, created_at timestamp, "
    "updated_at timestamp"
)
SEASON_COLUMNS = [part.strip().split(" ")[0] for part in SEASONS.split(",")]

RUNS = (
    "id string, season_id string, driver string, status string, started_at timestamp, "
    f"ended_at timestamp, summary struct<{KPI.replace(' ', ':').replace(',:', ', ')}>"
)
RUN_COLUMNS = ["id", "season_id", "driver", "status", "started_at", "ended_at", "summary"]
