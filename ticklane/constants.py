"""Fixed values.

These are part of the data contract (wire format, record fields, scoring
rules). Every producer and consumer of the data has to agree on them, so they
are stated once, here.
"""

# --- message log -----------------------------------------------------------
TOPIC = "telemetry"
RUN_START = "run_start"
TELEMETRY = "telemetry"
RUN_END = "run_end"
UNKNOWN = "unknown"
MALFORMED = "malformed"
MESSAGE_TYPES = [RUN_START, TELEMETRY, RUN_END]
BATCH_INTERVAL = "1 second"
BATCH_MESSAGES = 500

# --- runs and seasons ------------------------------------------------------
DRIVERS = ["random", "rl"]
DEFAULT_DRIVER = "random"
OPEN_STATUS = "running"
DEFAULT_END_STATUS = "completed"
MAX_LENGTH = {
    "os": 10,
    "sdk_version": 10,
    "simulator_version": 10,
    "track_id": 100,
    "driver": 10,
    "status": 10,
    "hit": 100,
}

# --- telemetry record ------------------------------------------------------
TELEMETRY_FIELDS = [
    ("tick", "int"),
    ("ts", "double"),
    ("steering", "double"),
    ("throttle", "double"),
    ("speed", "double"),
    ("forward_vel", "double"),
    ("cte", "double"),
    ("pos_x", "double"),
    ("pos_y", "double"),
    ("pos_z", "double"),
    ("vel_x", "double"),
    ("vel_y", "double"),
    ("vel_z", "double"),
    ("accel_x", "double"),
    ("accel_y", "double"),
    ("accel_z", "double"),
    ("gyro_x", "double"),
    ("gyro_y", "double"),
    ("gyro_z", "double"),
    ("hit", "string"),
    ("reward", "double"),
    ("lap_count", "int"),
    ("last_lap_time", "double"),
    ("terminated", "boolean"),
]
NO_HIT = "none"
FRAME_EVERY_TICKS = 5
SHORT_ID_LENGTH = 8

# --- KPI report ------------------------------------------------------------
IN_LANE_CTE = 0.5    # strictly below: in lane
OFFTRACK_CTE = 1.0   # at or above: off the track

# --- series ----------------------------------------------------------------
DEFAULT_MAX_POINTS = 1000
MIN_MAX_POINTS = 10
MAX_MAX_POINTS = 10000
POINT_FIELDS = ["tick", "ts", "speed", "cte", "pos_x", "pos_y", "steering", "throttle"]
LABEL_SEPARATOR = " · "
MISSING_CARD = "—"

# --- learning features -----------------------------------------------------
CRUISE_THROTTLE = 0.3
CTE_WEIGHT = 0.5
COLLISION_PENALTY = 5.0
STEERING_PENALTY = 0.01

# --- text sensor packets ---------------------------------------------------
PACKET_PATTERN = r"\((\w+) ([^)]*)\)"
HANDSHAKE_MARK = "***identified***"
STOP_MARKS = ["***shutdown***", "***restart***"]
TRACK_GAIN = 0.5
STEER_LOCK = 0.785398
TARGET_SPEED = 60.0
ACCEL_BELOW_TARGET = 0.6
SPEED_PER_GEAR = 45.0
MIN_GEAR = 1
MAX_GEAR = 6
