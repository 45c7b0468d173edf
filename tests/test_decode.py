import json

import pytest

from ticklane import schemas
from ticklane.operators import decode

RUN = "0000aaaa-0000-4000-8000-00000000000a"
SEASON = "0000bbbb-0000-4000-8000-00000000000b"


def record(**changed):
    row = {"type": "telemetry", "season_id": SEASON, "run_id": RUN}
    row |= {name: 0.5 for name in schemas.DOUBLE_COLUMNS}
    row |= {"tick": 3, "hit": "none", "lap_count": 0, "terminated": False}
    row |= changed
    return json.dumps({k: v for k, v in row.items() if v != "absent"})


def marker(kind, **extra):
    return json.dumps({"type": kind, "season_id": SEASON, "run_id": RUN, **extra})


CASES = {
    # wire text: (kind, reasons)
    record(): ("telemetry", []),
    record(season_id="absent"): ("telemetry", []),
    record(run_id=RUN.upper()): ("telemetry", []),
    record(run_id=RUN.replace("-", "")): ("telemetry", []),
    record(extra=1): ("telemetry", []),
    record(ts=1): ("telemetry", []),
    '{"type": "telemetry", "run_id"': ("malformed", ["malformed"]),
    "not json": ("malformed", ["malformed"]),
    "[1, 2]": ("malformed", ["malformed"]),
    record(run_id="absent"): ("telemetry", ["missing:run_id"]),
    record(run_id="r1"): ("telemetry", ["bad_id:run_id"]),
    record(tick=1.0): ("telemetry", ["bad_type:tick"]),
    record(tick="x"): ("telemetry", ["bad_type:tick"]),
    record(tick=2**40): ("telemetry", ["bad_type:tick"]),
    record(cte=float("nan")): ("telemetry", ["not_finite:cte"]),
    record(cte=float("-inf")): ("telemetry", ["not_finite:cte"]),
    record(cte=float("nan"), tick="absent"): ("telemetry", ["missing:tick", "not_finite:cte"]),
    record(hit="x" * 101): ("telemetry", ["too_long:hit"]),
    record(hit="x" * 100): ("telemetry", []),
    record(speed=None): ("telemetry", ["null:speed"]),
    record(speed="absent", hit=None): ("telemetry", ["missing:speed", "null:hit"]),
    marker("run_start"): ("run_start", []),
    marker("run_start", driver="rl"): ("run_start", []),
    marker("run_start", driver=None): ("run_start", ["null:driver"]),
    marker("run_start", driver="d" * 11): ("run_start", ["too_long:driver"]),
    marker("run_end", status="crashed", last_tick=9): ("run_end", []),
    marker("run_end", status=None): ("run_end", ["null:status"]),
    json.dumps({"type": "run_start", "run_id": RUN}): ("run_start", ["missing:season_id"]),
    marker("heartbeat"): ("unknown", []),
    json.dumps({"run_id": RUN}): ("unknown", []),
    "{}": ("unknown", []),
}


@pytest.fixture
def decoded(spark):
    log = spark.createDataFrame(list(enumerate(CASES)), "log_offset bigint, value string")
    return decode.decode(log)


def test_kinds_and_reasons(decoded):
    rows = {r.log_offset: r for r in decoded.collect()}
    for i, (text, (kind, reasons)) in enumerate(CASES.items()):
        assert (rows[i].kind, sorted(rows[i].reasons)) == (kind, sorted(reasons)), text


def test_ids_take_one_form(decoded):
    ids = {r.run_id for r in decode.conforming(decoded).collect()}
    assert ids == {RUN}


def test_split_is_whole(decoded):
    good, bad = decode.conforming(decoded).count(), decode.rejected(decoded).count()
    unknown = decoded.filter("kind = 'unknown'").count()
    assert good + bad + unknown == len(CASES)
    counts = {r.kind: r.messages for r in decode.type_counts(decoded).collect()}
    assert sum(counts.values()) == len(CASES) and counts["malformed"] == 3


def test_text_is_parsed_once(decoded):
    plan = decode.conforming(decoded)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(type") == 1
    assert "Python" not in plan


def test_null_value(spark):
    log = spark.createDataFrame([(1, None)], "log_offset bigint, value string")
    row = decode.decode(log).first()
    assert (row.kind, row.reasons) == ("malformed", ["malformed"])


def test_season_input(spark):
    rows = spark.createDataFrame(
        [
            ("ok", "linux", "1", "2", "t", "rl"),
            ("long", "l" * 11, "1", "2", "t" * 101, "random"),
            ("driver", "linux", "1", "2", "t", "human"),
            ("missing", None, "1", "2", "t", "rl"),
        ],
        "name string, os string, sdk_version string, simulator_version string, track_id string, "
        "driver string",
    )
    found = {r.name: r.reasons for r in decode.season_problems(rows).collect()}
    assert found == {
        "ok": [],
        "long": ["too_long:os", "too_long:track_id"],
        "driver": ["not_allowed:driver"],
        "missing": ["missing:os"],
    }


def test_backfill(spark):
    old = spark.createDataFrame([("a",)], "id string")
    assert decode.backfill_driver(old).first().driver == "random"
    some = spark.createDataFrame([("a", None), ("b", "rl")], "id string, driver string")
    assert sorted(r.driver for r in decode.backfill_driver(some).collect()) == ["random", "rl"]


def test_ids_in_braces_and_urns(spark):
    forms = [
        "{01234567-89AB-cdef-0123-456789abcdef}", "urn:uuid:01234567-89ab-cdef-0123-456789abcdef",
        "0123456789abcdef0123456789abcdef", "0123-456789abcdef-0123456789abcdef", "0123456789abcdef0123456789abcde",
        "0123456789abcdef0123456789abcdeg",
    ]
    rows = spark.createDataFrame([(f,) for f in forms], "raw string")
    found = [r[0] for r in rows.selectExpr(decode.canonical_id("raw")).collect()]
    assert found == ["01234567-89ab-cdef-0123-456789abcdef"] * 4 + [None, None]


def test_ids_are_put_in_form_once(spark):
    """Plain ids take a short way that gives the same; reasons use what is there."""
    plain = "01234567-89ab-cdef-0123-456789abcdef"
    rows = spark.createDataFrame([(plain,), (plain + "\n",), (plain[:-1],), (plain[:-1] + "g",), (plain[:-1] + "\n",)], "raw string")
    found = [r[0] for r in rows.selectExpr(decode.canonical_id("raw")).collect()]
    assert found == [plain, plain, None, None, None]
    assert decode._HEX not in decode._reasons(["tick"], [], ["run_id", "season_id"])
