import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import exchanges, plan_text
from ticklane import schemas
from ticklane.operators import kpi

SIZES = [1, 2, 3, 16_384]

CASES = {
    # name: (ticks, expected fields)
    "three_of_eight_in_lane": (
        [{"cte": v} for v in (0.0, 0.7, -0.25, 0.5, -0.5, 3.0, 0.3, -0.9)],
        {"ticks": 8, "pct_in_lane": 37.5},
    ),
    "long_and_short_hits": (
        [{"hit": h} for h in ("cone", "cone", "none", "none", "wall", "pole", "wall", "none")],
        {"collisions": 2},
    ),
    "off_on_both_sides": (
        [{"cte": v} for v in (-2.5, -0.9, 2.25, -2.25, 0.0, 0.99, -1.01)],
        {"offtrack_events": 3},
    ),
    "laps_with_times": (
        [
            {"lap_count": n, "last_lap_time": t}
            for n, t in ((1, 41.06), (1, 41.06), (2, 38.64), (3, 0.0), (5, 36.98))
        ],
        {"laps": 5, "lap_times": [41.1, 38.6, 37.0]},
    ),
    "hit_at_first_tick_then_other": ([{"hit": "pole"}, {"hit": "cone"}], {"collisions": 1}),
    "borders": (
        [{"cte": 1.0}, {"cte": -1.0}, {"cte": 0.5}],
        {"offtrack_events": 1, "pct_in_lane": 0.0},
    ),
    "lap_reset": (
        [{"lap_count": n, "last_lap_time": 5.0} for n in (2, 0, 1)],
        {"lap_times": [5.0, 5.0], "laps": 2},
    ),
    "lap_without_time": ([{"lap_count": 0}, {"lap_count": 1}], {"lap_times": [], "laps": 1}),
    "exact_ties": (
        [{"lap_count": 1, "last_lap_time": 12.25}, {"lap_count": 2, "last_lap_time": 12.35}],
        {"lap_times": [12.2, 12.3]},
    ),
    "last_time_zero": ([{"ts": -3.0}, {"ts": 0.0}], {"duration_s": 0.0}),
    "nan_deviation": (
        [{"cte": float("nan")}, {"cte": 1.5}],
        {"offtrack_events": 1, "pct_in_lane": 0.0},
    ),
    "gaps_in_ticks": (
        [
            {"tick": 0, "hit": "pole"},
            {"tick": 40_000, "hit": "pole"},
            {"tick": 90_000, "hit": "none"},
            {"tick": 90_001, "hit": "cone"},
        ],
        {"collisions": 2, "ticks": 4},
    ),
    "negative_ticks": (
        [{"tick": -2, "cte": 2.0}, {"tick": -1, "cte": 2.0}, {"tick": 0, "cte": 2.0}],
        {"offtrack_events": 1},
    ),
}


@pytest.mark.parametrize("size", SIZES)
def test_cases(make_ticks, size):
    found = kpi.report(make_ticks({name: ticks for name, (ticks, _) in CASES.items()}), size)
    rows = {r.run_id: r.asDict() for r in found.collect()}
    for name, (_, expected) in CASES.items():
        assert {k: rows[name][k] for k in expected} == expected, name


def test_run_without_ticks(spark, make_ticks):
    wanted = spark.createDataFrame([("empty",), ("one",)], "run_id string")
    rows = {
        r.run_id: r.asDict()
        for r in kpi.report_for(wanted, kpi.slices(make_ticks({"one": [{}], "other": [{}]}))).collect()
    }
    assert set(rows) == {"empty", "one"}
    zeros = {name: 0 for name in schemas.KPI_FIELDS} | {"lap_times": [], "run_id": "empty"}
    assert rows["empty"] == zeros
    assert rows["one"]["ticks"] == 1


def _streaks(flags):
    """Number of runs of true values."""
    return sum(on for on, _ in itertools.groupby(flags))


def _plain_report(ticks):
    """The same report from streaks and pairs of one run's ticks."""
    column = lambda name: [t[name] for t in ticks]
    deviation = [abs(v) for v in column("cte")]
    counts = column("lap_count")
    finished = [t for n, m, t in zip([0, *counts], counts, column("last_lap_time")) if m > n and t > 0]
    return {
        "ticks": len(ticks),
        "laps": max(counts),
        "lap_times": [round(t, 1) for t in finished],
        "max_abs_cte": round(max(deviation), 3),
        "max_speed": round(max(column("speed")), 3),
        "pct_in_lane": round(100.0 * sum(v < 0.5 for v in deviation) / len(ticks), 1),
        "collisions": _streaks(h != "none" for h in column("hit")),
        "offtrack_events": _streaks(v >= 1.0 for v in deviation),
    }


def _random_run(rng):
    tick, laps, out = rng.randrange(3), 0, []
    for _ in range(rng.randrange(1, 40)):
        laps = rng.choice([laps, laps, laps + 1, 0])
        out.append(
            {
                "tick": tick,
                "cte": rng.choice([0.0, 0.5, -0.49, 1.0, -1.0, rng.uniform(-2, 2)]),
                "hit": rng.choice(["none", "none", "pole", "cone"]),
                "speed": rng.uniform(0, 20),
                "lap_count": laps,
                "last_lap_time": rng.choice([0.0, rng.uniform(5, 50)]),
            }
        )
        tick += rng.choice([1, 1, 1, 2, 9])
    return out


@pytest.mark.parametrize("size", [1, 4, 16_384])
def test_random_runs_equal_plain_loop(make_ticks, size):
    rng = random.Random(size)
    runs = {f"r{i}": _random_run(rng) for i in range(150)}
    for row in kpi.report(make_ticks(runs), size).collect():
        expected = _plain_report(runs[row.run_id])
        assert {k: row[k] for k in expected} == expected


def test_parts_agree_with_report(make_ticks):
    ticks = make_ticks({"a": [{"cte": 0.1}, {"cte": 1.2}], "b": [{"speed": 3.0}]})
    full = {r.run_id: r for r in kpi.report(ticks).collect()}
    for row in kpi.basics(ticks).collect():
        assert all(row[name] == full[row.run_id][name] for name in row.asDict())


def test_lap_rows_equal_the_report(make_ticks):
    rng = random.Random(9)
    ticks = make_ticks({f"r{i}": _random_run(rng) for i in range(40)})
    for size in (1, 4, 16_384):
        listed = {}
        for r in sorted(kpi.lap_rows(ticks, size).collect()):
            assert r.lap_index == len(listed.setdefault(r.run_id, []))
            listed[r.run_id].append(r.lap_time)
        assert listed == {r.run_id: r.lap_times for r in kpi.report(ticks).collect() if r.lap_times}


def test_a_column_called_slice_is_the_callers(make_ticks):
    ticks = make_ticks({"a": [{"hit": "pole"}, {"hit": "pole"}, {"hit": "pole"}]})
    assert kpi.report(ticks.withColumn("slice", F.col("tick"))).first().collisions == 1


def test_json_form(make_ticks):
    report = kpi.report(make_ticks({"a": [{"lap_count": 1, "last_lap_time": 2.0}]}))
    assert list(json.loads(kpi.as_json(report).first().summary)) == schemas.KPI_FIELDS


def test_plan_has_one_shuffle_of_ticks(spark, make_ticks, tmp_path):
    make_ticks({"a": [{}]}).write.parquet(str(tmp_path / "t"))
    report = kpi.report(spark.read.parquet(str(tmp_path / "t")))
    shuffles = exchanges(report)
    # One of ticks, by run and slice; one of slices, by run.
    assert len(shuffles) == 2
    assert sum("slice" in s for s in shuffles) == 1
    assert "Python" not in plan_text(report)
    scan = next(x for x in plan_text(report).splitlines() if "FileScan" in x)
    assert "gyro" not in scan and "pos_x" not in scan
    assert len(exchanges(kpi.basics(spark.read.parquet(str(tmp_path / "t"))))) == 1
