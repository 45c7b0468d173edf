"""Replay of a random log against a one-message-at-a-time emulation of its rules."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from ticklane import schemas
from ticklane.operators import kpi, replay

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
COLUMNS = (
    "log_offset bigint, log_ts timestamp, kind string, season_id string, driver string, "
    f"status string, {schemas.TELEMETRY}"
)
NAMES = [part.split(" ")[0] for part in COLUMNS.split(", ")]


def message(offset, kind, run_id, **values):
    row = {name: None for name in NAMES}
    row.update(log_offset=offset, log_ts=T0 + timedelta(seconds=offset), kind=kind, run_id=run_id)
    if kind == "telemetry":
        row.update({name: 0.0 for name in schemas.DOUBLE_COLUMNS})
        row.update(hit="none", lap_count=0, terminated=False)
    if kind == "run_start":
        row["season_id"] = "s1"
    row.update(values)
    return row


def random_log(rng, runs=25, messages=900):
    log = []
    for offset in range(0, messages * 3, 3):
        kind = rng.choices(["telemetry", "run_start", "run_end"], [12, 1, 1])[0]
        run_id = f"r{rng.randrange(runs)}"
        if kind == "telemetry":
            values = {
                "tick": rng.randrange(30),
                "speed": float(rng.randrange(100)),
                "cte": rng.choice([0.0, 0.7, 1.5]),
                "hit": rng.choice(["none", "pole"]),
            }
        elif kind == "run_start":
            values = {
                "season_id": rng.choice(["s1", "s2", "lost"]),
                "driver": rng.choice([None, "rl"]),
            }
        else:
            values = {"status": rng.choice([None, "crashed"])}
        log.append(message(offset, kind, run_id, **values))
    return log


def emulate(log, seasons=None):
    runs, ticks = {}, {}
    for m in log:
        run = runs.get(m["run_id"])
        if m["kind"] == "run_start":
            if run is None and (seasons is None or m["season_id"] in seasons):
                runs[m["run_id"]] = {
                    "season_id": m["season_id"],
                    "driver": m["driver"] or "random",
                    "status": "running",
                    "started_at": m["log_ts"],
                    "ended_at": None,
                    "covered": None,
                }
        elif m["kind"] == "telemetry":
            if run is not None:
                ticks.setdefault(m["run_id"], {}).setdefault(m["tick"], m)
        elif run is not None:
            run["covered"] = dict(ticks.get(m["run_id"], {}))
            if run["status"] == "running":
                run.update(status=m["status"] or "completed", ended_at=m["log_ts"])
    return runs, ticks


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], COLUMNS)


def utc(t):
    return t and t.replace(tzinfo=timezone.utc) if t is None or t.tzinfo is None else t


@pytest.mark.parametrize("seed,slices", [(1, 16_384), (2, 4)])
def test_replay_equals_emulation(spark, monkeypatch, seed, slices):
    monkeypatch.setattr(replay, "OFFSET_SLICE", slices * 16)
    log = random_log(random.Random(seed))
    shuffled = random.Random(0).sample(log, len(log))
    known = spark.createDataFrame([("s1",), ("s2",)], "id string")
    runs, ticks = replay.replay(frame(spark, shuffled), known, slices)
    expected_runs, expected_ticks = emulate(log, {"s1", "s2"})

    got = {r.id: r for r in runs.collect()}
    assert set(got) == set(expected_runs)
    for run_id, e in expected_runs.items():
        r = got[run_id]
        assert (r.season_id, r.driver, r.status) == (e["season_id"], e["driver"], e["status"])
        assert utc(r.started_at).timestamp() == e["started_at"].timestamp()
        assert (r.ended_at is None) == (e["ended_at"] is None)
        if e["covered"] is None:
            assert r.summary is None
        else:
            covered = e["covered"].values()
            assert r.summary.ticks == len(covered)
            assert r.summary.max_speed == max((m["speed"] for m in covered), default=0.0)
    kept = {(r.run_id, r.tick): r.speed for r in ticks.collect()}
    assert kept == {
        (run_id, tick): m["speed"] for run_id, of in expected_ticks.items() for tick, m in of.items()
    }


def one_run(spark, *messages):
    runs, ticks = replay.replay(frame(spark, list(messages)))
    return runs.collect(), {r.tick: r.speed for r in ticks.collect()}


def test_first_arrival_stays(spark):
    _, ticks = one_run(
        spark,
        message(1, "run_start", "a"),
        message(2, "telemetry", "a", tick=0, speed=1.0),
        message(3, "telemetry", "a", tick=0, speed=2.0),
    )
    assert ticks == {0: 1.0}


def test_second_end_keeps_status_and_renews_summary(spark):
    (run,), _ = one_run(
        spark,
        message(1, "run_start", "a"),
        message(2, "telemetry", "a", tick=0),
        message(3, "run_end", "a", status="crashed"),
        message(4, "telemetry", "a", tick=1),
        message(5, "run_end", "a", status="completed"),
    )
    assert run.status == "crashed" and run.summary.ticks == 2
    assert utc(run.ended_at) == T0 + timedelta(seconds=3)


def test_end_without_start_changes_nothing(spark):
    runs, ticks = one_run(
        spark, message(1, "run_end", "a"), message(2, "telemetry", "a", tick=0)
    )
    assert runs == [] and ticks == {}


def test_late_ticks_are_stored_but_not_summarised(spark):
    (run,), ticks = one_run(
        spark,
        message(1, "run_start", "a"),
        message(2, "run_end", "a"),
        message(3, "telemetry", "a", tick=0, speed=5.0),
    )
    assert ticks == {0: 5.0}
    assert run.status == "completed" and run.summary.ticks == 0 and run.summary.lap_times == []


def test_replayed_log_gives_the_same_tables(spark):
    log = random_log(random.Random(7), runs=8, messages=200)
    again = [dict(m, log_offset=m["log_offset"] + 10_000) for m in log]
    # Orphans of the first pass may find their run in the second; leave them out.
    starts = {}
    for m in log:
        if m["kind"] == "run_start":
            starts.setdefault(m["run_id"], m["log_offset"])
    again = [
        m for m in again
        if m["kind"] != "telemetry" or starts.get(m["run_id"], 1e9) < m["log_offset"] - 10_000
    ]
    once, ticks_once = replay.replay(frame(spark, log))
    twice, ticks_twice = replay.replay(frame(spark, log + again))
    pick = lambda df: sorted((r.id, r.season_id, r.driver) for r in df.collect())
    assert pick(once) == pick(twice)
    key = lambda df: sorted((r.run_id, r.tick, r.speed) for r in df.collect())
    assert key(ticks_once) == key(ticks_twice)


def test_quarantine_of_orphans_and_unknown_seasons(spark):
    messages = frame(
        spark,
        [
            message(1, "telemetry", "a", tick=0),
            message(2, "run_start", "a", season_id="s1"),
            message(3, "telemetry", "a", tick=1),
            message(4, "run_start", "b", season_id="lost"),
            message(5, "telemetry", "b", tick=0),
        ],
    )
    seasons = spark.createDataFrame([("s1",)], "id string")
    starts = replay.run_starts(messages, seasons)
    nothing = messages.limit(0).selectExpr("*", "array('x') as reasons")
    found = replay.quarantine(messages, nothing, starts, seasons).collect()
    assert sorted((r.log_offset, r.reason) for r in found) == [
        (1, "unknown:run_id"),
        (4, "unknown:season_id"),
        (5, "unknown:run_id"),
    ]


def test_copies_are_reduced_before_the_shuffle(spark):
    rows = frame(spark, [message(i, "telemetry", "a", tick=0) for i in range(5)])
    plan = replay.first_arrivals(rows)._jdf.queryExecution().executedPlan().toString()
    assert "functions=[partial_min(log_offset" in plan
    assert "Window" not in plan and "SortAggregate" not in plan


def test_rows_of_one_offset_count_once(spark):
    """A log appended twice, and equal offsets of two topic partitions."""
    log = [message(i, "telemetry", "a", tick=i % 3, speed=float(i)) for i in range(6)]
    other = [message(0, "telemetry", "a", tick=0, speed=-1.0), message(1, "telemetry", "b", tick=1)]
    rows = frame(spark, log + log + other)
    found = replay.first_arrivals(rows)
    assert set(found.columns) == set(rows.columns)
    got = sorted((r.run_id, r.tick, r.log_offset, r.speed) for r in found.collect())
    assert got == [("a", 0, 0, -1.0), ("a", 1, 1, 1.0), ("a", 2, 2, 2.0), ("b", 1, 1, 0.0)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = replay.first_arrivals(rows)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hash") == 3  # none for the rows that the join has placed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_summary_uses_the_placement_of_its_join(spark):
    """The ticks that met their cut-off are not shuffled again for the report."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        log = [message(1, "run_start", "a"), message(2, "telemetry", "a", tick=0)]
        kept = frame(spark, log).filter("kind = 'telemetry'").drop("season_id", "kind")
        cut = spark.createDataFrame([("a", 9)], "run_id string, last_end_offset bigint")
        from ticklane.plans.spread import slice_of, spread_join

        placed = spread_join(kept, cut, "run_id", slice_of("tick", 8), keep_slice=True)
        before = placed._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
        after = kpi.report(placed, placed=True)._jdf.queryExecution().executedPlan().toString()
        assert after.count("Exchange hash") == before + 1  # only slices, by run
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_messages_are_never_shuffled_by_run_alone(spark, tmp_path):
    """Raw messages move by (run, slice) and by (run, tick); only reduced rows by run."""
    log = [
        message(1, "run_start", "a"),
        message(2, "telemetry", "a", tick=0),
        message(3, "run_end", "a"),
    ]
    frame(spark, log).write.parquet(str(tmp_path / "m"))
    messages = spark.read.parquet(str(tmp_path / "m"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        starts = replay.run_starts(messages)
        for result in (
            replay.kept_telemetry(messages, starts),
            replay.orphan_telemetry(messages, starts).select("log_offset"),
            replay.run_ends(messages, starts),
        ):
            lines = result._jdf.queryExecution().executedPlan().toString().splitlines()
            for i, line in enumerate(lines):
                if "Exchange hashpartitioning(run_id" not in line:
                    continue
                keys = line.split("hashpartitioning(")[1].split("), ENSURE")[0].split(", ")[:-1]
                if len(keys) == 1:
                    below = " ".join(lines[i + 1 : i + 3])
                    assert "Aggregate" in below, line
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
