from datetime import datetime, timedelta

import pytest

from ticklane.operators import catalog

T0 = datetime(2024, 1, 1, 10, 0, 0)


@pytest.fixture(scope="module")
def seasons(spark):
    return spark.createDataFrame(
        [("s1", "track-a", "random", T0), ("s2", "track-b", "rl", T0), ("s3", "track-c", "rl", T0)],
        "id string, track_id string, driver string, created_at timestamp",
    ).selectExpr("*", "'linux' as os")


@pytest.fixture(scope="module")
def runs(spark):
    rows = [("r1", "s1", "rl", "running", 1), ("r2", "s1", "random", "crashed", 3),
            ("r3", "s1", "random", "completed", 2), ("r4", "s2", "random", "completed", 1),
            ("r9", "gone", "rl", "completed", 1)]
    return spark.createDataFrame(
        [(i, s, d, st, T0 + timedelta(minutes=m), None) for i, s, d, st, m in rows],
        "id string, season_id string, driver string, status string, started_at timestamp, "
        "ended_at timestamp",
    )


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


def test_driver_filter_asks_the_runs(seasons, runs):
    assert ids(catalog.seasons_with_driver(seasons, runs, "rl")) == ["s1"]
    assert ids(catalog.seasons_with_driver(seasons, runs, "random")) == ["s1", "s2"]


def listed(detail):
    out = {}
    for r in sorted(detail.collect(), key=lambda r: (r.id, r.position or 0)):
        out.setdefault(r.id, []).append((r.position, r.run_id))
    return out


def test_detail_lists_runs_newest_first(seasons, runs):
    assert listed(catalog.season_detail(seasons, runs)) == {
        "s1": [(0, "r2"), (1, "r3"), (2, "r1")], "s2": [(0, "r4")], "s3": [(None, None)],
    }


def test_detail_of_a_hot_season_has_the_same_shape_and_order(spark, seasons):
    many = spark.range(3000).selectExpr(
        "concat('x', lpad(id, 4, '0')) as id", "'s2' as season_id", "'rl' as driver", "'running' as status",
        "if(id % 100 = 7, null, timestamp_seconds(id % 50 * 700)) as started_at",
        "cast(null as timestamp) as ended_at",
    )
    found = listed(catalog.season_detail(seasons, many))
    known = {r.id: r.started_at for r in many.collect()}
    newest = sorted(known, key=lambda i: (known[i] is not None, known[i], i) if known[i] else (False, T0, i), reverse=True)
    assert found["s2"] == list(enumerate(newest))
    one = catalog.season_with_runs(seasons, many, "s2").first()
    assert [r.id for r in one.runs] == newest
    assert catalog.season_with_runs(seasons, many, "s3").first().runs == []


def test_newest_run_needs_no_sorted_aggregate(runs):
    found = catalog.newest_runs(runs)
    assert sorted((r.season_id, r.id) for r in found.collect()) == [("gone", "r9"), ("s1", "r2"), ("s2", "r4")]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_single_requests(seasons, runs, make_ticks):
    assert ids(catalog.season_by_id(seasons, "s2")) == ["s2"]
    assert ids(catalog.run_by_ids(runs, "s1", "r2")) == ["r2"]
    assert ids(catalog.run_by_ids(runs, "s2", "r2")) == []
    assert [r.id for r in catalog.runs_of(runs, "s1").collect()] == ["r2", "r3", "r1"]
    assert catalog.telemetry_of(make_ticks({"a": [{}], "b": [{}]}), "a").count() == 1


def test_request_filters_reach_the_files(spark, make_ticks, tmp_path):
    from ticklane.sources import tables

    tables.write_telemetry(make_ticks({"a": [{}], "b": [{}]}), str(tmp_path))
    stored = tables.read_table(spark, str(tmp_path), "telemetry")
    one = catalog.telemetry_of(stored, "a").select("tick", "speed")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(run_id,a)" in plan and "ReadSchema: struct<run_id:string,tick:int,speed:double>" in plan


def test_newest_run(runs):
    got = {r.season_id: r.id for r in catalog.newest_runs(runs).collect()}
    assert got == {"s1": "r2", "s2": "r4", "gone": "r9"}


def test_orphans_and_cascade(spark, seasons, runs, make_ticks):
    ticks = make_ticks({"r1": [{}, {}], "r4": [{}], "zz": [{}]})
    assert ids(catalog.orphan_runs(runs, seasons)) == ["r9"]
    assert ids(catalog.orphan_ticks(ticks, runs, 1), "run_id") == ["zz"]
    doomed = spark.createDataFrame([("s1",)], "id string")
    gone_runs, gone_ticks = catalog.cascade(doomed, runs, ticks, 1)
    assert ids(gone_runs) == ["r1", "r2", "r3"] and ids(gone_ticks, "run_id") == ["r1", "r1"]
    left_runs, left_ticks = catalog.survivors(doomed, runs, ticks, 1)
    assert ids(left_runs) == ["r4", "r9"] and ids(left_ticks, "run_id") == ["r4", "zz"]


def test_enriched(seasons, runs, make_ticks):
    rows = catalog.enriched(make_ticks({"r1": [{}], "r9": [{}]}), runs, seasons).collect()
    assert [(r.run_id, r.driver, r.track_id) for r in rows] == [("r1", "rl", "track-a")]


def test_labels(seasons, runs):
    run = {r.id: r for r in catalog.run_labels(runs).collect()}["r2"]
    assert run.label == "random · crashed · 10:03:00"
    season = {r.id: r for r in catalog.season_labels(seasons).collect()}["s1"]
    assert season.label == "2024-01-01 10:00:00 · track-a" and season.short_id == "s1"


def test_cards(spark):
    runs = spark.sql(
        "select 'a' as id, named_struct('pct_in_lane', 75.0D, 'avg_speed', 12.5D, "
        "'collisions', 2L, 'laps', 3) as summary "
        "union all select 'b', null union all select 'c', named_struct('pct_in_lane', 99.9D, "
        "'avg_speed', 0.0D, 'collisions', 0L, 'laps', 0)"
    )
    got = {r.run_id: tuple(r)[1:] for r in catalog.kpi_cards(runs).collect()}
    assert got["a"] == ("75%", "12.5", "2", "3")
    assert got["b"] == ("—", "—", "—", "—")
    assert got["c"] == ("99.9%", "0", "0", "0")
