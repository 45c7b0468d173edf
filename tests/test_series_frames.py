import os
import random

import pytest

from ticklane.operators import frames, series
from ticklane.sources import framefiles


def test_stride_from_count(make_ticks):
    ticks = make_ticks({"a": [{} for _ in range(2500)], "b": [{} for _ in range(7)]})
    for size in (64, 16_384):
        kept = series.downsample(ticks, 1000, size).collect()
        a = sorted(r.tick for r in kept if r.run_id == "a")
        assert len(a) == 834 and a[:2] == [0, 3] and a[-1] == 2499
        assert sum(r.run_id == "b" for r in kept) == 7


def test_stride_uses_tick_values(make_ticks):
    ticks = make_ticks({"a": [{"tick": t} for t in range(1, 60, 2)]})  # 30 odd ticks
    kept = series.in_tick_order(series.downsample(ticks, 10, 8)).collect()
    assert [r.tick for r in kept] == [t for t in range(1, 60, 2) if t % 3 == 0]


@pytest.mark.parametrize("points", [9, 10_001])
def test_bounds(make_ticks, points):
    with pytest.raises(ValueError):
        series.downsample(make_ticks({"a": [{}]}), points)


def test_series_columns(make_ticks):
    ticks = make_ticks({"a": [{"cte": 0.3}]})
    assert series.lane_series(ticks).first().asDict() == {
        "run_id": "a", "tick": 0, "cte": 0.3, "upper": 0.5, "lower": -0.5,
    }
    assert series.speed_series(ticks).columns == ["run_id", "tick", "speed"]
    assert series.track_path(ticks).columns == ["run_id", "tick", "pos_x", "pos_y"]


def test_last_frame_before(spark):
    saved = spark.createDataFrame([("a", t) for t in (0, 5, 15)], "run_id string, frame_tick int")
    for at, expected in ((4, 0), (5, 5), (14, 5), (99, 15)):
        assert frames.frame_at(saved, at).first().frame_tick == expected
    assert frames.frame_at(saved.filter("frame_tick > 0"), 4).count() == 0


@pytest.mark.parametrize("size", [1, 4, 16_384])
def test_asof_equals_brute_force(spark, size):
    rng = random.Random(size)
    saved = {(f"r{rng.randrange(6)}", rng.randrange(80)) for _ in range(60)}
    asked = [(f"r{rng.randrange(8)}", rng.randrange(-3, 90)) for _ in range(400)]
    got = frames.frames_asof(
        spark.createDataFrame(asked, "run_id string, at_tick int"),
        spark.createDataFrame(sorted(saved), "run_id string, frame_tick int"),
        size,
    ).collect()
    assert len(got) == len(set(asked))
    once = frames.frames_asof(
        spark.createDataFrame(sorted(set(asked)), "run_id string, at_tick int"),
        spark.createDataFrame(sorted(saved), "run_id string, frame_tick int"),
        size,
        unique=True,
    ).collect()
    assert sorted(once, key=str) == sorted(got, key=str)
    for r in got:
        before = [t for run, t in saved if run == r.run_id and t <= r.at_tick]
        assert r.frame_tick == max(before, default=None)


def test_frame_files(spark, tmp_path):
    folder = tmp_path / "seasons" / "s1" / "runs" / "r1" / "frames"
    os.makedirs(folder)
    for name in ("000000.jpg", "000005.jpg", "1000000.jpg", "7.jpg", "x.jpg", "-1.jpg", "000009.png",
                 "99999999999.jpg"):
        (folder / name).write_bytes(b"x")
    found = framefiles.scan_frames(spark, str(tmp_path / "seasons"))
    rows = {r.frame_tick: r for r in found.collect()}
    assert sorted(rows) == [0, 5, 7, 1_000_000]
    assert {(r.season_id, r.run_id) for r in rows.values()} == {("s1", "r1")}
    assert rows[7].path.endswith("/7.jpg")
    names = {r[0] for r in found.select(framefiles.frame_name()).collect()}
    assert names == {"000000.jpg", "000005.jpg", "000007.jpg", "1000000.jpg"}
    shown = frames.frame_at(found.filter("run_id = 'r1'"), 6).first()
    assert shown.frame_tick == 5


def test_cadence(make_ticks):
    ticks = make_ticks({"a": [{} for _ in range(11)]})
    assert [r.tick for r in frames.frame_ticks(ticks).orderBy("tick").collect()] == [0, 5, 10]
