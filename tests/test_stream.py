"""The stream against batch replay of the same log."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from ticklane import schemas
from ticklane.operators import decode, replay, ticksets
from ticklane.sources import logfiles, shared
from ticklane.streaming import ingest, tables


@pytest.fixture(scope="module", autouse=True)
def few_tasks(spark):
    """Batches here are a few rows: one task a step is enough."""
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def run_uuid(i):
    return f"0000aaaa-0000-4000-8000-{i:012d}"


SEASON = run_uuid(77)


def wire_log(seed, runs=12, messages=240):
    rng, out = random.Random(seed), []
    for offset in range(messages):
        kind = rng.choices(["telemetry", "run_start", "run_end", "ping", "bad"], [20, 2, 2, 1, 1])[0]
        m = {"type": kind, "season_id": SEASON, "run_id": run_uuid(rng.randrange(runs))}
        if kind == "telemetry":
            m |= {name: 0.25 for name in schemas.DOUBLE_COLUMNS}
            m |= {"tick": rng.randrange(20), "speed": float(offset), "hit": "none"}
            m |= {"lap_count": 0, "terminated": False}
        elif kind == "run_start":
            m["driver"] = rng.choice(["rl", "random"])
        elif kind == "run_end":
            m["status"] = rng.choice(["crashed", "completed"])
        text = json.dumps(m) if kind != "bad" else "{broken"
        out.append((offset, 1_704_000_000 + offset * 600, m["season_id"], text))
    return out


@pytest.fixture(scope="module")
def log(spark):
    rows = spark.createDataFrame(
        wire_log(3), "log_offset bigint, at bigint, key string, value string"
    )
    return rows.select(
        "log_offset", F.timestamp_seconds("at").alias("log_ts"), "key", "value"
    )


def state(runs, ticks):
    summary = lambda r: r.summary and tuple(map(str, r.summary))
    return (
        sorted(
            (r.id, r.season_id, r.driver, r.status, r.started_at, str(r.ended_at), summary(r))
            for r in runs.collect()
        ),
        sorted((r.run_id, r.tick, r.speed) for r in ticks.collect()),
    )


def stored_state(spark, root):
    return state(tables.current_runs(spark, root), tables.current_telemetry(spark, root))


@pytest.fixture(scope="module")
def expected(spark, log):
    return state(*replay.replay(decode.conforming(decode.decode(log))))


def part(log, first, last):
    return log.filter(F.col("log_offset").between(first, last))


def take_in(spark, root, messages=500):
    log = logfiles.stream_log(spark, f"{root}/in", f"{root}/cp", messages, per_task=20)
    ingest.catch_up(log, f"{root}/t", f"{root}/cp", buckets=4)


def test_stream_with_restarts_equals_batch(spark, log, expected):
    root = shared.new_path(spark, "stream-test")
    for parts in (((0, 60), (61, 99)), ((100, 239),)):
        for first, last in parts:
            logfiles.write_log(part(log, first, last), f"{root}/in")
        take_in(spark, root, 70)
    assert stored_state(spark, f"{root}/t") == expected

    sizes = {r.batch_id: r.messages for r in tables.batch_totals(spark, f"{root}/t").collect()}
    assert [sizes[i] for i in sorted(sizes)] == [70, 30, 70, 70]
    assert sorted(map(tuple, logfiles.read_log(spark, f"{root}/in").select(log.columns).collect())) == sorted(map(tuple, log.collect()))
    bad = tables.read(spark, f"{root}/t", "quarantine").filter("reason = 'malformed'").count()
    assert bad == log.filter("value = '{broken'").count()
    # A restart without new messages stores nothing more.
    take_in(spark, root)
    assert stored_state(spark, f"{root}/t") == expected

    run_id = tables.current_telemetry(spark, f"{root}/t").first().run_id
    live = tables.live_series(spark, f"{root}/t", run_id, 10).collect()
    assert [r.tick for r in live] == sorted(r.tick for r in live) and live


def test_repeated_batches_change_nothing(spark, log, expected):
    """A batch that failed after its writes is run again; later ones follow."""
    root = shared.new_path(spark, "retry-test")
    tables.create(spark, root, 4)
    ingest.ingest_batch(part(log, 0, 119), 0, root)
    ingest.ingest_batch(part(log, 0, 119), 0, root)
    ingest.ingest_batch(part(log, 120, 239), 1, root)
    ingest.ingest_batch(part(log, 120, 239), 1, root)
    assert stored_state(spark, root) == expected


def test_failure_between_writes_is_recovered(spark, log, expected, monkeypatch):
    root = shared.new_path(spark, "crash-test")
    tables.create(spark, root, 4)
    ingest.ingest_batch(part(log, 0, 119), 0, root)
    write = tables.replace_state

    def failing(rows, root_, table, batch_id):
        if table == "runs":
            raise RuntimeError("executor lost")
        write(rows, root_, table, batch_id)

    monkeypatch.setattr(tables, "replace_state", failing)
    with pytest.raises(RuntimeError):
        ingest.ingest_batch(part(log, 120, 239), 1, root)
    monkeypatch.setattr(tables, "replace_state", write)
    ingest.ingest_batch(part(log, 120, 239), 1, root)
    assert stored_state(spark, root) == expected


def test_null_and_mixed_log_times(spark):
    """The place of a run does not depend on its start time."""
    one, two = run_uuid(1), run_uuid(2)
    tick = {name: 0.5 for name in schemas.DOUBLE_COLUMNS} | {"hit": "none", "lap_count": 0, "terminated": False}
    messages = [
        ("run_start", one, {}), ("telemetry", one, tick | {"tick": 0}), ("telemetry", one, tick | {"tick": 1}),
        ("run_start", two, {}), ("telemetry", two, tick | {"tick": 3}),
        ("telemetry", one, tick | {"tick": 0, "speed": 99.0}), ("run_end", one, {}),
        ("telemetry", two, tick | {"tick": 3, "speed": 99.0}), ("run_end", two, {}),
    ]
    rows = [
        (i, None if r == one or i > 6 else 1_704_000_000 + 90_000 * i, SEASON, json.dumps({"type": k, "season_id": SEASON, "run_id": r} | m))
        for i, (k, r, m) in enumerate(messages)
    ]
    log = spark.createDataFrame(rows, "log_offset bigint, at bigint, key string, value string")
    log = log.select("log_offset", F.timestamp_seconds("at").alias("log_ts"), "key", "value")
    batch = state(*replay.replay(decode.conforming(decode.decode(log))))
    assert [t[1:] for t in batch[1]] == [(0, 0.5), (1, 0.5), (3, 0.5)]
    root = shared.new_path(spark, "null-times")
    tables.create(spark, root, 4)
    ingest.ingest_batch(part(log, 0, 4), 0, root)
    ingest.ingest_batch(part(log, 5, 9), 1, root)
    assert stored_state(spark, root) == batch


def test_compacted_tables_go_on(spark, log, expected):
    root = shared.new_path(spark, "compact-test")
    tables.create(spark, root, 4)
    for i, (first, last) in enumerate(((0, 79), (80, 159))):
        ingest.ingest_batch(part(log, first, last), i, root)
    tables.compact(spark, root, f"{root}-new")
    assert stored_state(spark, f"{root}-new") == stored_state(spark, root)
    ingest.ingest_batch(part(log, 160, 239), 2, f"{root}-new")
    assert stored_state(spark, f"{root}-new") == expected


def test_reads_are_pruned_to_buckets(spark, log):
    root = shared.new_path(spark, "prune-test")
    tables.create(spark, root, 16)
    ingest.ingest_batch(part(log, 0, 119), 0, root)
    scan = next(x for x in plan_text(tables.live_series(spark, root, run_uuid(3), 10)).splitlines() if "FileScan" in x)
    assert "run_bucket" in scan.split("PartitionFilters")[1]
    at = tables.snapshot(spark, root)
    assert ingest.touched_buckets(spark, root, spark.createDataFrame([(run_uuid(3),)] * 2, "run_id string")) == [
        spark.range(1).select(tables.run_bucket(F.lit(run_uuid(3)), 16)).first()[0]
    ]
    for table in tables.STATE:
        bucket = min(at.versions[table])
        some = tables.read_state(spark, root, table, at, [bucket])
        assert all(f"run_bucket={bucket}/" in f for f in some.inputFiles()) and some.count()


def test_readers_see_whole_batches_only(spark, log, monkeypatch):
    """Between any two writes of a batch the tables are those of the batch before."""
    root = shared.new_path(spark, "snapshot-test")
    tables.create(spark, root, 4)
    ingest.ingest_batch(part(log, 0, 119), 0, root)
    first, seen = stored_state(spark, root), []

    def looking(write):
        def run(*args):
            write(*args)
            seen.append(stored_state(spark, root))
        return run

    for name in ("append", "replace_state"):
        monkeypatch.setattr(tables, name, looking(getattr(tables, name)))
    pinned = tables.snapshot(spark, root)
    ingest.ingest_batch(part(log, 120, 239), 1, root)
    assert len(seen) == 6 and all(s == first for s in seen)
    assert stored_state(spark, root) != first
    assert tables.read(spark, root, "telemetry", pinned).count() == len(first[1])


def ordered_log(spark, runs, ticks, late=()):
    """Runs whose ticks arrive in turn; late: (batch of 100 messages, run, tick) to add there."""
    rows = [(run_uuid(r), "run_start", None) for r in range(runs)]
    for t in range(ticks):
        rows += [(run_uuid(r), "telemetry", t) for r in range(runs)]
    rows += [(run_uuid(r), "run_end", None) for r in range(runs)]
    for at, run, tick in late:
        rows.insert(at, (run_uuid(run), "telemetry", tick))
    out = []
    for i, (run, kind, tick) in enumerate(rows):
        m = {"type": kind, "season_id": SEASON, "run_id": run}
        if kind == "telemetry":
            m |= {name: 0.25 for name in schemas.DOUBLE_COLUMNS} | {"tick": tick, "terminated": False, "speed": float(i)}
            m |= {"hit": "cone" if tick % 7 < 2 else "none", "lap_count": tick // 10, "last_lap_time": float(tick), "cte": (tick % 5) / 2}
        out.append((i, 1_704_000_000 + i, SEASON, json.dumps(m)))
    frame = spark.createDataFrame(out, "log_offset bigint, at bigint, key string, value string")
    return frame.select("log_offset", F.timestamp_seconds("at").alias("log_ts"), "key", "value")


@pytest.mark.parametrize("late", [(), ((150, 1, 3), (270, 0, 2), (310, 1, 200), (330, 1, 200))])
def test_stored_slices_give_the_report_of_all_ticks(spark, late, monkeypatch):
    """Also with ticks that come late, twice, or before others of their slice."""
    log = ordered_log(spark, 3, 120, late)
    if late:  # ticks that are missing when their neighbours arrive
        gone = F.col("value").contains('"tick": 3,') & (F.col("log_offset") < 100) | F.col("value").contains('"tick": 2,') & (F.col("log_offset") < 100)
        log = log.filter(~gone)
    batch = state(*replay.replay(decode.conforming(decode.decode(log))))
    root, reads = shared.new_path(spark, "slices-test"), []
    tables.create(spark, root, 2)
    earlier = tables.read
    monkeypatch.setattr(tables, "read", lambda s, r, table, at=None: reads.append(table) or earlier(s, r, table, at))
    for i in range(3):
        ingest.ingest_batch(part(log, 130 * i, 130 * i + 129), i, root)
    assert ("telemetry" in reads) == bool(late)  # without late ticks no stored tick is read
    assert stored_state(spark, root) == batch


def test_a_batch_costs_the_same_after_many(spark):
    """Tables and files that a batch reads do not grow with the batches before it."""
    log, root, files = ordered_log(spark, 2, 80), shared.new_path(spark, "flat-test"), []
    tables.create(spark, root, 2)
    for i in range(5):
        at = tables.snapshot(spark, root, i)
        files.append(sum(len(tables.read_state(spark, root, t, at).inputFiles()) for t in tables.STATE))
        ingest.ingest_batch(part(log, 20 * i, 20 * i + 19), i, root)
    assert max(files[2:]) == files[2]
    assert stored_state(spark, root) == state(*replay.replay(decode.conforming(decode.decode(part(log, 0, 99)))))
    pages = tables.read_state(spark, root, "pages").collect()
    assert len(pages) == 2 and all(len(r.ticks) == 4096 for r in pages)


def test_few_runs_go_to_the_ticks(spark, log):
    """With few runs the joins with them shuffle no ticks; many runs give the same rows."""
    messages = shared.stored(decode.decode(log), "few-test", "kind")
    good, bad = decode.conforming(messages), decode.rejected(messages)
    runs = shared.stored(replay.run_starts(good), "few-starts")
    pages = ticksets.pages(replay.kept_telemetry(good, runs).filter("tick % 3 = 0"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sides = {few: replay.quarantine(good, bad, runs, few=few) for few in (True, False)}
        plans = {few: rows._jdf.queryExecution().executedPlan().toString() for few, rows in sides.items()}
        assert "Exchange hash" not in plans[True] and "Exchange hash" in plans[False]
        assert sorted(map(str, sides[True].collect())) == sorted(map(str, sides[False].collect()))
        ends = [sorted(map(str, replay.run_ends(good, runs, few).collect())) for few in (True, False)]
        assert ends[0] == ends[1]
        new = replay.kept_telemetry(good, runs, few=True, known=pages)
        expected = ticksets.unknown(replay.kept_telemetry(good, runs), pages)
        assert sorted(map(str, new.collect())) == sorted(map(str, expected.select(new.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_join_copies_what_grows(spark, monkeypatch):
    """With many runs no join has the driver hold runs, slices or pages, small as their files may be."""
    log = ordered_log(spark, 3, 60, ((150, 0, 2),))
    log = log.filter(~(F.col("value").contains('"tick": 2,') & (F.col("log_offset") < 100)))
    root, plans = shared.new_path(spark, "copies-test"), []
    tables.create(spark, root, 2)
    renew = ingest.new_runs
    monkeypatch.setattr(ingest, "new_runs", lambda *of: plans.append(plan_text(renew(*of))) or renew(*of))
    monkeypatch.setattr(ingest, "few", lambda rows: False)
    for i in range(2):  # a late tick is in the second one
        ingest.ingest_batch(part(log, 120 * i, 120 * i + 119), i, root)
    assert stored_state(spark, root) == state(*replay.replay(decode.conforming(decode.decode(log))))

    at = tables.snapshot(spark, root)
    known = {t: tables.read_state(spark, root, t, at) for t in tables.STATE}
    plans.append(plan_text(ticksets.unknown(tables.current_telemetry(spark, root), known["pages"])))
    plans.append(plan_text(ingest.overlapping(known["slices"], known["slices"])))
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_no_state_is_no_join(spark, log):
    """In the first batch a look-up of known ticks is not planned."""
    root = shared.new_path(spark, "empty-test")
    tables.create(spark, root, 2)
    pages = tables.read_state(spark, root, "pages")
    ticks = spark.range(5).selectExpr("'a' run_id", "cast(id as int) tick")
    plan = ticksets.unknown(ticks, pages)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and ticksets.unknown(ticks, pages).count() == 5


def test_old_snapshots_are_forgotten(spark, log, monkeypatch):
    monkeypatch.setattr(tables, "KEPT", 1)
    root = shared.new_path(spark, "forget-test")
    tables.create(spark, root, 2)
    for i in range(3):
        ingest.ingest_batch(part(log, 60 * i, 60 * i + 59), i, root)
    assert tables.paths.names(spark, f"{root}/manifest") == ["000000000002.json"]
    kept = {n for b in (0, 1) for n in tables.paths.names(spark, f"{root}/runs/run_bucket={b}")}
    assert kept <= {"batch_id=1", "batch_id=2"}


def test_a_batch_is_read_by_a_task_for_each_range(spark, log):
    root = shared.new_path(spark, "ranges-test")
    logfiles.write_log(part(log, 0, 149), f"{root}/in")
    logfiles.write_log(part(log, 150, 239), f"{root}/in")
    reader = logfiles.LogReader({"path": f"{root}/in", "checkpoint": f"{root}/cp", "messages": "100", "perTask": "10"})
    assert reader.initialOffset() == {"next": 0} and reader.latestOffset() == {"next": 100}
    ranges = reader.partitions({"next": 0}, {"next": 100})
    assert len(ranges) >= 10 and reader.latestOffset() == {"next": 200}
    found = [x for r in ranges for b in reader.read(r) for x in b.column("log_offset").to_pylist()]
    assert found == list(range(100))
    reader.partitions({"next": 100}, {"next": 200})
    assert reader.latestOffset() == {"next": 240}


def test_ranges_are_sized_by_rows_and_read_little_else(spark, log, monkeypatch):
    """Gaps in the offsets make no tasks, and a task reads the row groups of its range only."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(logfiles, "GROUP_BYTES", 4_096)
    root = shared.new_path(spark, "gaps-test")
    sparse = log.withColumn("log_offset", F.col("log_offset") * 1_000)
    logfiles.write_log(sparse, f"{root}/in")
    options = {"path": f"{root}/in", "checkpoint": f"{root}/cp", "messages": "1000000", "perTask": "60"}
    reader = logfiles.LogReader(options)
    ranges = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert 4 <= len(ranges) <= 6  # of 240 messages over 240,000 offsets
    found = [x for r in ranges for b in reader.read(r) for x in b.column("log_offset").to_pylist()]
    assert found == [1_000 * i for i in range(240)]
    assert all(pq.ParquetFile(f.removeprefix("file://")).num_row_groups > 1 for f, *_ in reader.files)
    # An index without the number of rows, as it was written before.
    (name,) = tables.paths.names(spark, f"{root}/in/index")
    old = [f[:3] for f in json.loads(tables.paths.read_text(spark, f"{root}/in/index/{name}"))]
    tables.paths.write_text(spark, f"{root}/in/index/{name}", json.dumps(old))
    assert logfiles.read_log(spark, f"{root}/in").count() == 240
    reader = logfiles.LogReader(options | {"perTask": "60000"})
    ranges = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [x for r in ranges for b in reader.read(r) for x in b.column("log_offset").to_pylist()] == found


def test_a_quarantined_message_can_be_repaired_and_replayed(spark):
    run = run_uuid(5)
    good = {name: 0.5 for name in schemas.DOUBLE_COLUMNS} | {"hit": "none", "lap_count": 0, "terminated": False}
    start = {"type": "run_start", "season_id": SEASON, "run_id": run}
    tick = {"type": "telemetry", "season_id": SEASON, "run_id": run, "tick": 4} | good
    rows = [(2, 0, SEASON, json.dumps(start)), (2, 1, SEASON, json.dumps(tick | {"tick": "x4"}))]
    log = spark.createDataFrame(rows, "log_partition int, log_offset bigint, key string, value string")
    log = log.withColumn("log_ts", F.lit(None).cast("timestamp"))
    messages = decode.decode(log)
    bad = replay.quarantine(decode.conforming(messages), decode.rejected(messages), replay.run_starts(decode.conforming(messages)))
    (row,) = bad.collect()
    assert (row.log_partition, row.log_offset, row.key, row.value) == (2, 1, SEASON, rows[1][3])
    repaired = bad.withColumn("value", F.replace("value", F.lit('"x4"'), F.lit("4"))).select(log.columns)
    _, ticks = replay.replay(decode.conforming(decode.decode(log.filter("log_offset = 0").union(repaired))))
    assert [(r.run_id, r.tick) for r in ticks.collect()] == [(run, 4)]
