import json
import os

import pytest
from pyspark.sql import functions as F

from ticklane import schemas
from ticklane.sources import kafka, logfiles, rawzone, shared, tables


def test_raw_zone(spark, make_ticks, tmp_path):
    ticks = make_ticks({"a": [{"speed": 0.1}], "b": [{}, {}]}).withColumn(
        "season_id", F.when(F.col("run_id") == "a", "s1").otherwise("s2")
    )
    path = str(tmp_path / "raw")
    rawzone.append(ticks.filter("run_id = 'a'"), path)
    rawzone.append(ticks.filter("run_id = 'b'"), path)
    assert sorted(x for x in os.listdir(path) if x.startswith("season")) == [
        "season_id=s1", "season_id=s2",
    ]
    back = rawzone.scan(spark, path)
    columns = [part.split(" ")[0] for part in schemas.TELEMETRY.split(", ")]
    assert sorted(map(str, back.select(columns).collect())) == sorted(
        map(str, ticks.select(columns).collect())
    )
    plan = back.filter("season_id = 's1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season_id" in plan


def test_messages_to_publish(spark, make_ticks):
    ticks = make_ticks({"a": [{"tick": 4}]}).selectExpr(
        "'telemetry' as type", "'s1' as season_id", "*"
    )
    row = kafka.to_messages(ticks).first()
    value = json.loads(row.value)
    assert row.key == "s1" and value["tick"] == 4 and value["type"] == "telemetry"
    assert set(schemas.TELEMETRY_COLUMNS) <= set(value)


def test_topic_records_as_log(spark):
    records = spark.sql(
        "select 5L as offset, timestamp '2024-01-01' as timestamp, cast('k' as binary) as key, "
        "cast('v' as binary) as value, 0 as partition"
    )
    row = kafka.as_log(records).first()
    assert (row.log_offset, row.key, row.value) == (5, "k", "v")


def test_topic_needs_the_connector(spark):
    """The connector is not on the class path here, so only the error can be seen."""
    for make in (kafka.read_topic, kafka.stream_topic):
        with pytest.raises(Exception, match="kafka"):
            make(spark, "localhost:1")


def test_log_files_keep_micros(spark, tmp_path):
    log = spark.sql(
        "select 3 as log_partition, 1L as log_offset, timestamp '2024-01-01 00:00:00.123456' as log_ts, "
        "'k' as key, '{}' as value"
    )
    logfiles.write_log(log, str(tmp_path / "log"))
    assert logfiles.read_log(spark, str(tmp_path / "log")).collect() == log.collect()


def test_stored_tables(spark, make_ticks, tmp_path):
    ticks = make_ticks({"a": [{}, {}]})
    tables.write_telemetry(ticks, str(tmp_path))
    assert tables.read_table(spark, str(tmp_path), "telemetry").schema == ticks.schema
    assert shared.stored(ticks, "t").count() == 2
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    for ddl in (schemas.SEASONS, schemas.RUNS, schemas.KPI, schemas.LOG):
        spark.createDataFrame([], ddl)
