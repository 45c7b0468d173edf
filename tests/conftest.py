import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ticklane import schemas  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("ticklane-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = {"hit": "none", "lap_count": 0, "terminated": False, "speed": 7.25}


def tick_row(run_id, tick, **values):
    row = {"run_id": run_id, "tick": tick, "ts": tick * 0.05}
    for name, kind in ((n, k) for n, k in _fields() if n not in row):
        row[name] = values.get(name, DEFAULTS.get(name, 0.0 if kind == "double" else 0))
    row.update(values)
    return row


def _fields():
    return [tuple(part.split(" ")) for part in schemas.TELEMETRY.split(", ")]


@pytest.fixture
def make_ticks(spark):
    """Telemetry from {run_id: [values per tick]}; a value may set its own tick."""

    def make(runs):
        rows = [
            tick_row(run_id, values.get("tick", i), **{k: v for k, v in values.items() if k != "tick"})
            for run_id, ticks in runs.items()
            for i, values in enumerate(ticks)
        ]
        names = [n for n, _ in _fields()]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.TELEMETRY)

    return make


def exchanges(df):
    """Shuffles of the physical plan before it is run, as text lines."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hash" in line]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()
