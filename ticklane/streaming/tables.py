"""The tables that the stream writes, and the snapshots in which they are read.

Appended tables (telemetry, quarantine, counts) are ``<root>/<table>/[run_bucket=<k>/]batch_id=<n>``.
State tables (runs, slices, pages) hold what a batch needs to know of all earlier ones: one row
per run, per (run, tick slice) and per (run, page of ticks). A batch writes the buckets that
it touches anew, as ``<root>/<table>/run_bucket=<k>/batch_id=<n>``, and reads the versions
that were current before, so its cost does not grow with the number of batches.

A batch is there once its manifest is, ``<root>/manifest/<n>.json``, which is written last and at
one stroke. It says which version of each bucket is current; of appended tables, rows of
later batches do not count. Readers pin the newest manifest, so they see whole batches
only. A batch that is run again replaces its own directories, so nothing is stored twice.

Rows are placed by a hash of the run id, in a number of buckets that is fixed when the
tables are created.
"""

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticklane import schemas
from ticklane.operators import kpi, series, ticksets
from ticklane.plans.spread import TICK_SLICE, running_totals, slice_of
from ticklane.sources import paths

_SUMMARY = f"struct<{', '.join(f.replace(' ', ':') for f in schemas.KPI.split(', '))}>"

#: DDL of the files.
APPENDED = {
    "telemetry": f"{schemas.TELEMETRY}, log_offset bigint",
    "quarantine": f"{schemas.LOG}, kind string, reason string",
    "counts": "kind string, messages bigint",
}
STATE = ("runs", "slices", "pages")
_RUNS = (
    "run_id string, season_id string, driver string, status string, started_at timestamp, "
    f"ended_at timestamp, start_offset bigint, close_offset bigint, summary {_SUMMARY}"
)
_NO_BATCH = -1
#: Buckets of new tables: as many write tasks at least as the cluster has cores, so that a
#: batch is written, and one bucket read, in parallel.
RUN_BUCKETS = 256
#: Manifests, and what they refer to, that stay for readers.
KEPT = 50


@dataclass
class Snapshot:
    """The state after a batch: per state table and bucket the batch that wrote it last."""

    batch: int = _NO_BATCH
    versions: dict[str, dict[int, int]] = field(default_factory=lambda: {t: {} for t in STATE})
    replaced: list = field(default_factory=list)

    def text(self) -> str:
        return json.dumps({"batch": self.batch, "versions": self.versions, "replaced": self.replaced})

    @classmethod
    def of(cls, text: str) -> "Snapshot":
        found = json.loads(text)
        versions = {t: {int(k): v for k, v in of.items()} for t, of in found["versions"].items()}
        return cls(found["batch"], versions, found["replaced"])


def run_bucket(run_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("int")


_slices: list[StructType] = []


def schema_of(spark: SparkSession, table: str) -> StructType:
    if table != "slices":
        return StructType.fromDDL({"runs": _RUNS, "pages": ticksets.SCHEMA, **APPENDED}[table])
    if not _slices:
        _slices.append(kpi.slices(_empty(spark, StructType.fromDDL(schemas.TELEMETRY))).schema)
    return _slices[0]


def _empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows, and known to be none when a plan is made: joins with it fall away."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).filter(F.lit(False))


def create(spark: SparkSession, root: str, buckets: int = RUN_BUCKETS) -> None:
    """Empty tables, where there are none yet; a number of buckets once chosen stays."""
    if not paths.exists(spark, f"{root}/buckets"):
        paths.write_text(spark, f"{root}/buckets", str(buckets))
    for table in APPENDED:
        inner = "/run_bucket=0" if table == "telemetry" else ""
        _empty(spark, schema_of(spark, table)).coalesce(1).write.mode("ignore").parquet(
            f"{root}/{table}{inner}/batch_id={_NO_BATCH}"
        )


def buckets_of(spark: SparkSession, root: str) -> int:
    return int(paths.read_text(spark, f"{root}/buckets"))


def _manifest(root: str, batch_id: int) -> str:
    return f"{root}/manifest/{batch_id:012d}.json"


def snapshot(spark: SparkSession, root: str, before: int | None = None) -> Snapshot:
    """The newest state, or the newest one before a batch."""
    found = [int(n[:-5]) for n in paths.names(spark, f"{root}/manifest") if n.endswith(".json")]
    found = [n for n in found if before is None or n < before]
    return Snapshot.of(paths.read_text(spark, _manifest(root, max(found)))) if found else Snapshot()


def read(spark: SparkSession, root: str, table: str, at: Snapshot | None = None) -> DataFrame:
    """The rows of an appended table up to a snapshot, the newest one unless given."""
    at = at or snapshot(spark, root)
    full = schema_of(spark, table)
    if table == "telemetry":
        full = full.add("run_bucket", "integer")
    return spark.read.schema(full.add("batch_id", "integer")).parquet(f"{root}/{table}").filter(F.col("batch_id") <= at.batch)


def read_batch(spark: SparkSession, root: str, batch_id: int, buckets: list[int]) -> DataFrame:
    """The ticks that a batch has written, before it is committed."""
    folders = [f"{root}/telemetry/run_bucket={b}/batch_id={batch_id}" for b in buckets]
    folders = [f for f in folders if paths.exists(spark, f)]
    schema = schema_of(spark, "telemetry")
    return spark.read.schema(schema).parquet(*folders) if folders else _empty(spark, schema)


def read_state(
    spark: SparkSession, root: str, table: str, at: Snapshot | None = None, buckets: list[int] | None = None
) -> DataFrame:
    """The rows of a state table in a snapshot, of some buckets only if these are given."""
    versions = (at or snapshot(spark, root)).versions[table]
    wanted = versions if buckets is None else [b for b in buckets if b in versions]
    folders = [f"{root}/{table}/run_bucket={b}/batch_id={versions[b]}" for b in wanted]
    schema = schema_of(spark, table)
    return spark.read.schema(schema).parquet(*folders) if folders else _empty(spark, schema)


def _write_placed(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    spark = rows.sparkSession
    columns = schema_of(spark, table).fieldNames()
    order = [c for c in ("run_id", "tick", "_slice", "page") if c in columns]
    split = [slice_of("tick", TICK_SLICE)] if "tick" in columns else []
    placed = rows.select(*columns).withColumn("run_bucket", run_bucket(F.col("run_id"), buckets_of(spark, root)))
    # A task writes a bucket, or a slice of a long run; files are in the order of requests.
    placed = placed.withColumn("batch_id", F.lit(batch_id)).repartition("run_bucket", *split)
    writer = placed.sortWithinPartitions("run_bucket", *order).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("run_bucket", "batch_id").parquet(f"{root}/{table}")


def append(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Store the rows of a batch in place of any that an earlier attempt has left.

    A batch gives the same rows each time, so its directories are the same ones.
    """
    if table == "telemetry":
        _write_placed(rows, root, table, batch_id)
    else:
        columns = schema_of(rows.sparkSession, table).fieldNames()
        rows.select(*columns).write.mode("overwrite").parquet(f"{root}/{table}/batch_id={batch_id}")


def replace_state(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Write whole buckets of a state table anew; they count once the batch is committed."""
    _write_placed(rows, root, table, batch_id)


def commit(spark: SparkSession, root: str, batch_id: int, before: Snapshot, touched: list[int]) -> None:
    """Make a batch visible: it has written the touched buckets of every state table."""
    now = Snapshot(batch_id, {t: dict(v) for t, v in before.versions.items()})
    for table in STATE:
        for bucket in touched:
            if paths.exists(spark, f"{root}/{table}/run_bucket={bucket}/batch_id={batch_id}"):
                if bucket in now.versions[table]:
                    now.replaced.append([table, bucket, now.versions[table][bucket]])
                now.versions[table][bucket] = batch_id
    paths.write_text(spark, _manifest(root, batch_id), now.text())
    _forget(spark, root, batch_id - KEPT)


def _forget(spark: SparkSession, root: str, batch_id: int) -> None:
    """Remove a manifest that no reader needs any more, and the versions it was the last to name."""
    if paths.exists(spark, _manifest(root, batch_id)) and paths.exists(spark, _manifest(root, batch_id + 1)):
        for table, bucket, version in Snapshot.of(paths.read_text(spark, _manifest(root, batch_id + 1))).replaced:
            paths.remove(spark, f"{root}/{table}/run_bucket={bucket}/batch_id={version}")
        paths.remove(spark, _manifest(root, batch_id))


def current_runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs table as of now."""
    return read_state(spark, root, "runs").select(F.col("run_id").alias("id"), *schemas.RUN_COLUMNS[1:])


def current_telemetry(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "telemetry").select(
        "run_id", *schemas.TELEMETRY_COLUMNS, "log_offset", "run_bucket"
    )


def batch_totals(spark: SparkSession, root: str) -> DataFrame:
    """Messages per batch and so far."""
    per_batch = read(spark, root, "counts").groupBy("batch_id").agg(
        F.sum("messages").alias("messages")
    )
    totals = running_totals(
        per_batch.withColumn("all", F.lit(True)),
        "all",
        "batch_id",
        {"total": F.col("messages")},
        4_096,
    )
    return totals.select("batch_id", "messages", "total")


def live_series(spark: SparkSession, root: str, run_id: str, max_points: int) -> DataFrame:
    """The downsampled series of one run as far as it has arrived; reads its bucket only.

    The stride comes from the stored slices, so of the ticks only those that it keeps
    leave the scan.
    """
    at = snapshot(spark, root)
    bucket = spark.range(1).select(run_bucket(F.lit(run_id), buckets_of(spark, root))).first()[0]
    of_run = F.col("run_id") == run_id
    known = read_state(spark, root, "slices", at, [bucket]).filter(of_run).agg(F.sum("ticks")).first()[0]
    ticks = read(spark, root, "telemetry", at).filter((F.col("run_bucket") == bucket) & of_run)
    return series.in_tick_order(series.every(ticks, series.stride_of(known or 0, max_points)))


def compact(spark: SparkSession, root: str, target: str) -> None:
    """The tables as they are now, in few files.

    Written to a new root, on which the stream goes on with its old checkpoint once it was
    stopped: what is stored counts as its last batch. Readers of the old root are not
    disturbed; it may go when there are none left.
    """
    create(spark, target, buckets_of(spark, root))
    at = snapshot(spark, root)
    for table in ("telemetry", "quarantine"):
        append(read(spark, root, table, at), target, table, at.batch)
    for table in STATE:
        replace_state(read_state(spark, root, table, at), target, table, at.batch)
    counts = read(spark, root, "counts", at)
    counts.repartition(1).write.mode("overwrite").partitionBy("batch_id").parquet(f"{target}/counts")
    if at.batch != _NO_BATCH:
        commit(spark, target, at.batch, Snapshot(), list(range(buckets_of(spark, target))))
