"""The message topic. Needs Spark's Kafka connector on the class path."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane import constants as c


def as_log(records: DataFrame) -> DataFrame:
    """Kafka records as log rows.

    Offsets order the messages of one partition. The key is the season, so all
    messages of a run are in one partition and their offsets can be compared.
    """
    return records.select(
        F.col("partition").alias("log_partition"),
        F.col("offset").alias("log_offset"),
        F.col("timestamp").alias("log_ts"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def stream_topic(
    spark: SparkSession,
    servers: str,
    topic: str = c.TOPIC,
    max_messages: int = c.BATCH_MESSAGES,
) -> DataFrame:
    """The topic as a stream, from its beginning, at most so many messages a batch.

    The bound trades delay for throughput and does not change the tables; every
    batch has a fixed cost, so a thick stream needs a higher one.
    """
    return as_log(
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_messages)
        .load()
    )


def read_topic(spark: SparkSession, servers: str, topic: str = c.TOPIC) -> DataFrame:
    """Everything the topic holds now."""
    return as_log(
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("endingOffsets", "latest")
        .load()
    )


def to_messages(records: DataFrame) -> DataFrame:
    """(key, value) for publishing: the season as key, the record as JSON."""
    return records.select(
        F.col("season_id").alias("key"), F.to_json(F.struct(*records.columns)).alias("value")
    )


def publish(records: DataFrame, servers: str, topic: str = c.TOPIC) -> None:
    (
        to_messages(records)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def publish_to_files(records: DataFrame, path: str) -> None:
    """The same messages as JSON lines, for sessions without a broker."""
    to_messages(records).write.mode("append").json(path)
