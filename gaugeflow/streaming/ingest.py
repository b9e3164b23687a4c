"""Streaming ingest: feed -> decode -> route or parse -> tables.

Receipt time is the only clock. A micro-batch plays the role of a write batch: it starts when the batch
size is reached or the flush interval is over, whichever comes first, and takes all that has arrived. The
checkpoint replaces the in-memory batch, so nothing received is lost on a failure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeflow import schemas
from gaugeflow.functions.topics import READING_TOPIC_ROOT, valid_table_name
from gaugeflow.functions.values import decode_payload
from gaugeflow.operators import routing

# Seconds between flushes, messages per batch.
FLUSH_SECONDS = 60
BATCH_MESSAGES = 1000


def file_feed(spark: SparkSession, path: str, schema=schemas.FEED, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def kafka_options(servers: str, topics: str, batch_messages: int = BATCH_MESSAGES,
                  flush_seconds: float = FLUSH_SECONDS, max_messages: int | None = None) -> dict[str, str]:
    """Options of the Kafka source. A batch waits for ``batch_messages`` messages, ``flush_seconds`` at most;
    it has no upper limit unless ``max_messages`` gives one."""
    options = {
        "kafka.bootstrap.servers": servers, "subscribe": topics, "minOffsetsPerTrigger": str(batch_messages),
        "maxTriggerDelay": f"{round(flush_seconds * 1000)}ms"}
    return options if max_messages is None else {**options, "maxOffsetsPerTrigger": str(max_messages)}


def kafka_feed(spark: SparkSession, servers: str, topics: str, **limits) -> DataFrame:
    """A Kafka bridge of the broker: record key = message topic, record value = payload. Needs the
    Kafka connector on the class path. Start its sinks with a short trigger (``seconds=0``): the source
    itself waits for a full batch or the flush interval, see :func:`kafka_options`."""
    return (
        spark.readStream.format("kafka").options(**kafka_options(servers, topics, **limits)).load()
        .select(F.col("key").cast("string").alias("topic"), F.col("value").alias("payload"),
                F.lit(0).alias("qos"), F.lit(False).alias("retain"))
    )


def stamped(feed: DataFrame) -> DataFrame:
    """Add the receipt time and the row's id where the feed does not bring them.

    The id is a fingerprint of receipt time, topic and payload: equal for the same row in every repetition
    of a batch, and never NULL.
    """
    if "timestamp" not in feed.columns:
        feed = feed.withColumn("timestamp", F.current_timestamp().cast("timestamp_ntz"))
    if "id" not in feed.columns:
        feed = feed.withColumn("id", F.xxhash64(F.col("timestamp").cast("string"), "topic", F.col("payload").cast("string")))
    return feed


def ingest_messages(feed: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """Feed rows as message rows with their table name; topics without a pattern are dropped."""
    bad = [table for _, table in patterns if not valid_table_name(table)]
    if bad:
        raise ValueError(f"invalid table names: {bad}")
    rows = stamped(feed).withColumn("payload", decode_payload("payload"))
    return routing.route(rows, patterns).withColumn("date", F.to_date("timestamp"))


def ingest_readings(feed: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report feed as (readings, rejected rows), with the static device table broadcast."""
    rows = stamped(feed)
    readings, rejected = routing.parse_report(rows, devices)
    return readings.withColumn("date", F.to_date("timestamp")), rejected


def relay_stream(feed: DataFrame, prefix: str = READING_TOPIC_ROOT) -> DataFrame:
    """Every feed row under its rewritten topic, before any filter or parser sees it."""
    return routing.relay(feed.select("topic", "payload"), prefix)


def _trigger(writer, seconds: float | None):
    return writer.trigger(availableNow=True) if seconds is None else writer.trigger(
        processingTime=f"{seconds} seconds")


def append_stream(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (),
                  seconds: float | None = FLUSH_SECONDS) -> StreamingQuery:
    """Exactly-once append to Parquet. ``seconds=None`` takes what is there and stops."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _trigger(writer, seconds).start()


def flush_routed(df: DataFrame, path: str, checkpoint: str, seconds: float | None = FLUSH_SECONDS,
                 partition_by: Sequence[str] = ("table_name", "date")) -> StreamingQuery:
    """Write each micro-batch to its own folder, split by table and day.

    A repeated batch overwrites its folder, so the write is idempotent. One pass serves all
    tables. :func:`compact` merges old batch folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch_id={batch_id}")

    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return _trigger(writer, seconds).start()


def flush_reports(feed: DataFrame, devices: DataFrame, path: str, checkpoint: str,
                  seconds: float | None = FLUSH_SECONDS) -> StreamingQuery:
    """Write each micro-batch of a report feed as ``readings`` and ``rejected`` under ``path``.

    A batch is parsed once and kept while both parts are written; a repeated batch overwrites its folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for name, part in zip(("readings", "rejected"), routing.split_report(held, devices)):
                part.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        finally:
            held.unpersist()

    rows = routing.parsed(stamped(feed))
    return _trigger(rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write), seconds).start()


def compact(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Rewrite batch folders as one table by table name and day, sorted by topic and time, so that
    files can be skipped by their statistics. Days with many rows are split into several files."""
    rows = spark.read.parquet(path).drop("batch_id")
    rows.hint("rebalance", "table_name", "date").sortWithinPartitions(
        "table_name", "date", "topic", "timestamp"
    ).write.partitionBy("table_name", "date").parquet(target)
    return spark.read.parquet(target)
