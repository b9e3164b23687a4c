"""Routing and normalising rows: topic tables, device joins, report parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gaugeflow import schemas
from gaugeflow.functions import topics
from gaugeflow.functions.values import decode_payload
from gaugeflow.session import lookup_table, sized

# Fixed value: the only report kind that carries readings.
REPORT_EVENT = "THSensor.Report"


def route(df: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """Attach ``table_name``; rows that no pattern takes are dropped. No join, no shuffle."""
    return df.withColumn("table_name", topics.route_topic("topic", patterns)).where(
        F.col("table_name").isNotNull())


def join_patterns(df: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """Same result as :func:`route`, which also serves streams, for batches with few different topics.

    Each topic is matched once, and the winner per topic is joined back: broadcast if the topics prove to
    be few, else by a shuffle in which Spark splits hot topics.
    """
    winner = route(df.select("topic").distinct(), patterns)
    return df.join(lookup_table(winner, "topics"), "topic")


def join_devices(df: DataFrame, devices: DataFrame) -> DataFrame:
    """Keep rows of known devices and attach their type."""
    return df.join(sized(devices), "device_id")


def parsed(df: DataFrame) -> DataFrame:
    """Decode the payload and parse it as a report: columns event, data, malformed, device_id.

    The parser is a generator of one row. Predicates on its columns are then not pushed down as
    copies of the parser expression, so each payload is parsed once.
    """
    text = df.withColumn("payload", decode_payload("payload")).withColumn(
        "device_id", topics.topic_device("topic"))
    schema = StructType([*schemas.REPORT.fields, StructField("_corrupt_record", StringType())])
    report = F.from_json("payload", schema, {"mode": "PERMISSIVE"})
    columns = text.columns
    return text.select(*columns, F.inline(F.array(report))).select(
        *columns, "event", "data", F.col("_corrupt_record").isNotNull().alias("malformed"))


def parse_report(df: DataFrame, devices: DataFrame, event: str = REPORT_EVENT) -> tuple[DataFrame, DataFrame]:
    """Raw report feed to normalised readings, and the rejected rows beside them; see :func:`split_report`.

    Reading both results parses the feed twice; a sink that needs both splits a parsed batch.
    """
    return split_report(parsed(df), devices, event)


def split_report(rows: DataFrame, devices: DataFrame, event: str = REPORT_EVENT) -> tuple[DataFrame, DataFrame]:
    """Rows of :func:`parsed` as normalised readings, and the rejected rows beside them.

    Kept are rows of known devices with the wanted event and a temperature. Humidity is kept for
    air devices only. A missing radio block gives a NULL signal. The raw text stays. Rejected are
    rows whose text is not JSON, or has a value that does not fit its column.
    """
    rejected = rows.where("malformed").select("id", "timestamp", "topic", "payload")
    good = rows.where(
        ~F.col("malformed") & (F.col("event") == event) & F.col("data.temperature").isNotNull())
    known = join_devices(good, devices)
    readings = known.select(
        "id", "timestamp",
        topics.reading_topic(F.col("device_type"), F.col("device_id")).alias("topic"),
        "device_id", "device_type",
        F.col("data.temperature").alias("temperature"),
        F.when(F.col("device_type") == "air", F.col("data.humidity")).alias("humidity"),
        F.col("data.battery").alias("battery"),
        F.col("data.loraInfo.signal").alias("signal"),
        F.col("payload").alias("raw_json"),
    )
    return readings, rejected


def relay(df: DataFrame, prefix: str = topics.READING_TOPIC_ROOT) -> DataFrame:
    """Every row under its rewritten topic, payload untouched."""
    return df.withColumn("topic", topics.relay_topic("topic", prefix))
