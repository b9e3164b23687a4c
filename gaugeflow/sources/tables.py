"""Reading the stored tables, and adapters that give other tables their shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow import schemas
from gaugeflow.functions.topics import reading_topic, valid_table_name


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def scan_messages(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a message table; the schema is given, so no file is opened to infer it."""
    return spark.read.schema(schemas.MESSAGES).parquet(path)


def scan_readings(spark: SparkSession, path: str | None = None, table: str | None = None) -> DataFrame:
    """All rows of the reading table, or no rows when path or table does not exist."""
    if table is not None:
        if not valid_table_name(table):
            raise ValueError(f"invalid table name: {table}")
        if not spark.catalog.tableExists(table):
            return empty(spark, schemas.READINGS)
        return spark.table(table)
    if path is None or not path_exists(spark, path):
        return empty(spark, schemas.READINGS)
    return spark.read.schema(schemas.READINGS).parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def props_k() -> Column:
    """The one number in an event's JSON properties."""
    return F.get_json_object("props", "$.k").cast("int")


def messages_from_events(df: DataFrame) -> DataFrame:
    """Events as a message table: one topic per event type, the value as text payload."""
    return df.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("events/"), "event_type", F.lit("/raw")).alias("topic"),
        F.col("value").cast("string").alias("payload"),
        (F.col("user_id") % 3).cast("int").alias("qos"),
        F.lit(False).alias("retain"),
    )


def device_type_of(user_id: str) -> Column:
    return F.when(F.col(user_id) % 2 == 0, "air").otherwise("water")


def readings_from_events(df: DataFrame) -> DataFrame:
    """Events as a reading table: users as devices, even ones 'air' and odd ones 'water'."""
    kind = device_type_of("user_id")
    device = F.col("user_id").cast("string")
    return df.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        reading_topic(kind, device).alias("topic"),
        device.alias("device_id"),
        kind.alias("device_type"),
        F.col("value").alias("temperature"),
        F.when(kind == "air", props_k().cast("double")).alias("humidity"),
        props_k().alias("battery"),
        (-props_k()).alias("signal"),
        F.col("props").alias("raw_json"),
    )


def report_feed_from_events(df: DataFrame) -> DataFrame:
    """Events as the vendor's raw report feed: topic, binary JSON payload, qos, retain.

    'signup' rows carry another event name, 'error' rows are cut off JSON, and users that divide
    by five have no radio block, so every branch of the parser is met.
    """
    device = F.col("user_id").cast("string")
    body = F.to_json(F.struct(
        F.when(F.col("event_type") == "signup", "THSensor.Alert").otherwise("THSensor.Report").alias("event"),
        device.alias("deviceId"),
        F.struct(
            F.col("value").alias("temperature"),
            props_k().cast("double").alias("humidity"),
            props_k().alias("battery"),
            F.when(F.col("user_id") % 5 != 0, F.struct((-props_k()).alias("signal"))).alias("loraInfo"),
        ).alias("data"),
    ))
    cut = F.when(F.col("event_type") == "error", F.concat(F.lit("{\"event\": "), device)).otherwise(body)
    return df.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat_ws("/", F.lit("yl-home"), F.lit("h1"), device, F.lit("report")).alias("topic"),
        F.encode(cut, "UTF-8").alias("payload"),
        (F.col("user_id") % 3).cast("int").alias("qos"),
        F.lit(False).alias("retain"),
    )


def devices_from_events(df: DataFrame) -> DataFrame:
    """Device dimension: the users that do not divide by seven."""
    users = df.select("user_id").where(F.col("user_id") % 7 != 0).distinct()
    return users.select(
        F.col("user_id").cast("string").alias("device_id"),
        device_type_of("user_id").alias("device_type"),
    )
