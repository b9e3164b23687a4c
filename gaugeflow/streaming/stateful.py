"""Stateful streams: bucket statistics kept fresh, deduplication, alerts with a cooldown.

Event time needs the zoned timestamp type, so zone-less times are read in the session zone; run
these with ``spark.sql.session.timeZone=UTC``. Late rows do not occur with receipt times; the
watermark only bounds the state and is generous by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeflow.functions.times import BUCKET_ORIGIN_SECONDS
from gaugeflow.functions.values import cast_value
from gaugeflow.operators.alerts import COOLDOWN_HOURS, breaches
from gaugeflow.streaming.ingest import _trigger

WATERMARK = "2 days"


def event_time(df: DataFrame, ts: str = "timestamp", watermark: str = WATERMARK) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def stream_buckets(messages: DataFrame, interval_minutes: int, watermark: str = WATERMARK,
                   on_error: str = "raise") -> DataFrame:
    """Level statistics per topic and bucket; use with output mode 'update'. The same columns as
    the batch operator, which stays the reference for results."""
    seconds = interval_minutes * 60
    width, offset = f"{seconds} seconds", f"{BUCKET_ORIGIN_SECONDS % seconds} seconds"
    values = event_time(messages, watermark=watermark).where(F.col("payload").isNotNull()).select(
        F.col("topic").alias("series"), "timestamp", cast_value("payload", on_error).alias("v"))
    return values.groupBy("series", F.window("timestamp", width, width, offset).alias("w")).agg(
        F.avg("v").alias("m"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("s"),
        F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
    ).select("series", F.col("w.start").cast("timestamp_ntz").alias("t"), "m", "s", "n", "min", "max")


def write_updates(df: DataFrame, path: str, checkpoint: str, seconds: float | None = 30) -> StreamingQuery:
    """Write changed rows of an updating query, one folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return _trigger(writer, seconds).start()


def latest_updates(spark: SparkSession, path: str, keys: tuple[str, ...] = ("series", "t")) -> DataFrame:
    """The newest version of every key among written updates."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row")).select(*keys, "_row.*")


def dropped_as_late(query: StreamingQuery) -> int:
    """Rows that the watermark of a query has shut out so far, as its progress reports count them.

    Spark counts them after partial aggregation. Nothing else of them is kept, so a feed that brings its
    own times needs a watermark as long as its delays.
    """
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress
               for state in progress["stateOperators"])


def stream_dedup(df: DataFrame, keys: tuple[str, ...] = ("topic", "timestamp"),
                 watermark: str = WATERMARK) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return event_time(df, watermark=watermark).dropDuplicatesWithinWatermark(list(keys))


def stream_alerts(df: DataFrame, threshold: float, direction: str = "above",
                  cooldown_hours: float = COOLDOWN_HOURS) -> DataFrame:
    """Alerts of a (key, timestamp, value) stream; the state of a key is its last alert's time.

    Only breaches reach Python, and of them only time and value. The state is one number per key
    that ever alerted. The source's per-batch limit bounds the rows of a key in one call.
    """
    cooldown = round(cooldown_hours * 3_600_000_000)
    hits = df.where(breaches(threshold, direction)).select(
        F.col("key").cast("string").alias("key"),
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"),
        F.col("value").cast("double").alias("value"))

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("us", kind="stable")
        allowed = state.get[0] + cooldown if state.exists else None
        at, sent = rows["us"].to_numpy(), []
        i = 0 if allowed is None else int(at.searchsorted(allowed))
        while i < len(at):
            sent.append(i)
            i = int(at.searchsorted(at[i] + cooldown))
        if sent:
            state.update((int(at[sent[-1]]),))
            picked = rows.iloc[sent]
            yield pd.DataFrame({"key": key[0], "us": picked["us"], "value": picked["value"]})

    return hits.groupBy("key").applyInPandasWithState(
        follow, "key STRING, us BIGINT, value DOUBLE", "last BIGINT", "append",
        GroupStateTimeout.NoTimeout,
    ).select("key", F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp"), "value")
