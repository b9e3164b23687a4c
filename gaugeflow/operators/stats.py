"""Whole-table and per-key statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.times import micros
from gaugeflow.operators.filters import lookback


def table_stats(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Row count, first and last timestamp, exact number of topics.

    A first aggregation to (key, topic) combines on the map side and replaces the wide expand of
    a distinct count; a hot topic is one row after it.
    """
    per_topic = df.groupBy(*keys, "topic").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    seen = F.coalesce(F.sum("n"), F.lit(0))
    return per_topic.groupBy(*keys).agg(
        seen.alias("count"),
        F.min("lo").alias("first_message"),
        F.max("hi").alias("last_message"),
        F.when(seen > 0, F.count("topic")).alias("unique_topics"),
    )


def measurement_stats(df: DataFrame, keys: tuple[str, ...] = ("series",),
                      value: str = "water_level_mm") -> DataFrame:
    """Minimum, maximum, mean, population deviation and count of the non-NULL values; keys without
    any value give no row."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.min(value).alias("min_level"),
            F.max(value).alias("max_level"),
            F.avg(value).alias("avg_level"),
            F.stddev_pop(value).alias("stddev"),
            F.count(value).alias("measurement_count"),
        )
    )


def frequency_hz(df: DataFrame, keys: tuple[str, ...] = ("series",), seconds: float = 60) -> DataFrame:
    """Rows in the last seconds of data divided by the time between the first and last of them;
    0 for fewer than two rows or no time between them."""
    span = (F.max(micros("timestamp")) - F.min(micros("timestamp"))) / 1e6
    n = F.count(F.lit(1))
    return lookback(df, seconds, keys).groupBy(*keys).agg(
        F.when((n >= 2) & (span > 0), n / span).otherwise(F.lit(0.0)).alias("hz"))


def latest_reading(resolutions: list[DataFrame]) -> DataFrame:
    """Newest bucket per device type, from the first resolution that has any row at all.

    ``resolutions`` come in order of preference, as given by ``sensor_buckets``. Each is reduced to
    its newest row per device type in the same plan; no part of it is computed twice.
    """
    last = F.max_by(F.struct("t", "temp", "humidity", "n"), "t").alias("last")
    found = None
    for rank, df in enumerate(resolutions):
        newest = df.groupBy("device_type").agg(last).select(F.lit(rank).alias("rank"), "device_type", "last.*")
        found = newest if found is None else found.unionByName(newest)
    # A row per resolution and device type: the window over all of them is small.
    best = F.min("rank").over(Window.partitionBy(F.lit(0)))
    return found.withColumn("_best", best).where("rank = _best").drop("_best")


def current_level(df: DataFrame, keys: tuple[str, ...] = ("series",),
                  value: str = "water_level_mm") -> DataFrame:
    """Latest row's value per key; among equal timestamps the highest id."""
    order = F.struct("timestamp", "id")
    return df.groupBy(*keys).agg(
        F.max("timestamp").alias("timestamp"), F.max_by(value, order).alias(value))
