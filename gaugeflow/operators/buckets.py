"""Time-bucket statistics at several resolutions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.times import bucket_start
from gaugeflow.functions.values import cast_value
from gaugeflow.operators.filters import Newest, lookback, newest_per_key

# Name, bucket width in minutes, look-back in hours (None = all history).
RESOLUTIONS = (("agg_1m", 1, 1), ("agg_5m", 5, 24), ("agg_1h", 60, None))


def _seconds(hours: int | None) -> int | None:
    return None if hours is None else hours * 3600


def level_buckets(
    df: DataFrame,
    interval_minutes: int,
    lookback_hours: int | None = None,
    topic: str | None = None,
    on_error: str = "raise",
    as_of: datetime | None = None,
    newest: Newest | None = None,
) -> DataFrame:
    """Mean, population deviation, minimum, maximum and count per topic and bucket.

    The look-back bound is per topic and includes rows with a NULL payload. The aggregates
    combine on the map side, so a hot topic or bucket sends one partial row per task.
    """
    if topic is not None:
        df = df.where(F.col("topic") == topic)
    rows = lookback(df, _seconds(lookback_hours), ("topic",), as_of=as_of, newest=newest)
    values = rows.where(F.col("payload").isNotNull()).select(
        F.col("topic").alias("series"),
        bucket_start("timestamp", interval_minutes).alias("t"),
        cast_value("payload", on_error).alias("v"),
    )
    return (
        values.groupBy("series", "t")
        .agg(
            F.avg("v").alias("m"),
            F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("s"),
            F.count(F.lit(1)).alias("n"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
        )
        .where(F.col("m").isNotNull())
    )


def sensor_buckets(
    df: DataFrame,
    interval_minutes: int,
    lookback_hours: int | None = None,
    scope: str = "table",
    as_of: datetime | None = None,
) -> DataFrame:
    """Temperature and humidity statistics per device type and bucket, in one aggregation.

    With ``scope='table'`` the look-back bound is the newest row of any device, whether or not it
    has a temperature; ``scope='type'`` takes the newest of each device type. ``n`` counts rows
    with a temperature. ``humidity`` is NULL for water and where no row had one.
    """
    keys = {"table": (), "type": ("device_type",)}[scope]
    rows = lookback(df, _seconds(lookback_hours), keys, as_of=as_of)
    rows = rows.where(F.col("device_type").isin("air", "water") & F.col("temperature").isNotNull())
    stats = rows.groupBy("device_type", bucket_start("timestamp", interval_minutes).alias("t")).agg(
        *[
            f(c).alias(f"{c}_{name}")
            for c in ("temperature", "humidity")
            for name, f in (("m", F.avg), ("s", F.stddev_pop), ("min", F.min), ("max", F.max))
        ],
        F.count(F.lit(1)).alias("n"),
    )

    def block(c: str):
        return F.struct(
            F.col(f"{c}_m").alias("m"),
            F.coalesce(F.col(f"{c}_s"), F.lit(0.0)).alias("s"),
            F.col(f"{c}_min").alias("min"),
            F.col(f"{c}_max").alias("max"),
        )

    has_humidity = (F.col("device_type") == "air") & F.col("humidity_m").isNotNull()
    return stats.select(
        "device_type", "t", block("temperature").alias("temp"),
        F.when(has_humidity, block("humidity")).alias("humidity"), "n",
    )


def in_order(df: DataFrame) -> DataFrame:
    """Bucket rows in the order dashboards read them: by series or device type, then time."""
    return df.orderBy("series" if "series" in df.columns else "device_type", "t")


def multires_levels(df: DataFrame, resolutions=RESOLUTIONS, **options) -> dict[str, DataFrame]:
    """The level statistics at each resolution. Look-backs end inside a bucket, so no resolution
    can be derived from another; the short ones read only recent rows. The newest time of every topic
    is read once for all of them."""
    newest = None if options.get("as_of") else newest_per_key(
        df if options.get("topic") is None else df.where(F.col("topic") == options["topic"]), ("topic",))
    return {name: level_buckets(df, m, h, newest=newest, **options) for name, m, h in resolutions}


def multires_sensors(df: DataFrame, resolutions=RESOLUTIONS, **options) -> dict[str, DataFrame]:
    if options.get("as_of") is None and options.get("scope", "table") == "table":
        options["as_of"] = df.agg(F.max("timestamp")).first()[0]
        if options["as_of"] is None:
            df = df.where(F.lit(False))
    return {name: sensor_buckets(df, m, h, **options) for name, m, h in resolutions}
