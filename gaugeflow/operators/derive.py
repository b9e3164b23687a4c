"""Dashboard series: what charts show, derived from buckets, segments and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.times import from_micros, micros
from gaugeflow.functions.values import celsius_to_fahrenheit

# Padding of the time axis, and of the sensor axes in degrees or percent.
TIME_PADDING = 0.02
SENSOR_PADDING = 5
HUMIDITY_BOUNDS = (0, 100)

_SEGMENT = ["series", "id", "start_time", "end_time", "is_current"]


def slope_trend(segments: DataFrame) -> DataFrame:
    """Midpoint time and slope of every segment."""
    middle = (micros("start_time") + micros("end_time")) / 2
    return segments.select(
        "series", "id", "is_current", from_micros(F.floor(middle).cast("bigint")).alias("mid_time"),
        "slope_mm_per_hr")


def fit_lines(segments: DataFrame) -> DataFrame:
    """Start and end point of every segment's line."""
    points = F.array(
        F.struct(F.lit(0).alias("point"), F.col("start_time").alias("t"), F.col("start_distance_mm").alias("value")),
        F.struct(F.lit(1).alias("point"), F.col("end_time").alias("t"), F.col("end_distance_mm").alias("value")),
    )
    return segments.select("series", "id", "is_current", F.explode(points).alias("p")).select(
        "series", "id", "is_current", "p.*")


def segment_buckets(segments: DataFrame, buckets: DataFrame) -> DataFrame:
    """Buckets with start <= t <= end of each segment; a segment without buckets keeps one row.

    An interval join on days: a segment is repeated for the days it covers, a bucket has one day,
    and the day is an equality key beside the series. Several segments may cover a bucket.
    """
    days = F.sequence(F.to_date("start_time"), F.to_date("end_time"))
    pieces = segments.select(*_SEGMENT, F.explode(days).alias("day"))
    dated = buckets.select("series", "t", "m", F.to_date("t").alias("day"))
    covered = pieces.join(dated, ["series", "day"]).where(
        (F.col("t") >= F.col("start_time")) & (F.col("t") <= F.col("end_time")))
    key = ["series", "start_time", "is_current"]
    return segments.select(*_SEGMENT).join(covered.select(*key, "t", "m"), key, "left").select(*_SEGMENT, "t", "m")


def overlay_sensors(levels: DataFrame, sensors: DataFrame) -> DataFrame:
    """Level means beside sensor means (temperatures in Fahrenheit) on one time axis."""
    def fahrenheit(kind: str):
        return celsius_to_fahrenheit(F.max(F.when(F.col("device_type") == kind, F.col("temp.m"))))

    beside = sensors.groupBy("t").agg(
        fahrenheit("water").alias("water_f"), fahrenheit("air").alias("air_f"),
        F.max("humidity.m").alias("humidity"))
    return levels.select("series", "t", "m").join(beside, "t", "full_outer").select(
        "series", "t", "m", "water_f", "air_f", "humidity")


def union_times(buckets: DataFrame, segments: DataFrame) -> DataFrame:
    """Bucket times together with segment starts and ends."""
    ends = segments.select("series", F.explode(F.array("start_time", "end_time")).alias("t"))
    return buckets.select("series", "t").unionByName(ends)


def time_range(buckets: DataFrame, segments: DataFrame, padding: float = TIME_PADDING) -> DataFrame:
    """Common time range per series with a little room on both sides."""
    span = union_times(buckets, segments).groupBy("series").agg(
        F.min(micros("t")).alias("lo"), F.max(micros("t")).alias("hi"))
    room = F.round((F.col("hi") - F.col("lo")) * padding).cast("bigint")
    return span.select(
        "series", from_micros(F.col("lo") - room).alias("x_min"), from_micros(F.col("hi") + room).alias("x_max"))


def sensor_axes(sensors: DataFrame, padding: int = SENSOR_PADDING,
                bounds: tuple[int, int] = HUMIDITY_BOUNDS) -> DataFrame:
    """Ranges of the temperature axis (Fahrenheit) and of the humidity axis, as whole numbers."""
    degrees = celsius_to_fahrenheit("temp.m")
    humidity = F.col("humidity.m")
    return sensors.agg(
        F.floor(F.min(degrees) - padding).alias("temp_min"),
        F.ceil(F.max(degrees) + padding).alias("temp_max"),
        F.when(F.count(humidity) > 0, F.greatest(F.lit(bounds[0]), F.floor(F.min(humidity) - padding)))
        .alias("humidity_min"),
        F.when(F.count(humidity) > 0, F.least(F.lit(bounds[1]), F.ceil(F.max(humidity) + padding)))
        .alias("humidity_max"),
    )


def new_measurements(known: DataFrame, fetched: DataFrame,
                     keys: tuple[str, ...] = ("series", "timestamp")) -> DataFrame:
    """Fetched rows whose time is not known yet; repeated times inside the fetch all stay.

    The known side is reduced to its keys first, so copies there cost one row.
    """
    return fetched.join(known.select(*keys).distinct(), list(keys), "left_anti")
