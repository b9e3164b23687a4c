"""Registered queries: every operator over the driver tables.

Each function takes (spark, sf_dir) and returns a DataFrame. Doubles are rounded to six digits so
that results can be compared across engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions import topics, values
from gaugeflow.functions.times import (
    bucket_start,
    countdown_text,
    from_micros,
    iso_text,
    micros,
    moment,
    year_month,
)
from gaugeflow.operators import alerts, buckets, derive, filters, merge, routing, stats
from gaugeflow.operators import extrema as X
from gaugeflow.operators import medians as M
from gaugeflow.operators import segments as S
from gaugeflow.operators.chunks import each_sample
from gaugeflow.plans import analysis as A
from gaugeflow.plans.snapshot import snapshot_batch
from gaugeflow.session import materialize, scratch_path
from gaugeflow.sources import archive, snapshots, versions
from gaugeflow.sources import tables as T
from gaugeflow.streaming import ingest, stateful
from gaugeflow.streaming import tables as kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PATTERNS = [
    ("events/+/nothing", "nothing"),
    ("#/raw", "broken"),
    ("events/click/#", "clicks"),
    ("events/signup/raw", "signups"),
    ("events/view/+", "views"),
    ("events/purchase/raw/#", "purchases"),
    ("events/click/raw", "late"),
]
AS_OF = datetime(2024, 1, 20, 12, 0, 0)
SEASON = (date(2024, 1, 5), date(2024, 1, 20))
ALERT_ABOVE = 120.0

# Rows in a file of a feed, which is what one task of a micro-batch reads at least.
FEED_FILE_ROWS = 250_000


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return T.events(spark, sf)


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return T.messages_from_events(_events(spark, sf))


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of which some have no payload."""
    return T.messages_from_events(_events(spark, sf)).withColumn(
        "payload", F.when(F.col("qos") != 1, F.col("payload")))


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return T.readings_from_events(_events(spark, sf))


def _levels(df: DataFrame) -> DataFrame:
    return rounded(df, "m", "s", "min", "max")


# -- scans, sources, sinks ---------------------------------------------------------------------------

def _plain_messages(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("value", values.cast_value("payload")), "value").drop("payload")


@query
def scan_messages(spark, sf):
    path = scratch_path(spark, "messages")
    _messages(spark, sf).write.parquet(path)
    return _plain_messages(T.scan_messages(spark, path))


@query
def scan_readings(spark, sf):
    path = scratch_path(spark, "readings")
    _readings(spark, sf).write.parquet(path)
    absent = T.scan_readings(spark, scratch_path(spark, "absent"))
    return rounded(T.scan_readings(spark, path).unionByName(absent), "temperature", "humidity").drop("raw_json")


def _feed(rows: DataFrame, label: str = "feed") -> DataFrame:
    """Rows as files of a live feed that arrives in two halves: four files, and more for a large table, so
    that what a task reads does not grow with it."""
    path = scratch_path(rows.sparkSession, label)
    files = max(4, math.ceil(rows.count() / FEED_FILE_ROWS))
    rows.repartition(files).write.parquet(path)
    return ingest.file_feed(rows.sparkSession, path, rows.schema, max_files=math.ceil(files / 2))


def _message_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as files of a live feed, payload in bytes."""
    return _feed(_messages(spark, sf).withColumn("payload", F.encode("payload", "UTF-8")))


def _report_feed(spark: SparkSession, sf: str) -> DataFrame:
    return _feed(T.report_feed_from_events(_events(spark, sf)), "reports")


def _appended(df: DataFrame, label: str, partition_by=()) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, label)
    ingest.append_stream(df, path, f"{path}-state", partition_by, seconds=None).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query
def ingest_messages(spark, sf):
    rows = _appended(ingest.ingest_messages(_message_feed(spark, sf), PATTERNS), "messages", ("table_name", "date"))
    return _plain_messages(rows)


@query
def flush_routed(spark, sf):
    rows = ingest.ingest_messages(_message_feed(spark, sf), PATTERNS)
    path = scratch_path(spark, "routed")
    ingest.flush_routed(rows, path, f"{path}-state", seconds=None).awaitTermination()
    stored = ingest.compact(spark, path, f"{path}-compact")
    return stored.groupBy("table_name", "date").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_message"),
        F.max("timestamp").alias("last_message"))


@query
def ingest_readings(spark, sf):
    devices = T.devices_from_events(_events(spark, sf))
    readings, _ = ingest.ingest_readings(_report_feed(spark, sf), devices)
    return _plain_readings(_appended(readings.drop("date"), "readings"))


@query
def ingest_reports(spark, sf):
    """Readings and rejected rows of one pass over the feed."""
    path = scratch_path(spark, "reports")
    devices = T.devices_from_events(_events(spark, sf))
    ingest.flush_reports(_report_feed(spark, sf), devices, path, f"{path}-state", seconds=None).awaitTermination()
    readings = spark.read.parquet(f"{path}/readings").select(F.lit("reading").alias("part"), "id", "timestamp", "topic")
    rejected = spark.read.parquet(f"{path}/rejected").select(F.lit("rejected").alias("part"), "id", "timestamp", "topic")
    return readings.unionByName(rejected)


@query
def relay_topic(spark, sf):
    rows = _appended(ingest.relay_stream(_report_feed(spark, sf)), "relay")
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).alias("bytes"))


def _snapshot(spark, sf, with_analysis: bool) -> DataFrame:
    path = scratch_path(spark, "snapshot")
    built = snapshot_batch(_gappy(spark, sf), _readings(spark, sf), *SEASON, AS_OF, minutes=360,
                           analysis=with_analysis)
    snapshots.write_snapshots(built, path)
    return snapshots.read_snapshots(spark, path)


@query
def snapshot_batch_levels(spark, sf):
    docs = _snapshot(spark, sf, False)
    points = F.array(*[
        F.struct(F.lit(name).alias("resolution"), F.col(f"{name}.data").alias("data"))
        for name, _, _ in buckets.RESOLUTIONS])
    return docs.select("series", F.explode(points).alias("p")).select(
        "series", "p.resolution", F.explode("p.data").alias("d")).select(
        "series", "resolution", "d.t", "d.n", "d.m", "d.s", "d.min", "d.max")


@query
def snapshot_batch_sensors(spark, sf):
    docs = _snapshot(spark, sf, False)
    points = F.array(*[
        F.struct(F.lit(name).alias("resolution"), F.lit(kind).alias("device_type"),
                 F.col(f"yolink_sensors.{name}.{kind}").alias("data"))
        for name, _, _ in buckets.RESOLUTIONS for kind in ("air", "water")])
    return docs.select(F.explode(points).alias("p")).select(
        "p.resolution", "p.device_type", F.explode("p.data").alias("d")).select(
        "resolution", "device_type", "d.t", "d.n", *[
            F.col(f"d.{block}.{c}").alias(f"{block}_{c}") for block in ("temp", "humidity")
            for c in ("m", "s", "min", "max")])


@query
def assemble_snapshot(spark, sf):
    docs = _snapshot(spark, sf, True).where(F.col("series").isNotNull())
    return docs.select(
        "series", "generated_at", F.col("season.start").alias("season_start"),
        F.col("season.is_active").alias("is_active"), "replay_delay_seconds",
        F.size("measurements").alias("n_measurements"),
        F.col("stats.measurement_count").alias("measurement_count"),
        F.round("stats.max_level", 6).alias("max_level"),
        F.size("analysis.segments").alias("n_segments"),
        F.size("analysis.extrema.minima").alias("n_minima"),
        F.size("analysis.extrema.maxima").alias("n_maxima"))


@query
def snapshot_source(spark, sf):
    docs = _snapshot(spark, sf, False)
    absent = snapshots.read_snapshots(spark, scratch_path(spark, "absent"))
    return docs.unionByName(absent).select("series", F.explode("measurements").alias("m")).select(
        "series", "m.timestamp", F.round("m.water_level_mm", 6).alias("water_level_mm"))


@query
def snapshot_sink(spark, sf):
    """One folder per series, and in it one gzip file with one document."""
    path = scratch_path(spark, "documents")
    built = snapshot_batch(_gappy(spark, sf), None, *SEASON, AS_OF, analysis=False)
    snapshots.write_snapshots(built, path, per_series=True)
    text = spark.read.text(f"{path}/*/*.gz").select("value", F.input_file_name().alias("file"))
    document = F.from_json("value", snapshots.schemas.SNAPSHOT)
    return text.withColumn("d", document).groupBy(F.col("d.series").alias("series")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct("file").alias("files"))


@query
def union_merge(spark, sf):
    """The appended part of a merge: new rows with unknown keys, first of each key."""
    return _plain_messages(merge.new_rows(*_generations(spark, sf), merge.MESSAGE_KEY))


def _archived(spark, sf) -> tuple[str, str]:
    live, store = scratch_path(spark, "live"), scratch_path(spark, "archive")
    _messages(spark, sf).write.parquet(live)
    archive.archive_month(spark, live, store, "2024-01")
    return live, store


@query
def archive_month(spark, sf):
    live, store = _archived(spark, sf)
    parts = [
        spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last")).select(
            F.lit(name).alias("part"), "n", "last")
        for name, path in (("live", live), ("archive", store))
    ]
    return parts[0].unionByName(parts[1])


@query
def list_archives(spark, sf):
    _, store = _archived(spark, sf)
    return archive.list_archives(spark, store).select("archive_month", (F.col("size") > 0).alias("has_bytes"))


@query
def restore_archive(spark, sf):
    _, store = _archived(spark, sf)
    return _plain_messages(archive.restore_archive(spark, store, "2024-01", scratch_path(spark, "restored")))


# -- projections, filters, predicates ----------------------------------------------------------------

@query
def query_messages(spark, sf):
    rows = filters.query_messages(
        _messages(spark, sf), datetime(2024, 1, 5), datetime(2024, 1, 9, 12), "events/_i%")
    return _plain_messages(rows)


@query
def top_recent(spark, sf):
    return _plain_messages(filters.query_messages(_messages(spark, sf), limit=50))


@query
def decode_payload(spark, sf):
    broken = F.unhex(F.concat(F.lit("FF"), F.lpad(F.hex("event_id"), 8, "0")))
    raw = F.when(T.device_type_of("user_id") == "air", broken).otherwise(F.encode("props", "UTF-8"))
    return _events(spark, sf).select("event_id", values.decode_payload(raw).alias("text"))


@query
def cast_value(spark, sf):
    return _messages(spark, sf).join(
        _events(spark, sf).select(F.col("event_id").alias("id"), "props"), "id").select(
        "id", F.round(values.cast_value("payload"), 6).alias("value"),
        values.cast_value("props", "null").alias("bad"))


@query
def topic_eq(spark, sf):
    rows = _gappy(spark, sf).where((F.col("topic") == "events/click/raw") & F.col("payload").isNotNull())
    return rows.select("id", "timestamp", "topic")


@query
def lookback(spark, sf):
    return filters.lookback(_gappy(spark, sf), 24 * 3600, ("topic",)).select("id", "timestamp", "topic")


@query
def lookback_scope(spark, sf):
    return filters.lookback(_readings(spark, sf), 24 * 3600).select("id", "timestamp", "device_type")


@query
def join_latest(spark, sf):
    rows = _messages(spark, sf).where(F.col("topic") == "events/view/raw")
    return filters.lookback(rows, 6 * 3600).select("id", "timestamp")


@query
def recent_raw(spark, sf):
    return rounded(filters.recent_raw(_gappy(spark, sf), 360), "water_level_mm")


@query
def route_topic(spark, sf):
    return routing.route(_messages(spark, sf), PATTERNS).select("id", "topic", "table_name")


@query
def join_pattern(spark, sf):
    return routing.join_patterns(_messages(spark, sf), PATTERNS).select("id", "topic", "table_name")


def _mixed_topics(spark, sf) -> DataFrame:
    """Vendor topics of the 'air' users and plain topics of the others."""
    reports = T.report_feed_from_events(_events(spark, sf)).select("id", F.col("topic").alias("vendor"))
    air = _readings(spark, sf).select("id", "device_type")
    return _messages(spark, sf).select("id", "topic").join(reports, "id").join(air, "id").select(
        "id", F.when(F.col("device_type") == "air", F.col("vendor")).otherwise(F.col("topic")).alias("topic"))


@query
def topic_fields(spark, sf):
    return _mixed_topics(spark, sf).select("id", topics.topic_device("topic").alias("device_id"))


@query
def relay_topic_expr(spark, sf):
    return _mixed_topics(spark, sf).select("id", topics.relay_topic("topic").alias("topic"))


def _parsed(spark, sf) -> tuple[DataFrame, DataFrame]:
    return routing.parse_report(
        T.report_feed_from_events(_events(spark, sf)), T.devices_from_events(_events(spark, sf)))


def _plain_readings(df: DataFrame) -> DataFrame:
    return rounded(df, "temperature", "humidity").drop("raw_json")


@query
def parse_report(spark, sf):
    return _plain_readings(_parsed(spark, sf)[0])


@query
def parse_report_rejected(spark, sf):
    return _parsed(spark, sf)[1]


@query
def keep_raw(spark, sf):
    return _parsed(spark, sf)[0].select("id", "raw_json")


@query
def event_filter(spark, sf):
    rows = routing.parsed(T.report_feed_from_events(_events(spark, sf)))
    return rows.where(F.col("event") == routing.REPORT_EVENT).select("id", "event")


@query
def join_device(spark, sf):
    rows = _readings(spark, sf).select("id", "device_id")
    return routing.join_devices(rows, T.devices_from_events(_events(spark, sf)))


@query
def mask_humidity(spark, sf):
    return _readings(spark, sf).select(
        "id", "device_type", F.when(F.col("device_type") == "air", F.col("battery")).alias("humidity"))


@query
def synthetic_topic(spark, sf):
    return _readings(spark, sf).select("id", topics.reading_topic("device_type", "device_id").alias("topic"))


@query
def conform_schema(spark, sf):
    kind = merge.classify_table("water_level", _messages(spark, sf).columns)
    return merge.conform_schema(_messages(spark, sf).drop("qos", "payload"), kind)


@query
def season_flag(spark, sf):
    return _events(spark, sf).select(
        "event_id", filters.season_flag(F.to_date("ts"), *SEASON).alias("in_season"))


@query
def replay_visible(spark, sf):
    return filters.replay_visible(_messages(spark, sf), AS_OF).select("id", "timestamp")


@query
def level_health(spark, sf):
    return _events(spark, sf).select("event_id", values.level_health("value").alias("health"))


@query
def unit_conversions(spark, sf):
    return rounded(_events(spark, sf).select(
        "event_id", values.mm_to_ml("value").alias("ml"),
        values.ml_to_mm(values.mm_to_ml("value")).alias("mm"),
        values.celsius_to_fahrenheit("value").alias("fahrenheit")), "ml", "mm", "fahrenheit")


@query
def time_functions(spark, sf):
    # A projection takes one window expression only.
    short = _events(spark, sf).withColumn("bucket_7m", bucket_start("ts", 7))
    return short.select(
        "event_id", "bucket_7m", bucket_start("ts", 7 * 24 * 60).alias("bucket_week"),
        iso_text("ts").alias("iso"), iso_text(F.date_trunc("minute", "ts")).alias("iso_minute"),
        year_month("ts").alias("month"), countdown_text(moment(AS_OF), "ts").alias("countdown"))


@query
def round_decimal(spark, sf):
    return _events(spark, sf).select(
        "event_id", F.round(values.round_decimal(F.col("value") + 0.003, 2), 6).alias("up"),
        F.round(values.round_decimal(F.col("value") - 0.002, 2), 6).alias("down"))


# -- joins, merges -----------------------------------------------------------------------------------

def _generations(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Old: every message twice. New: every message twice, views and errors a second later."""
    old = _messages(spark, sf)
    late = F.col("topic").isin("events/view/raw", "events/error/raw")
    moved = F.when(late, F.col("timestamp") + F.expr("INTERVAL '1' SECOND")).otherwise(F.col("timestamp"))
    new = old.withColumn("timestamp", moved)
    return (merge.conform_schema(old.unionByName(old), "messages"),
            merge.conform_schema(new.unionByName(new), "messages"))


@query
def merge_dedup(spark, sf):
    merged, _ = merge.merge_dedup(*_generations(spark, sf), merge.MESSAGE_KEY)
    return _plain_messages(merged)


@query
def merge_counts(spark, sf):
    return merge.merge_dedup(*_generations(spark, sf), merge.MESSAGE_KEY)[1]


@query
def merge_tables(spark, sf):
    old, new = _generations(spark, sf)
    readings = _readings(spark, sf)
    merged = merge.merge_tables(
        {"water_level": old, "yolink_sensors": readings, "_internal": old},
        {"water_level": new, "yolink_sensors": readings.drop("device_type"), "extra": new})
    return merge.merge_report(merged)


@query
def merge_report(spark, sf):
    return merge.merge_report({"messages": _messages(spark, sf), "readings": _readings(spark, sf)})


@query
def new_measurements(spark, sf):
    old, new = _generations(spark, sf)
    return derive.new_measurements(old, new, ("topic", "timestamp")).select("id", "topic", "timestamp")


# -- aggregations ------------------------------------------------------------------------------------

@query
def level_buckets(spark, sf):
    return _levels(buckets.level_buckets(_gappy(spark, sf), 60))


@query
def level_buckets_24h(spark, sf):
    return _levels(buckets.level_buckets(_gappy(spark, sf), 5, 24))


@query
def bucket_origin(spark, sf):
    return _levels(buckets.level_buckets(_messages(spark, sf), 7))


@query
def level_buckets_topic(spark, sf):
    return _levels(buckets.level_buckets(_gappy(spark, sf), 60, 240, topic="events/view/raw"))


def _flat_sensors(df: DataFrame) -> DataFrame:
    return df.select(
        "device_type", "t", "n",
        *[F.round(F.col(f"{block}.{c}"), 6).alias(f"{block}_{c}")
          for block in ("temp", "humidity") for c in ("m", "s", "min", "max")])


@query
def sensor_buckets(spark, sf):
    return _flat_sensors(buckets.sensor_buckets(_readings(spark, sf), 60))


@query
def sensor_buckets_24h(spark, sf):
    return _flat_sensors(buckets.sensor_buckets(_readings(spark, sf), 5, 24))


@query
def multires(spark, sf):
    parts = buckets.multires_levels(_gappy(spark, sf))
    tagged = None
    for name, df in parts.items():
        part = df.withColumn("resolution", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    return _levels(tagged)


@query
def measurement_stats(spark, sf):
    recent = filters.recent_raw(_gappy(spark, sf), 3 * 24 * 60)
    return rounded(stats.measurement_stats(recent), "min_level", "max_level", "avg_level", "stddev")


@query
def table_stats(spark, sf):
    return stats.table_stats(_messages(spark, sf))


@query
def table_stats_by_key(spark, sf):
    return stats.table_stats(_readings(spark, sf), ("device_type",))


@query
def frequency_hz(spark, sf):
    return rounded(stats.frequency_hz(
        _messages(spark, sf).withColumnRenamed("topic", "series"), seconds=7200), "hz")


@query
def latest_reading(spark, sf):
    found = stats.latest_reading(list(buckets.multires_sensors(_readings(spark, sf)).values()))
    return found.select(
        "rank", "device_type", "t", F.round("temp.m", 6).alias("temp_m"),
        F.round("humidity.m", 6).alias("humidity_m"), "n")


@query
def current_level(spark, sf):
    rows = _messages(spark, sf).select("id", F.col("topic").alias("series"), "timestamp",
                                       values.cast_value("payload").alias("water_level_mm"))
    return rounded(stats.current_level(rows), "water_level_mm")


@query
def last_500(spark, sf):
    return _plain_messages(filters.last_rows(_messages(spark, sf), 500))


@query
def last_500_by_topic(spark, sf):
    return _plain_messages(filters.last_rows(_messages(spark, sf), 500, ("topic",)))


# -- time series -------------------------------------------------------------------------------------

@query
def rolling_median(spark, sf):
    return rounded(M.with_rolling_median(_messages(spark, sf)), "value", "local_median")


@query
def rolling_median_10m(spark, sf):
    return rounded(M.with_rolling_median(_messages(spark, sf), 600), "value", "local_median")


def _residuals(spark, sf) -> tuple[DataFrame, int]:
    """Stored residuals and the number of series."""
    values, density = M.prepare_values(M.series_values(_messages(spark, sf)), M.ROLL_SECONDS * 500_000)
    return materialize(M.residuals(values, chunk_us=density.chunk_us), "residuals"), density.series


@query
def mad_scale(spark, sf):
    return rounded(M.mad_scale(*_residuals(spark, sf)), "scale")


@query
def exact_median(spark, sf):
    return rounded(M.exact_median(_residuals(spark, sf)[0], "residual"), "median")


@query
def residual(spark, sf):
    return rounded(M.expand(_residuals(spark, sf)[0]).select(
        "series", from_micros("us").alias("timestamp"), "local_median", "residual"), "local_median", "residual")


@query
def outlier(spark, sf):
    residuals, _ = _residuals(spark, sf)
    # Without the number of series: both ways must agree.
    marked = M.mark_outliers(residuals, M.mad_scale(residuals), 3.0)
    return rounded(M.expand(marked).select(
        "series", from_micros("us").alias("timestamp"), "value", "residual", "is_outlier"), "value", "residual")


@query
def clean_series(spark, sf):
    clean = A.clean_values(*M.prepare_values(M.series_values(_messages(spark, sf)), M.ROLL_SECONDS * 500_000))
    return rounded(M.expand(clean).select("series", from_micros("us").alias("timestamp"), "value", "n"), "value")


def _smooth(spark, sf) -> DataFrame:
    return A.smooth_from_messages(_messages(spark, sf))


@query
def row_index(spark, sf):
    samples = each_sample(_smooth(spark, sf))
    return rounded(samples.select(
        "series", from_micros("us").alias("timestamp"), F.col("pos").alias("index"), "smooth"), "smooth")


@query
def local_extrema(spark, sf):
    points = X.turning_points(_smooth(spark, sf)).where(F.col("kind") != "end")
    return rounded(points.select("series", "kind", F.col("mid").alias("index"), "value"), "value")


@query
def min_distance(spark, sf):
    kept = X.min_distance(X.peaks_of(X.turning_points(_smooth(spark, sf))))
    return rounded(kept.select("series", "kind", F.col("mid").alias("index"), "height"), "height")


@query
def prominence(spark, sf):
    points = materialize(X.turning_points(_smooth(spark, sf)), "turning")
    found = X.prominences(points)
    return rounded(found.select("series", "kind", F.col("mid").alias("index"), "value", "prominence"),
                   "value", "prominence")


def _extrema(spark, sf) -> tuple[DataFrame, DataFrame]:
    smooth = _smooth(spark, sf)
    return smooth, materialize(X.find_extrema(smooth), "extrema")


@query
def extrema(spark, sf):
    _, found = _extrema(spark, sf)
    return rounded(found.select(
        "series", "kind", from_micros("us").alias("timestamp"), F.col("value").alias("distance_mm")), "distance_mm")


@query
def next_max(spark, sf):
    _, found = _extrema(spark, sf)
    return S.next_max(found).select(
        "series", F.col("begin.mid").alias("min_index"), F.col("end.mid").alias("max_index"))


@query
def segment_points(spark, sf):
    smooth, found = _extrema(spark, sf)
    spans = S.candidate_spans(smooth, found)
    points = S.segment_points(smooth, spans).where(~F.col("is_current"))
    return rounded(points.select(
        "series", "id", F.col("pos").alias("index"), from_micros("us").alias("timestamp"),
        F.col("smooth").alias("value")), "value")


@query
def regr_slope(spark, sf):
    smooth, found = _extrema(spark, sf)
    spans = S.candidate_spans(smooth, found)
    return rounded(S.span_slopes(smooth, spans).select(
        "series", F.col("begin_mid").alias("begin_index"), "is_current", "slope_mm_per_hr"), "slope_mm_per_hr")


def _segments(spark, sf) -> DataFrame:
    return A.analyze_segments(_messages(spark, sf)).segments


def _plain_segments(df: DataFrame) -> DataFrame:
    return rounded(df, "start_distance_mm", "end_distance_mm", "slope_mm_per_hr", "duration_hours")


@query
def segments(spark, sf):
    return _plain_segments(_segments(spark, sf).where(~F.col("is_current")))


def _tides(spark, sf) -> DataFrame:
    """Messages whose values rise for four and a half days and then fall back, with the events' values as
    a small disturbance. The last rise is not over when the data ends."""
    phase = F.pmod(micros("timestamp") + 86_400_000_000, F.lit(388_800_000_000)) / 388_800_000_000.0
    value = 10.0 + 38.0 * phase + F.col("payload").cast("double") * 0.001
    return _messages(spark, sf).withColumn("payload", value.cast("string"))


@query
def current_segment(spark, sf):
    return _plain_segments(A.analyze_segments(_tides(spark, sf)).segments.where("is_current"))


@query
def analyze_segments(spark, sf):
    return _plain_segments(_segments(spark, sf))


@query
def refill_prediction(spark, sf):
    found = A.analyze_segments(_tides(spark, sf)).prediction
    return found.select(
        "series", F.round("current_distance_mm", 6).alias("current_distance_mm"),
        F.round("slope_mm_per_hr", 6).alias("slope_mm_per_hr"),
        F.round("time_to_50mm_hours", 4).alias("time_to_50mm_hours"),
        # Sums in other orders may move the moment by a microsecond or two.
        F.date_trunc("second", F.col("predicted_refill_time") + F.expr("INTERVAL '0.5' SECOND")).cast(
            "timestamp_ntz").alias("predicted_refill_time"))


# -- dashboard series --------------------------------------------------------------------------------

def _hourly(spark, sf) -> DataFrame:
    return buckets.level_buckets(_messages(spark, sf), 60)


@query
def slope_trend(spark, sf):
    return rounded(derive.slope_trend(_segments(spark, sf)), "slope_mm_per_hr")


@query
def fit_lines(spark, sf):
    return rounded(derive.fit_lines(_segments(spark, sf)), "value")


@query
def segment_buckets(spark, sf):
    return rounded(derive.segment_buckets(_segments(spark, sf), _hourly(spark, sf)), "m")


@query
def union_times(spark, sf):
    return derive.union_times(_hourly(spark, sf), _segments(spark, sf))


@query
def axis_ranges(spark, sf):
    return derive.time_range(_hourly(spark, sf), _segments(spark, sf))


@query
def sensor_axes(spark, sf):
    return derive.sensor_axes(buckets.sensor_buckets(_readings(spark, sf), 60))


@query
def overlay_sensors(spark, sf):
    return rounded(derive.overlay_sensors(
        buckets.level_buckets(_messages(spark, sf), 60), buckets.sensor_buckets(_readings(spark, sf), 5)),
        "m", "water_f", "air_f", "humidity")


# -- streaming, alerts -------------------------------------------------------------------------------

def _alert_input(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("topic").alias("key"), "timestamp", values.cast_value("payload").alias("value"))


@query
def threshold_alerts(spark, sf):
    return rounded(alerts.threshold_alerts(_alert_input(_messages(spark, sf)), ALERT_ABOVE), "value")


@query
def threshold_alerts_below(spark, sf):
    return rounded(alerts.threshold_alerts(
        _alert_input(_messages(spark, sf)), 10.0, "below", cooldown_hours=1), "value")


@query
def stream_alerts(spark, sf):
    path = scratch_path(spark, "feed")
    _messages(spark, sf).write.parquet(path)
    feed = ingest.file_feed(spark, path, _messages(spark, sf).schema)
    return rounded(_appended(stateful.stream_alerts(_alert_input(feed), ALERT_ABOVE), "alerts"), "value")


@query
def stream_buckets(spark, sf):
    feed = _message_feed(spark, sf).withColumn("payload", values.decode_payload("payload"))
    path = scratch_path(spark, "updates")
    # The feed's files are not in time order, so the watermark has to span them all.
    changes = stateful.stream_buckets(feed, 60, watermark="60 days")
    stateful.write_updates(changes, path, f"{path}-state", seconds=None).awaitTermination()
    return _levels(stateful.latest_updates(spark, path))


@query
def stream_dedup(spark, sf):
    feed = _messages(spark, sf)
    rows = _feed(feed.unionByName(feed))
    unique = _appended(stateful.stream_dedup(rows, watermark="60 days"), "unique")
    return unique.select("id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "topic")


# -- folder tables kept by streams -------------------------------------------------------------------

@query
def keep_routed(spark, sf):
    """All columns of routed rows, read back after merges have replaced the folders of the batches."""
    rows = ingest.ingest_messages(_message_feed(spark, sf), PATTERNS)
    path = scratch_path(spark, "kept")
    kept.keep_routed(rows, path, f"{path}-state", seconds=None, most_folders=1).awaitTermination()
    return _plain_messages(versions.read(spark, path, rows.schema))


@query
def keep_unique(spark, sf):
    """Every message once, from a feed that repeats them all out of time order, without a watermark."""
    path = scratch_path(spark, "kept")
    feed = _messages(spark, sf)
    rows = _feed(feed.unionByName(feed))
    kept.keep_unique(rows, path, f"{path}-state", seconds=None, most_folders=1).awaitTermination()
    return _plain_messages(versions.read(spark, path, feed.schema))


@query
def multires_fresh(spark, sf):
    """The statistics of ``multires`` for all messages, from summaries that a stream keeps."""
    feed = _message_feed(spark, sf).withColumn("payload", values.decode_payload("payload"))
    path = scratch_path(spark, "summaries")
    kept.keep_summaries(feed, path, f"{path}-state", seconds=None, most_folders=1).awaitTermination()
    partials, tagged = kept.read_summaries(spark, path), None
    for name, df in kept.fresh_levels(partials, _messages(spark, sf)).items():
        part = df.withColumn("resolution", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    return _levels(tagged)


@query
def archive_version(spark, sf):
    """All rows of an archive taken from a folder table, and those left in the table."""
    live, store = scratch_path(spark, "live"), scratch_path(spark, "archive")
    rows = _messages(spark, sf).withColumn("date", F.to_date("timestamp"))
    versions.commit(spark, live, versions.write_folders(rows, live, "first", ("date",)))
    archive.archive_version(spark, live, rows.schema, store, "2024-01")
    left = versions.read(spark, live, rows.schema).select(F.lit("live").alias("part"), *rows.columns)
    moved = spark.read.parquet(f"{store}/archive_month=2024-01").select(F.lit("archive").alias("part"), *rows.columns)
    return _plain_messages(left.unionByName(moved))
