"""The published snapshot: a nested document per series, and one for the site's sensors.

A document is one row, so a list with very many items goes on in further documents, its parts: part p
holds the items numbered from p * ``PART_ITEMS``. Nothing is cut off, and no row grows with the history.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.times import iso_text, micros
from gaugeflow.functions.values import round_decimal
from gaugeflow.operators.buckets import RESOLUTIONS, multires_levels, multires_sensors
from gaugeflow.operators.chunks import floor_div, number_rows
from gaugeflow.operators.filters import recent_raw
from gaugeflow.operators.medians import DAY_US
from gaugeflow.operators.stats import measurement_stats
from gaugeflow.plans.analysis import Analysis, analyze_segments
from gaugeflow.schemas import SNAPSHOT
from gaugeflow.session import materialize

# Fixed values.
REPLAY_DELAY_SECONDS = 300
RAW_MINUTES = 10
MEAN_DIGITS, DEVIATION_DIGITS = 2, 3

# Items of one array of a document.
PART_ITEMS = 100_000


@dataclass
class Parts:
    """What a snapshot is made of. Missing parts give absent keys."""

    measurements: DataFrame
    levels: dict[str, DataFrame] = field(default_factory=dict)
    sensors: dict[str, DataFrame] = field(default_factory=dict)
    analysis: Analysis | None = None


def in_parts(frames: dict[str, tuple[DataFrame, list[str], str]], limit: int = PART_ITEMS) -> dict[str, DataFrame]:
    """Add ``part`` to each (rows, key, time column): the number of a row within its key, over ``limit``.

    Lists that are counted to be short are part 0 as a whole and are not numbered.
    """
    counts = None
    for name, (df, key, _) in frames.items():
        one = df.groupBy(*key).count().agg(F.max("count").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    long = {r["name"] for r in counts.where(F.col("n") > limit).collect()} if counts is not None else set()
    out = {}
    for name, (df, key, ts) in frames.items():
        if name not in long:
            out[name] = df.withColumn("part", F.lit(0).cast("bigint"))
            continue
        series = F.col(key[0]) if len(key) == 1 else F.concat_ws("|", *key)
        keyed = materialize(df.select(
            F.struct(*df.columns).alias("row"), series.alias("series"), micros(ts).alias("us")
        ).withColumn("chunk", floor_div(F.col("us"), DAY_US)), "numbered")
        numbered = number_rows(keyed, "us", {"place": F.lit(1)})
        out[name] = numbered.select("row.*", floor_div(F.col("place"), limit).alias("part"))
    return out


def _gather(df: DataFrame, key: list[str], order: list[str], item: Column, name: str) -> DataFrame:
    """One ordered array per key."""
    held = F.array_sort(F.collect_list(F.struct(*order, item.alias("_item"))))
    return df.groupBy(*key).agg(held.alias("_held")).select(
        *key, F.transform("_held", lambda e: e["_item"]).alias(name))


def _mean(c: str | Column) -> Column:
    return round_decimal(c, MEAN_DIGITS)


def _level_item() -> Column:
    return F.struct(
        iso_text("t").alias("t"), _mean("m").alias("m"), round_decimal("s", DEVIATION_DIGITS).alias("s"),
        F.col("n"), _mean("min").alias("min"), _mean("max").alias("max"))


def _sensor_item() -> Column:
    def block(c: str) -> Column:
        return F.struct(
            _mean(F.col(f"{c}.m")).alias("m"), round_decimal(F.col(f"{c}.s"), DEVIATION_DIGITS).alias("s"),
            _mean(F.col(f"{c}.min")).alias("min"), _mean(F.col(f"{c}.max")).alias("max"))

    return F.struct(
        iso_text("t").alias("t"), block("temp").alias("temp"), F.col("n"),
        F.when(F.col("humidity").isNotNull(), block("humidity")).alias("humidity"))


def _resolution(minutes: int, hours: int | None, *data: Column) -> Column:
    return F.struct(
        F.lit(minutes).alias("interval_minutes"), F.lit(hours).cast("int").alias("lookback_hours"), *data)


def _analysis_documents(analysis: Analysis, segments: DataFrame, extrema: DataFrame) -> DataFrame:
    key = ["series", "part"]
    segments = _gather(
        segments, key, ["is_current", "begin_index"],
        F.struct(
            "id", iso_text("start_time").alias("start_time"), iso_text("end_time").alias("end_time"),
            _mean("start_distance_mm").alias("start_distance_mm"),
            _mean("end_distance_mm").alias("end_distance_mm"),
            round_decimal("slope_mm_per_hr", DEVIATION_DIGITS).alias("slope_mm_per_hr"),
            _mean("duration_hours").alias("duration_hours"), "n_points", "is_current"), "segments")
    points = _gather(
        extrema, key, ["index"],
        F.struct("kind", iso_text("timestamp").alias("timestamp"), _mean("distance_mm").alias("distance_mm")),
        "points")

    def of_kind(kind: str) -> Column:
        some = F.filter(F.coalesce("points", F.array()), lambda p: p["kind"] == kind)
        return F.transform(some, lambda p: F.struct(
            p["timestamp"].alias("timestamp"), p["distance_mm"].alias("distance_mm")))

    first = F.lit(0).cast("bigint").alias("part")
    forecast = analysis.prediction.select("series", first, F.struct(
        _mean("current_distance_mm").alias("current_distance_mm"),
        round_decimal("slope_mm_per_hr", DEVIATION_DIGITS).alias("slope_mm_per_hr"),
        _mean("time_to_50mm_hours").alias("time_to_50mm_hours"),
        iso_text("predicted_refill_time").alias("predicted_refill_time")).alias("current_prediction"))
    parts = analysis.series.select("series", first).unionByName(segments.select(*key)).unionByName(
        points.select(*key)).distinct()
    whole = parts.join(segments, key, "left").join(points, key, "left").join(forecast, key, "left")
    return whole.select(*key, F.struct(
        F.coalesce("segments", F.array()).alias("segments"),
        F.struct(of_kind("min").alias("minima"), of_kind("max").alias("maxima")).alias("extrema"),
        "current_prediction").alias("analysis"))


def _sensor_documents(sensors: dict[str, DataFrame]) -> DataFrame:
    """(part, yolink_sensors): the site's sensor block. Resolutions without rows are absent."""
    tagged = None
    for name, df in sensors.items():
        rows = df.select(F.lit(name).alias("name"), "device_type", "t", "temp", "humidity", "n", "part")
        tagged = rows if tagged is None else tagged.unionByName(rows)
    arrays = _gather(tagged, ["part", "name", "device_type"], ["t"], _sensor_item(), "data")

    def one(name: str, minutes: int, hours: int | None) -> Column:
        def data(kind: str) -> Column:
            return F.max(F.when((F.col("name") == name) & (F.col("device_type") == kind), F.col("data")))

        some = F.count(F.when(F.col("name") == name, 1)) > 0
        return F.when(some, _resolution(minutes, hours, data("air").alias("air"), data("water").alias("water")))

    names = [name for name, _, _ in RESOLUTIONS]
    blocks = arrays.groupBy("part").agg(*[one(name, m, h).alias(name) for name, m, h in RESOLUTIONS])
    return blocks.select("part", F.struct(*names).alias("yolink_sensors"))


def assemble_snapshot(
    parts: Parts,
    season_start: date,
    season_end: date,
    as_of: datetime,
    replay_delay: int = REPLAY_DELAY_SECONDS,
    part_items: int = PART_ITEMS,
) -> DataFrame:
    """Nest all parts into documents: a row per series, or more for long lists, and one without a series
    for the sensors, which belong to the site and not to a series. Parts without rows give NULL, hence
    absent keys; ``part`` is absent in first documents."""
    frames = {"measurements": (parts.measurements, ["series"], "timestamp")}
    frames |= {name: (df, ["series"], "t") for name, df in parts.levels.items()}
    if parts.analysis is not None:
        frames |= {"segments": (parts.analysis.segments, ["series"], "start_time"),
                   "extrema": (parts.analysis.extrema, ["series"], "timestamp")}
    frames |= {f"sensors {name}": (df, ["device_type"], "t") for name, df in parts.sensors.items()}
    lists = in_parts(frames, part_items)

    key = ["series", "part"]
    rows = _gather(
        lists["measurements"], key, ["timestamp", "id"],
        F.struct(iso_text("timestamp").alias("timestamp"), "water_level_mm"), "measurements")
    names = ["min_level", "max_level", "avg_level", "stddev", "measurement_count"]
    stats = measurement_stats(parts.measurements).select(
        "series", F.lit(0).cast("bigint").alias("part"), *names)
    blocks = [rows, stats]
    for name, minutes, hours in RESOLUTIONS:
        if name in parts.levels:
            data = _gather(lists[name], key, ["t"], _level_item(), "data")
            blocks.append(data.select(*key, _resolution(minutes, hours, F.col("data")).alias(name)))
    if parts.analysis is not None:
        blocks.append(_analysis_documents(parts.analysis, lists["segments"], lists["extrema"]))
    documents = None
    for block in blocks[:1] + blocks[2:]:
        documents = block.select(*key) if documents is None else documents.unionByName(block.select(*key))
    documents = documents.distinct()
    for block in blocks:
        documents = documents.join(block, key, "left")
    documents = documents.withColumn("stats", F.when(F.col("part") == 0, F.struct(*names))).drop(*names)
    if parts.sensors:
        sensors = _sensor_documents({name: lists[f"sensors {name}"] for name in parts.sensors})
        documents = documents.unionByName(sensors, allowMissingColumns=True)
    season = F.struct(
        F.lit(season_start.isoformat()).alias("start"), F.lit(season_end.isoformat()).alias("end"),
        F.lit(season_start <= as_of.date() <= season_end).alias("is_active"))
    documents = documents.withColumns({
        "generated_at": F.lit(as_of.isoformat()), "season": season, "replay_delay_seconds": F.lit(replay_delay),
        "part": F.when(F.col("part") > 0, F.col("part"))})
    return documents.select(*[
        F.col(f.name) if f.name in documents.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SNAPSHOT])


def snapshot_batch(
    messages: DataFrame,
    readings: DataFrame | None,
    season_start: date,
    season_end: date,
    as_of: datetime,
    minutes: int = RAW_MINUTES,
    replay_delay: int = REPLAY_DELAY_SECONDS,
    analysis: bool = True,
    lenient: bool = False,
    on_error: str = "raise",
) -> DataFrame:
    """Build the snapshot from stored tables. A failing part raises; ``lenient`` leaves it out."""

    def guarded(build):
        try:
            return build()
        except PySparkException:
            if not lenient:
                raise
            return None

    def stored(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {name: materialize(df, name) for name, df in frames.items()}

    parts = Parts(
        measurements=materialize(recent_raw(messages, minutes, on_error=on_error), "recent"),
        levels=guarded(lambda: stored(multires_levels(messages, on_error=on_error))) or {},
        sensors={} if readings is None else guarded(lambda: stored(multires_sensors(readings))) or {},
        analysis=guarded(lambda: analyze_segments(messages, on_error=on_error)) if analysis else None,
    )
    return assemble_snapshot(parts, season_start, season_end, as_of, replay_delay)
