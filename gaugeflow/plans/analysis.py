"""The whole segment analysis: outliers, smoothing, extrema, segments, forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.times import from_micros
from gaugeflow.operators import extrema as X
from gaugeflow.operators import medians as M
from gaugeflow.operators import segments as S
from gaugeflow.session import materialize

# Fewer rows, or fewer rows after outlier removal, give no analysis.
MIN_ROWS = 100
MIN_CLEAN_ROWS = 50


@dataclass
class Analysis:
    """Results by series. ``series`` lists those that had enough data."""

    series: DataFrame
    segments: DataFrame
    extrema: DataFrame
    prediction: DataFrame


def clean_values(
    values: DataFrame,
    density: M.Density,
    roll_seconds: float = M.ROLL_SECONDS,
    multiple: float = M.MAD_MULTIPLE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """(series, us, value, n) without outliers, for series with at least ``min_rows`` rows."""
    numbers = values.where(~F.isnan("value"))
    residuals = materialize(M.residuals(numbers, roll_seconds, density.chunk_us), "residuals")
    enough = density.counts.where(F.col("rows") >= min_rows).select("series")
    scale = M.per_series(M.mad_scale(residuals, density.series).join(enough, "series"), "scale", density.series)
    marked = M.mark_outliers(residuals, scale, multiple)
    return marked.where(~F.col("is_outlier")).select("series", "us", "value", "n")


def smooth_series(
    clean: DataFrame,
    chunk_us: int,
    smooth_seconds: float = M.SMOOTH_SECONDS,
    min_rows: int = MIN_CLEAN_ROWS,
) -> DataFrame:
    """Smooth series, one row per time, with row numbers, sample positions and runs."""
    instants = M.rolling_median(
        clean, smooth_seconds, per_instant=True, chunk_us=chunk_us,
        extend=X.describe_runs, extra_schema=X.RUN_SCHEMA)
    return X.place_chunks(materialize(instants, "smooth"), min_rows)


def smooth_from_messages(
    messages: DataFrame,
    roll_seconds: float = M.ROLL_SECONDS,
    smooth_seconds: float = M.SMOOTH_SECONDS,
    multiple: float = M.MAD_MULTIPLE,
    on_error: str = "raise",
) -> DataFrame:
    # One chunk length serves both medians: the wider window decides.
    half_us = round(max(roll_seconds, smooth_seconds) * 500_000)
    values, density = M.prepare_values(M.series_values(messages, on_error), half_us)
    clean = clean_values(values, density, roll_seconds, multiple)
    return smooth_series(clean, density.chunk_us, smooth_seconds)


def analyze_segments(
    messages: DataFrame,
    roll_seconds: float = M.ROLL_SECONDS,
    mad_multiple: float = M.MAD_MULTIPLE,
    smooth_seconds: float = M.SMOOTH_SECONDS,
    prominence: float = X.PROMINENCE,
    distance: int = X.DISTANCE,
    min_points: int = S.MIN_POINTS,
    min_hours: float = S.MIN_HOURS,
    current_min_hours: float = S.CURRENT_MIN_HOURS,
    target: float = S.TARGET_MM,
    on_error: str = "raise",
) -> Analysis:
    """Segments, extrema and forecast of every topic of a message table."""
    smooth = smooth_from_messages(messages, roll_seconds, smooth_seconds, mad_multiple, on_error)
    found = materialize(X.find_extrema(smooth, prominence, distance), "extrema")
    segments = S.find_segments(smooth, found, min_points, min_hours, current_min_hours)
    points = found.select(
        "series", "kind", from_micros("us").alias("timestamp"), F.col("value").alias("distance_mm"),
        "prominence", F.col("mid").alias("index"))
    return Analysis(
        series=smooth.select("series").distinct(),
        segments=segments,
        extrema=points,
        prediction=S.refill_prediction(segments, target),
    )
