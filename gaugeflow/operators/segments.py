"""Consumption segments: from a minimum to the next maximum, their slopes, and the refill forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.times import from_micros
from gaugeflow.operators.chunks import CHUNK_ROWS, each_sample, floor_div, number_rows
from gaugeflow.session import lookup_table, materialize

# Fixed values of the analysis.
MIN_POINTS = 20
MIN_HOURS = 3.0
CURRENT_MIN_HOURS = 1.0
TARGET_MM = 50.0

HOUR_US = 3_600_000_000

# Rows per bin of the interval join between segments and series rows.
BIN_ROWS = 64
BLOCK_ROWS = 65_536

# Row numbers of a block of bins, and the moments kept of bins and blocks.
MOMENT_ROWS = 4_096
MOMENTS = ("w", "x", "y", "xx", "xy")


def next_max(extrema: DataFrame) -> DataFrame:
    """Each minimum with the first maximum strictly after it; several minima may share one.

    Inside a chunk of positions a window looks ahead; beyond it the first maximum of the following
    chunks is carried in a summary table with one row per chunk.
    """
    point = F.struct("mid", "ord", "us", "value")
    top = F.when(F.col("kind") == "max", point)
    marked = extrema.withColumn("chunk", floor_div(F.col("mid"), CHUNK_ROWS)).withColumn("top", top)
    # Ordered backwards, so that "all later rows" is a growing frame.
    ahead = (Window.partitionBy("series", "chunk").orderBy(F.desc("mid"))
             .rowsBetween(Window.unboundedPreceding, -1))
    later = (Window.partitionBy("series").orderBy(F.desc("chunk"))
             .rowsBetween(Window.unboundedPreceding, -1))
    firsts = marked.groupBy("series", "chunk").agg(F.min("top").alias("top"))
    carried = firsts.select(
        "series", "chunk", F.last("top", ignorenulls=True).over(later).alias("carried"))
    return (
        marked.withColumn("next", F.last("top", ignorenulls=True).over(ahead))
        .join(carried, ["series", "chunk"])
        .where(F.col("kind") == "min")
        .select("series", point.alias("begin"), F.coalesce("next", "carried").alias("end"))
        .where(F.col("end").isNotNull())
    )


def series_ends(smooth: DataFrame) -> DataFrame:
    """Last row of every series, shaped as an extremum."""
    last = F.struct(F.col("until").alias("mid"), "ord", "us", F.col("smooth").alias("value"))
    return smooth.groupBy("series").agg(F.max_by(last, "ord").alias("end"))


def current_spans(extrema: DataFrame, ends: DataFrame) -> DataFrame:
    """From the last minimum of each series to its end; a later maximum does not close it."""
    point = F.struct("mid", "ord", "us", "value")
    last = extrema.where(F.col("kind") == "min").groupBy("series").agg(F.max_by(point, "mid").alias("begin"))
    return last.join(ends, "series")


def long_enough(spans: DataFrame, min_points: int, min_hours: float) -> DataFrame:
    """Add ``n_points`` and keep spans that reach both limits."""
    return spans.withColumn("n_points", F.col("end.mid") - F.col("begin.mid") + 1).where(
        (F.col("n_points") >= min_points)
        & (F.col("end.us") - F.col("begin.us") >= round(min_hours * HOUR_US)))


def segment_points(smooth: DataFrame, spans: DataFrame) -> DataFrame:
    """Samples of the series inside each span, one row each.

    An interval join: rows fall in bins of a few row numbers, spans are repeated for the bins they
    cover, and bins are joined by equality, so work follows the covered rows. Spans may overlap.
    A row that stands for several samples comes as many times as samples lie in the span.
    """
    flat = spans.select(
        "series", "is_current", "id", "n_points",
        *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("begin", "end")
          for c in ("mid", "ord", "us", "value")])
    # A long span is first cut into blocks; the blocks are spread out before they are cut into bins.
    blocks = F.sequence(F.expr(f"begin_ord div {BLOCK_ROWS}"), F.expr(f"end_ord div {BLOCK_ROWS}"))
    bins = F.sequence(
        F.expr(f"greatest(begin_ord, block * {BLOCK_ROWS}) div {BIN_ROWS}"),
        F.expr(f"least(end_ord, (block + 1) * {BLOCK_ROWS} - 1) div {BIN_ROWS}"))
    pieces = flat.withColumn("block", F.explode(blocks)).repartition("series", "block").withColumn(
        "bin", F.explode(bins)).drop("block")
    rows = smooth.select("series", "ord", "pos", "until", "us", "smooth",
                         F.expr(f"ord div {BIN_ROWS}").alias("bin"))
    inside = rows.join(pieces, ["series", "bin"]).where(
        (F.col("ord") >= F.col("begin_ord")) & (F.col("ord") <= F.col("end_ord")))
    return each_sample(inside.select(
        *flat.columns, F.greatest("pos", "begin_mid").alias("pos"), F.least("until", "end_mid").alias("until"),
        "us", "smooth"))


def edge_bins(bins: DataFrame, spans: DataFrame) -> DataFrame:
    """Bins in the blocks around both ends of each span: ``inside`` it as a whole, or on its border."""
    ends = F.array_distinct(F.array(
        F.expr(f"begin_ord div {MOMENT_ROWS}") - 1, F.expr(f"begin_ord div {MOMENT_ROWS}"),
        F.expr(f"end_ord div {MOMENT_ROWS}") - 1, F.expr(f"end_ord div {MOMENT_ROWS}")))
    near = spans.withColumn("block", F.explode(ends))
    reach = (F.col("last") >= F.col("begin_ord")) & (F.col("bin") <= F.col("end_ord"))
    return bins.withColumnRenamed("block", "bin_block").join(
        near, [F.col("bin_block") == F.col("block"), F.col("bin_series") == F.col("series")]).where(reach).withColumn(
        "inside", (F.col("bin") > F.col("begin_ord")) & (F.col("last") < F.col("end_ord")))


def span_slopes(smooth: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with the least-squares slope of the value over hours since the span's start.

    A span is put together from moments: of whole blocks of bins in its middle, of whole bins towards
    its ends, and of rows only in the two bins that its ends cut. So what is shuffled does not grow with
    the rows inside the spans. Moments are kept about an origin nearby and moved to the span's start, so
    no digits are lost in long series.
    """
    flat = materialize(spans.select(
        "series", "is_current", "id", "n_points",
        *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("begin", "end")
          for c in ("mid", "ord", "us", "value")]), "spans")
    bins = smooth.where("bin_rows IS NOT NULL").select(
        F.col("series").alias("bin_series"), "bin", (F.col("bin") + F.col("bin_rows") - 1).alias("last"),
        F.expr(f"bin div {MOMENT_ROWS}").alias("block"), F.col("us").alias("us0"), F.col("smooth").alias("y0"),
        *[F.col(f"bin_{m}").alias(f"m_{m}") for m in MOMENTS])
    near = edge_bins(bins, flat)

    # Blocks: the moments of their bins, about the first one's origin.
    first = Window.partitionBy("bin_series", "block").orderBy("bin")
    placed = bins.withColumns({"us1": F.first("us0").over(first), "y1": F.first("y0").over(first)})
    blocks = placed.select(
        "bin_series", "block", F.col("us1").alias("us0"), F.col("y1").alias("y0"),
        *_moved((F.col("us0") - F.col("us1")) / HOUR_US, F.col("y0") - F.col("y1"))
    ).groupBy("bin_series", "block").agg(
        F.first("us0").alias("us0"), F.first("y0").alias("y0"), *[F.sum(f"m_{m}").alias(f"m_{m}") for m in MOMENTS])
    low, high = F.expr(f"begin_ord div {MOMENT_ROWS} + 1"), F.expr(f"end_ord div {MOMENT_ROWS} - 2")
    middle = flat.where(low <= high).withColumn("at", F.explode(F.sequence(low, high)))
    whole = blocks.join(middle, [F.col("block") == F.col("at"), F.col("bin_series") == F.col("series")])

    # Rows of the two bins that the ends of a span cut.
    cut = lookup_table(near.where("NOT inside").select(*flat.columns, "bin"), "cut")
    rows = smooth.select("series", "bin", "ord", "pos", "until", F.col("us").alias("us0"), F.col("smooth").alias("y0"))
    weight = (F.least("until", "end_mid") - F.greatest("pos", "begin_mid") + 1).cast("double")
    zero = F.lit(0.0)
    single = rows.join(cut, ["series", "bin"]).where(F.col("ord").between(F.col("begin_ord"), F.col("end_ord"))).select(
        *flat.columns, "us0", "y0", weight.alias("m_w"), *[zero.alias(f"m_{m}") for m in MOMENTS[1:]])

    pieces = single
    for part in (near.where("inside"), whole):
        pieces = pieces.unionByName(part.select(*flat.columns, "us0", "y0", *[f"m_{m}" for m in MOMENTS]))
    moved = pieces.select(*flat.columns, *_moved(
        (F.col("us0") - F.col("begin_us")) / HOUR_US, F.col("y0") - F.col("begin_value")))
    key = ["series", "begin_mid", "is_current"]
    sums = moved.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in flat.columns if c not in key], *[F.sum(f"m_{m}").alias(m) for m in MOMENTS])
    return sums.select(*flat.columns, F.expr("try_divide(xy - x * y / w, xx - x * x / w)").alias("slope_mm_per_hr"))


def _moved(dx, dy) -> list:
    """Moments about an origin that lies ``dx`` and ``dy`` before that of the columns ``m_*``."""
    w, x, y, xx, xy = (F.col(f"m_{m}") for m in MOMENTS)
    values = (w, x + w * dx, y + w * dy, xx + 2 * dx * x + w * dx * dx, xy + dx * y + dy * x + w * dx * dy)
    return [value.alias(f"m_{m}") for m, value in zip(MOMENTS, values)]


def candidate_spans(
    smooth: DataFrame, extrema: DataFrame, min_points: int = MIN_POINTS,
    min_hours: float = MIN_HOURS, current_min_hours: float = CURRENT_MIN_HOURS,
) -> DataFrame:
    """Completed spans (numbered in time order) and current spans that are long enough."""
    done = long_enough(next_max(extrema), min_points, min_hours).withColumn(
        "chunk", floor_div(F.col("begin.mid"), CHUNK_ROWS)
    ).withColumn("at", F.col("begin.mid"))
    done = number_rows(materialize(done, "spans"), "at", {"id": F.lit(1)})
    current = long_enough(current_spans(extrema, series_ends(smooth)), min_points, current_min_hours)
    return done.select(
        "series", "begin", "end", "n_points", (F.col("id") + 1).alias("id"),
        F.lit(False).alias("is_current"),
    ).unionByName(current.select(
        "series", "begin", "end", "n_points", F.lit(None).cast("bigint").alias("id"),
        F.lit(True).alias("is_current")))


def find_segments(
    smooth: DataFrame,
    extrema: DataFrame,
    min_points: int = MIN_POINTS,
    min_hours: float = MIN_HOURS,
    current_min_hours: float = CURRENT_MIN_HOURS,
) -> DataFrame:
    """Rising segments of every series, completed ones and the current one.

    ``id`` numbers the completed spans that are long enough, before the slope is looked at, so
    numbers may be missing; the current segment's id is one more than the number of completed
    segments kept, and may repeat another id. (series, begin_index, is_current) is unique.
    """
    spans = candidate_spans(smooth, extrema, min_points, min_hours, current_min_hours)
    rising = materialize(span_slopes(smooth, spans).where(F.col("slope_mm_per_hr") > 0), "segments")
    kept = rising.groupBy("series").agg(F.count(F.when(~F.col("is_current"), 1)).alias("kept"))
    return rising.join(kept, "series").select(
        "series",
        F.coalesce("id", F.col("kept") + 1).alias("id"),
        from_micros("begin_us").alias("start_time"),
        from_micros("end_us").alias("end_time"),
        F.col("begin_value").alias("start_distance_mm"),
        F.col("end_value").alias("end_distance_mm"),
        "slope_mm_per_hr",
        ((F.col("end_us") - F.col("begin_us")) / HOUR_US).alias("duration_hours"),
        "n_points", "is_current",
        F.col("begin_mid").alias("begin_index"),
    )


def refill_prediction(segments: DataFrame, target: float = TARGET_MM) -> DataFrame:
    """When the current segment's line reaches the target; no row if it is reached already."""
    left = F.lit(target) - F.col("end_distance_mm")
    hours = left / F.col("slope_mm_per_hr")
    seconds = F.round(hours * 3600, 6).cast("decimal(18,6)")
    return segments.where(F.col("is_current") & (left > 0)).select(
        "series",
        F.col("end_distance_mm").alias("current_distance_mm"),
        "slope_mm_per_hr",
        hours.alias("time_to_50mm_hours"),
        (F.col("end_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))
        .alias("predicted_refill_time"),
    )
