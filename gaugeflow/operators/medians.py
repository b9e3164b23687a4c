"""Centred rolling medians, exact medians of large groups, and robust outlier removal.

Series frames have the columns ``series``, ``us`` (microseconds), ``value`` and ``n``, the number of
equal rows this one stands for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.times import from_micros, micros
from gaugeflow.functions.values import cast_value
from gaugeflow.operators.chunks import floor_div, over_groups
from gaugeflow.session import lookup_table, materialize, measured

# Fixed values of the analysis.
ROLL_SECONDS = 300
SMOOTH_SECONDS = 600
MAD_MULTIPLE = 6.0

DAY_US = 86_400_000_000

# Up to this many values in every frame they are sorted side by side.
SHORT_RANGE = 32

# Per-series values of this many series are broadcast without being measured: a name and two numbers each.
FEW_SERIES = 50_000

# Rows of a series that are put in order for its median, and the parts of a bin that holds more.
ORDERED_ROWS = 500_000
SPLITS = 4096

# A chunk is made shorter than a day when a series is so dense that more rows would fall in it.
TARGET_CHUNK_ROWS = 100_000


def series_values(messages: DataFrame, on_error: str = "raise") -> DataFrame:
    """Messages with a payload as (series, us, value, n), one row each."""
    return messages.where(F.col("payload").isNotNull() & F.col("timestamp").isNotNull()).select(
        F.col("topic").alias("series"), micros("timestamp").alias("us"),
        cast_value("payload", on_error).alias("value"), F.lit(1).cast("bigint").alias("n"))


def collapse(values: DataFrame) -> DataFrame:
    """Equal rows of a series as one, with their number; they combine on the map side."""
    return values.groupBy("series", "us", "value").agg(F.sum("n").alias("n"))


def expand(rows: DataFrame) -> DataFrame:
    """Rows with a number ``n`` as that many rows with 1: what leaves the analysis looks the same whether
    equal rows were collapsed on the way or not."""
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).drop("_copy").withColumn(
        "n", F.lit(1).cast("bigint"))


@dataclass
class Density:
    """How rows lie on the time axis: ``counts`` is (series, rows), ``series`` the number of series,
    ``densest`` the most rows of one series within half a window, ``chunk_us`` a safe chunk."""

    counts: DataFrame
    series: int
    densest: int
    chunk_us: int


def series_density(values: DataFrame, half_us: int) -> Density:
    """One small aggregate over series and time.

    A chunk is a day, or less if the densest half-window forces it: a chunk of k slots has at most
    k times the rows of the densest slot. The slot itself is the shortest possible chunk.
    """
    slot = floor_div(F.col("us"), half_us)
    slots = values.groupBy("series", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("held"), F.sum("n").alias("n"))
    counts, seen = measured(
        slots.groupBy("series").agg(F.sum("n").alias("rows"), F.max("held").alias("densest")),
        "density", densest=F.max("densest"))
    densest = seen["densest"] or 0
    slots_per_chunk = max(1, min(DAY_US // half_us, TARGET_CHUNK_ROWS // (densest or 1)))
    return Density(counts.select("series", "rows"), seen["rows"], densest, slots_per_chunk * half_us)


def prepare_values(values: DataFrame, half_us: int) -> tuple[DataFrame, Density]:
    """Values ready for chunked work, with their density.

    Only when some half-window holds more rows than a chunk should are equal rows collapsed, at
    the price of one more shuffle; a group of copies, whatever its size, is one row after that.
    """
    density = series_density(values, half_us)
    if density.densest <= TARGET_CHUNK_ROWS:
        return values, density
    stored = materialize(collapse(values), "values")
    return stored, series_density(stored, half_us)


def weighted_range_medians(
    values: np.ndarray, weights: np.ndarray, lo: np.ndarray, hi: np.ndarray,
) -> np.ndarray:
    """Median of ``values[lo[i]:hi[i]]`` for every i, each value counted ``weights`` times.

    All ranges descend together through the bits of the value ranks: at each bit the sequence is
    split stably into zeros and ones, and prefix sums of the weights tell which half holds the
    wanted rank. The cost is rows x bits, independent of how long the ranges are.
    """
    longest = int((hi - lo).max(initial=0))
    if longest <= SHORT_RANGE and (weights == 1).all():
        return _short_range_medians(values, lo, hi, longest)
    distinct, rank = np.unique(values, return_inverse=True)
    rank = rank.astype(np.int64)
    total = np.concatenate(([0], np.cumsum(weights)))
    size = total[hi] - total[lo]
    # Both middle ranks; they coincide for an odd size.
    left = np.concatenate((lo, lo))
    right = np.concatenate((hi, hi))
    wanted = np.concatenate(((size - 1) // 2, size // 2))
    found = np.zeros(len(wanted), dtype=np.int64)
    current, weight = rank, weights
    for bit in range(max(1, int(len(distinct) - 1).bit_length()) - 1, -1, -1):
        is_zero = ((current >> bit) & 1) == 0
        zeros = np.concatenate(([0], np.cumsum(is_zero)))
        zero_weight = np.concatenate(([0], np.cumsum(np.where(is_zero, weight, 0))))
        low = zero_weight[right] - zero_weight[left]
        go_low = wanted < low
        zl, zr = zeros[left], zeros[right]
        left = np.where(go_low, zl, zeros[-1] + left - zl)
        right = np.where(go_low, zr, zeros[-1] + right - zr)
        wanted = np.where(go_low, wanted, wanted - low)
        found |= np.where(go_low, 0, 1 << bit)
        order = np.concatenate((np.flatnonzero(is_zero), np.flatnonzero(~is_zero)))
        current, weight = current[order], weight[order]
    middle = distinct[found]
    half = len(lo)
    return (middle[:half] + middle[half:]) / 2.0


def _short_range_medians(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, longest: int) -> np.ndarray:
    """The same for ranges of a few unweighted values: sort them side by side."""
    at = lo[:, None] + np.arange(longest)
    rows = np.where(at < hi[:, None], values[np.minimum(at, len(values) - 1)], np.inf)
    rows.sort(axis=1)
    size = hi - lo
    each = np.arange(len(lo))
    return (rows[each, (size - 1) // 2] + rows[each, size // 2]) / 2.0


def _rolling(half: int, length: int, per_instant: bool, extend):
    """Group function: rolling medians of the rows that belong to their chunk."""

    def compute(table: pa.Table, first: np.ndarray) -> pa.Table:
        us = table.column("us").to_numpy()
        chunk = table.column("chunk").to_numpy()
        value = table.column("value").to_numpy()
        n = table.column("n").to_numpy()
        # One rising key for all groups; groups lie further apart than half a window.
        key = (np.cumsum(first) - 1) * (length + 4 * half + 2) + (us - chunk * length + half)
        core = np.flatnonzero(us // length == chunk)
        instant, start, inverse = np.unique(key[core], return_index=True, return_inverse=True)
        lo = np.searchsorted(key, instant - half, side="right")
        hi = np.searchsorted(key, instant + half, side="right")
        median = weighted_range_medians(value, n, lo, hi)
        if per_instant:
            rows = core[start]
            n = np.add.reduceat(n[core], start) if len(core) else n[:0]
            out = {"n": n, "local_median": median}
        else:
            rows = core
            out = {"value": value[rows], "n": n[rows], "local_median": median[inverse]}
        result = pa.table({
            "series": table.column("series").take(pa.array(rows)),
            "chunk": chunk[rows], "us": us[rows], **out,
        })
        return extend(result) if extend else result

    return over_groups(compute, ("series", "chunk"))


def rolling_median(
    df: DataFrame,
    width_seconds: float,
    per_instant: bool = False,
    chunk_us: int | None = None,
    extend: Callable[[pa.Table], pa.Table] | None = None,
    extra_schema: str = "",
) -> DataFrame:
    """Median over the centred frame (t - w/2, t + w/2], equal times included.

    Rows within half a window of a chunk border are sent to both chunks, so every frame is whole
    in its chunk. ``per_instant`` returns one row per series and time instead of one per value.
    ``extend`` may add columns (``extra_schema``) to the result rows of whole chunks.
    """
    half = round(width_seconds * 500_000)
    length = chunk_us or series_density(df, half).chunk_us
    if length < half:
        raise ValueError("a chunk must be at least half a window long")

    def chunk_of(shift: int):
        return floor_div(F.col("us") + shift, length)

    spread = (
        df.select(
            "series", "us", "value", "n",
            F.explode(F.array_distinct(F.array(chunk_of(-half), chunk_of(0), chunk_of(half))))
            .alias("chunk"))
        .repartition("series", "chunk")
        .sortWithinPartitions("chunk", "series", "us")
    )
    value = "" if per_instant else "value DOUBLE, "
    schema = f"series STRING, chunk BIGINT, us BIGINT, {value}n BIGINT, local_median DOUBLE{extra_schema}"
    return spread.mapInArrow(_rolling(half, length, per_instant, extend), schema)


def exact_median(df: DataFrame, value: str, weight: str = "n") -> DataFrame:
    """Exact weighted median per series, as (series, median); no task holds a whole series. ``df`` should be
    a stored table, since it is read once per round. Null values do not count.

    A histogram over a monotone, purely arithmetic bin (sign and scaled logarithm) has a bounded number of rows
    per series and shows which bins hold the two middle ranks. Ranks in two bins are the highest value of
    one and the lowest of the next, and a bin of one value is that value; both settle a series. Every other
    series goes on with the one bin left to it, split evenly between its lowest and its highest value, until
    that bin has at most ``ORDERED_ROWS`` rows; only these are ordered. Equal doubles can not be split but
    settle, and a round narrows a bin by ``SPLITS``, so even doubles next to each other end after a few rounds.
    """
    rows = df.select("series", F.col(value).alias("v"), F.col(weight).alias("n")).where("v IS NOT NULL")
    whole = Window.partitionBy("series")
    total = F.sum("n").over(whole)
    spans, seen = _middle_bins(
        _histogram(rows.withColumn("bin", _bin(F.col("v"))), "series", "bin")
        .withColumns({"lo": F.call_function("div", total - 1, F.lit(2)), "hi": F.call_function("div", total, F.lit(2))}))
    found = spans.where("median IS NOT NULL").select("series", "median")
    while seen["open"]:
        left = per_series(spans.where("median IS NULL").select("series", "low", "high", "lo", "hi"), "open", seen["rows"])
        inside = rows.join(left, "series").where("v BETWEEN low AND high")
        if seen["open"] <= ORDERED_ROWS:
            return found.unionByName(_ordered_median(inside))
        part = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * SPLITS), F.lit(SPLITS - 1))
        spans, seen = _middle_bins(_histogram(inside.withColumn("bin", part), "series", "lo", "hi", "bin"))
        found = found.unionByName(spans.where("median IS NOT NULL").select("series", "median"))
    return found


def _histogram(binned: DataFrame, *keys: str) -> DataFrame:
    return binned.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))


def _middle_bins(histogram: DataFrame) -> tuple[DataFrame, dict]:
    """The bin that holds the ranks ``lo`` and ``hi`` of a series, with both counted from its start, or the
    ``median`` where two bins hold them or the bin is one value. ``open`` is the most rows of a bin without one."""
    earlier = Window.partitionBy("series").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = histogram.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    lower, upper = (F.expr(f"before <= {rank} AND {rank} < before + n") for rank in ("lo", "hi"))
    bins = ranked.where(lower | upper).groupBy("series").agg(
        F.count(F.lit(1)).alias("bins"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.max(F.when(lower, F.col("high"))).alias("last"), F.max(F.when(upper, F.col("low"))).alias("first"),
        F.max(F.when(lower, F.col("lo") - F.col("before"))).alias("lo"),
        F.max(F.when(upper, F.col("hi") - F.col("before"))).alias("hi"), F.max("rows").alias("rows"))
    spans = bins.withColumn("median", F.when(F.col("bins") == 2, (F.col("last") + F.col("first")) / 2).when(
        F.col("low") == F.col("high"), F.col("low")))
    return measured(spans, "middle", open=F.max(F.when(F.col("median").isNull(), F.col("rows"))))


def _ordered_median(inside: DataFrame) -> DataFrame:
    earlier = Window.partitionBy("series").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = inside.groupBy("series", "lo", "hi", "v").agg(F.sum("n").alias("n")).withColumn(
        "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return placed.groupBy("series").agg(
        ((F.max(F.expr("CASE WHEN at <= lo AND lo < at + n THEN v END"))
          + F.max(F.expr("CASE WHEN at <= hi AND hi < at + n THEN v END"))) / 2).alias("median"))


def _bin(v):
    """Histogram bin of a double: rises with v, about 0.02 % wide."""
    size = F.when(F.abs(v) == float("inf"), F.lit(1 << 40)).otherwise(
        F.floor(F.log2(F.abs(v)) * 4096).cast("bigint") + 8_388_608)
    return F.when(v == 0, F.lit(0).cast("bigint")).otherwise(size * F.signum(v).cast("bigint"))


def per_series(df: DataFrame, label: str, series: int | None = None) -> DataFrame:
    """A table with a row per series as the small side of a join: broadcast if that many series are few,
    else measured first."""
    return F.broadcast(df) if series is not None and series <= FEW_SERIES else lookup_table(df, label)


def mad_scale(residuals: DataFrame, series: int | None = None) -> DataFrame:
    """(series, scale): median absolute deviation from the median, or the population deviation
    where that is 0. ``residuals`` has series, residual and n, and should be a stored table; ``series`` is
    the number of series where it is known."""
    narrow = residuals.select("series", "residual", "n")
    centre = per_series(exact_median(narrow, "residual"), "centre", series)
    moved = narrow.join(centre, "series").select(
        "series", "n", (F.col("residual") - F.col("median")).alias("d"),
        F.abs(F.col("residual") - F.col("median")).alias("deviation"))
    count, first, second = F.sum("n"), F.sum(F.expr("n * d")), F.sum(F.expr("n * d * d"))
    spread = F.sqrt(F.greatest(second / count - (first / count) * (first / count), F.lit(0.0)))
    both = exact_median(moved, "deviation").join(moved.groupBy("series").agg(spread.alias("spread")), "series")
    return both.select(
        "series", F.when(F.col("median") == 0, F.col("spread")).otherwise(F.col("median")).alias("scale"))


def residuals(df: DataFrame, width_seconds: float = ROLL_SECONDS, chunk_us: int | None = None) -> DataFrame:
    """Rows with their local median and ``residual`` = value - median."""
    return rolling_median(df, width_seconds, chunk_us=chunk_us).withColumn(
        "residual", F.col("value") - F.col("local_median"))


def mark_outliers(stored: DataFrame, scale: DataFrame, multiple: float = MAD_MULTIPLE) -> DataFrame:
    """Add ``is_outlier``: the residual is strictly larger than ``multiple`` scales."""
    return stored.join(scale, "series").withColumn(
        "is_outlier", F.abs("residual") > F.col("scale") * multiple)


def with_rolling_median(messages: DataFrame, width_seconds: float = ROLL_SECONDS,
                        on_error: str = "raise") -> DataFrame:
    """Message rows with a numeric ``value`` and their ``local_median``."""
    rows = messages.where(F.col("payload").isNotNull()).select(
        "id", F.col("topic").alias("series"), "timestamp", cast_value("payload", on_error).alias("value"))
    values, density = prepare_values(series_values(messages, on_error), round(width_seconds * 500_000))
    medians = rolling_median(
        values.where(~F.isnan("value")), width_seconds, per_instant=True, chunk_us=density.chunk_us,
    ).select(
        "series", from_micros("us").alias("timestamp"), "local_median")
    return rows.join(medians, ["series", "timestamp"], "left")
