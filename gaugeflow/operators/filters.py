"""Selections: look-back windows, topic queries, season and replay predicates, top-n rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.times import interval, moment
from gaugeflow.functions.values import cast_value
from gaugeflow.session import broadcast_if, measured, row_bytes


@dataclass
class Newest:
    """The newest time of every key, stored: ``table`` has the keys and ``_newest``."""

    table: DataFrame
    rows: int
    size: int | None
    earliest: datetime | None


def newest_per_key(df: DataFrame, keys: tuple[str, ...], ts: str = "timestamp") -> Newest:
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    table, seen = measured(newest, "newest", earliest=F.min("_newest"), bytes=F.sum(row_bytes(newest)))
    return Newest(table, seen["rows"], seen["bytes"], seen["earliest"])


def lookback(
    df: DataFrame,
    seconds: float | None,
    keys: tuple[str, ...] = (),
    ts: str = "timestamp",
    as_of: datetime | None = None,
    newest: Newest | None = None,
) -> DataFrame:
    """Rows with ``ts >= max(ts) - seconds``: data time, not the clock.

    Without ``keys`` there is one bound for the table, with ``keys`` one for every key, taken from
    a partial aggregate of two columns; rows whose other columns are NULL count for it. The bound
    (for keys: the earliest one) is read first and used as a literal, so that it reaches the file
    scan as a pushed filter and a short look-back does not read a long history. ``as_of`` replaces
    the maximum and saves that read, and so does ``newest`` for several look-backs over one table.
    ``seconds=None`` keeps all rows.
    """
    if seconds is None:
        return df
    if as_of is None and not keys:
        as_of = df.agg(F.max(ts)).first()[0]
        if as_of is None:
            return df.where(F.lit(False))
    if as_of is not None:
        return df.where(F.col(ts) >= moment(as_of - timedelta(seconds=seconds)))
    newest = newest or newest_per_key(df, keys, ts)
    if newest.earliest is None:
        return df.where(F.lit(False))
    bounds = newest.table.select(*keys, (F.col("_newest") - interval(seconds)).alias("_from"))
    recent = df.where(F.col(ts) >= moment(newest.earliest - timedelta(seconds=seconds)))
    return recent.join(broadcast_if(bounds, newest.rows, newest.size), list(keys)).where(
        F.col(ts) >= F.col("_from")).drop("_from")


def recent_raw(df: DataFrame, minutes: int = 10, topic: str | None = None,
               on_error: str = "raise") -> DataFrame:
    """Raw values of the last minutes of every topic (or of one), ascending; NULL payloads stay."""
    if topic is not None:
        rows = lookback(df.where(F.col("topic") == topic), minutes * 60)
    else:
        rows = lookback(df, minutes * 60, ("topic",))
    return rows.select(
        F.col("topic").alias("series"), "timestamp", "id",
        cast_value("payload", on_error).alias("water_level_mm"),
    ).orderBy("series", "timestamp", "id")


def like(column: str, pattern: str) -> Column:
    """LIKE without an escape character: '%' and '_' are wildcards, a backslash is itself."""
    free = next(c for c in map(chr, range(1, 0x110000)) if c not in pattern)
    return F.col(column).like(pattern) if "\\" not in pattern else F.like(
        F.col(column), F.lit(pattern), F.lit(free))


def query_messages(
    df: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    topic_like: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Messages in an inclusive time range whose topic is LIKE a pattern, newest first."""
    if start:
        df = df.where(F.col("timestamp") >= moment(start))
    if end:
        df = df.where(F.col("timestamp") <= moment(end))
    if topic_like:
        df = df.where(like("topic", topic_like))
    df = df.orderBy(F.desc("timestamp"), F.desc("id"))
    return df.limit(limit) if limit else df


def season_flag(day: str | Column, start: date, end: date) -> Column:
    """True from the start day to the end day, both included."""
    column = F.col(day) if isinstance(day, str) else day
    return column.between(F.lit(start), F.lit(end))


def replay_visible(df: DataFrame, as_of: datetime | Column, delay_seconds: float = 300) -> DataFrame:
    """Rows that are at least ``delay_seconds`` old at ``as_of``."""
    now = as_of if isinstance(as_of, Column) else moment(as_of)
    return df.where(F.col("timestamp") <= now - interval(delay_seconds))


def last_rows(df: DataFrame, n: int = 500, keys: tuple[str, ...] = (),
              order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """The latest n rows (of every key), ascending.

    The filter on the row number becomes a group limit before the shuffle (for n up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``), so a task sends at most n rows of a key.
    """
    newest = [F.desc(c) for c in order]
    if not keys:
        return df.orderBy(*newest).limit(n).orderBy(*order)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank").orderBy(*keys, *order)
