"""Time columns: bucket starts, epoch micros, text forms. None depends on the session time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: buckets are aligned to Monday 2000-01-03 00:00:00, in seconds since 1970-01-01.
BUCKET_ORIGIN_SECONDS = 946_857_600

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
US = 1_000_000
_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def moment(value: datetime) -> Column:
    """Zone-less timestamp literal, whatever the zones of driver and session are."""
    return F.expr(f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'")


def interval(seconds: float) -> Column:
    """Day-time interval literal with microsecond precision."""
    micros = round(seconds * US)
    return F.expr(f"make_dt_interval(0, 0, 0, CAST({micros} AS DECIMAL(24, 6)) / 1000000)")


def bucket_start(ts: str | Column, minutes: int) -> Column:
    """Start of the fixed-width bucket a timestamp falls in (left-closed)."""
    seconds = minutes * 60
    offset = BUCKET_ORIGIN_SECONDS % seconds
    width = f"{seconds} seconds"
    return F.window(ts, width, width, f"{offset} seconds")["start"]


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, as BIGINT."""
    column = F.col(ts) if isinstance(ts, str) else ts
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone") in _UTC:
        # The zoned type has the same micros then, and the cast costs nothing.
        return F.unix_micros(column.cast("timestamp_ntz").cast("timestamp"))
    seconds = (column - F.expr(_EPOCH)).cast("interval second").cast("decimal(18,6)").cast("double")
    return F.round(seconds * US).cast("bigint")


def from_micros(us: str | Column) -> Column:
    """Inverse of :func:`micros`."""
    column = F.col(us) if isinstance(us, str) else us
    seconds = (column.cast("decimal(24,6)") / F.lit(US)).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def iso_text(ts: str | Column) -> Column:
    """ISO-8601 text; the fraction is written only when it is not zero."""
    text = (F.col(ts) if isinstance(ts, str) else ts).cast("string")
    fraction = F.when(F.length(text) > 19, F.rpad(F.substring(text, 20, 7), 7, "0")).otherwise("")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), fraction)


def year_month(ts: str | Column) -> Column:
    return F.substring((F.col(ts) if isinstance(ts, str) else ts).cast("string"), 1, 7)


def countdown_text(target: str | Column, as_of: str | Column) -> Column:
    """Remaining time as HH:MM:SS; hours may pass 99, past targets give 00:00:00."""
    left = F.greatest(F.floor((micros(target) - micros(as_of)) / US), F.lit(0))

    def two(value: Column) -> Column:
        text = value.cast("bigint").cast("string")
        return F.when(F.length(text) < 2, F.concat(F.lit("0"), text)).otherwise(text)

    return F.concat_ws(":", two(F.floor(left / 3600)), two(F.floor((left % 3600) / 60)), two(left % 60))
