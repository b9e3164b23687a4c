"""Payload decoding, numeric casts, unit conversion and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: millilitres of water per millimetre of distance.
ML_PER_MM = -25.125

# Text that is a number. Spark's cast alone would also take '5d' or a hexadecimal float, so text
# with one of these letters is checked.
_NUMBER = r"(?i)^\s*[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity|nan)\s*$"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def decode_payload(payload: str | Column) -> Column:
    """Bytes as UTF-8 text, or as lower-case hex when they are not valid UTF-8."""
    raw = _col(payload)
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.lower(F.hex(raw)))


def cast_value(payload: str | Column, on_error: str = "raise") -> Column:
    """Text payload as DOUBLE. Bad text fails the query, or becomes NULL with ``on_error='null'``."""
    text = _col(payload)
    plain = ~text.rlike("[dDfFxX]") | text.rlike(_NUMBER)
    number = F.when(plain, text.try_cast("double"))
    if on_error == "null":
        return number
    if on_error != "raise":
        raise ValueError("on_error must be 'raise' or 'null'")
    bad = F.raise_error(F.concat(F.lit("payload is not a number: "), text)).cast("double")
    return F.when(text.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(number, bad))


def round_decimal(value: str | Column, digits: int) -> Column:
    """Round the exact binary value half to even, as IEEE-correct decimal rounding does.

    ``round`` and ``bround`` work on the shortest decimal text of a double, so they treat 2.675 as
    a tie although its binary value lies below it. Here the product with 10**digits is split into
    a rounded part and its exact error, and the error decides the apparent ties.
    """
    x = _col(value)
    scale = float(10 ** digits)
    product = x * scale
    splitter = x * 134217729.0
    high = splitter - (splitter - x)
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product).cast("double")
    tie = (product - below) == 0.5
    up = below + 1.0
    whole = (
        F.when(tie & (error < 0), below).when(tie & (error > 0), up).otherwise(F.rint(product))
    )
    return F.when(F.abs(x) < 1e12, whole / scale).otherwise(x)


def mm_to_ml(mm: str | Column) -> Column:
    return _col(mm) * ML_PER_MM


def ml_to_mm(ml: str | Column) -> Column:
    return _col(ml) / ML_PER_MM


def celsius_to_fahrenheit(celsius: str | Column) -> Column:
    return _col(celsius) * 9 / 5 + 32


def level_health(level_mm: str | Column) -> Column:
    """'needs water' above 50, 'warning' from 40, otherwise (also for NULL) 'good'."""
    level = _col(level_mm)
    return F.when(level > 50, "needs water").when(level >= 40, "warning").otherwise("good")
