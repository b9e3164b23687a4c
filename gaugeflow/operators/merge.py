"""Merging two generations of a table: canonical columns, deduplicated append, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow import schemas

# The columns that make a row of each table kind known already.
MESSAGE_KEY = ("timestamp", "topic")
READING_KEY = ("timestamp", "device_id", "device_type")
# Fixed value: a table with this in its name holds readings, whatever its columns.
READING_NAME = "yolink"


def classify_table(name: str, columns: Sequence[str]) -> str:
    """'readings' by name or by having device id and type, else 'messages'."""
    by_columns = {"device_id", "device_type"} <= set(columns)
    return "readings" if READING_NAME in name.lower() or by_columns else "messages"


def canonical_schema(kind: str) -> T.StructType:
    schema = schemas.READINGS if kind == "readings" else schemas.MESSAGES
    return T.StructType([f for f in schema if f.name != "id"])


def conform_schema(df: DataFrame, kind: str) -> DataFrame | None:
    """Project to the canonical columns, NULL where missing, and keep ``id`` for tie-breaks.

    A readings source without the key columns cannot be used: the result is None.
    """
    present = set(df.columns)
    if kind == "readings" and not set(READING_KEY) <= present:
        return None
    columns = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in canonical_schema(kind)
    ]
    ident = F.col("id") if "id" in present else F.lit(None)
    return df.select(ident.cast("bigint").alias("id"), *columns)


def first_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the one with the lowest id. A group of copies shrinks on the map side.

    Rows without an id come after those with one; among equal ids the least row by its other columns
    is taken, so the choice does not change from run to run.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(F.col("id").isNull().alias("_no_id"), "id", *[c for c in rest if c != "id"])
    best = df.groupBy(*keys).agg(F.min(row).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def new_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is neither in ``old`` nor earlier in ``new``.

    Both sides are reduced to one row per key first; these aggregations leave both hashed on the
    key, so the anti-join needs no further shuffle and meets no hot key.
    """
    known = old.select(*keys).distinct()
    return first_per_key(new, keys).join(known, list(keys), "left_anti")


def merge_dedup(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """All old rows, plus the new rows with unknown keys; and the old/new/merged counts.

    Rows get their surrogate ids when they are stored again, so the result has none.
    """
    columns = [c for c in old.columns if c != "id"]
    added = new_rows(old, new, keys)
    merged = old.select(*columns).unionByName(added.select(*columns))
    counts = (
        old.select(F.lit("old").alias("part"))
        .unionByName(new.select(F.lit("new").alias("part")))
        .unionByName(added.select(F.lit("added").alias("part")))
        .groupBy().agg(
            F.count(F.when(F.col("part") == "old", 1)).alias("old_count"),
            F.count(F.when(F.col("part") == "new", 1)).alias("new_count"),
            F.count(F.when(F.col("part").isin("old", "added"), 1)).alias("merged_count"),
        )
    )
    return merged, counts


def merge_table(name: str, old: DataFrame | None, new: DataFrame | None) -> DataFrame | None:
    """Merge one named table of which either generation may be missing or unusable."""
    first = old if old is not None else new
    if first is None:
        return None
    kind = classify_table(name, first.columns)
    keys = READING_KEY if kind == "readings" else MESSAGE_KEY
    old = None if old is None else conform_schema(old, kind)
    new = None if new is None else conform_schema(new, kind)
    if new is None:
        return None if old is None else old.drop("id")
    if old is None:
        return first_per_key(new, keys).drop("id")
    return merge_dedup(old, new, keys)[0]


def merge_names(old: Sequence[str], new: Sequence[str]) -> list[str]:
    """Tables to merge: in either generation, internal ones ('_' first) left out, sorted."""
    return sorted(n for n in {*old, *new} if not n.startswith("_"))


def merge_tables(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table of two generations, merged; independent jobs."""
    merged = {n: merge_table(n, old.get(n), new.get(n)) for n in merge_names(list(old), list(new))}
    return {n: df for n, df in merged.items() if df is not None}


def merge_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and time range of every table."""
    parts = None
    for name in sorted(tables):
        part = tables[name].select(F.lit(name).alias("table_name"), "timestamp")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )
