"""Streams into folder tables: routed rows, unique rows, and bucket statistics that are kept fresh.

Each micro-batch is one commit that also notes its number, so a repeated batch changes nothing. State lives
in the tables, not in a state store: there is no watermark, and late rows are merged like all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugeflow.functions.times import bucket_start, interval, moment
from gaugeflow.functions.values import cast_value
from gaugeflow.operators.buckets import RESOLUTIONS
from gaugeflow.operators.filters import broadcast_if, newest_per_key
from gaugeflow.operators.merge import MESSAGE_KEY, new_rows
from gaugeflow.sources import versions
from gaugeflow.streaming.ingest import FLUSH_SECONDS, _trigger

# Fixed value: the finest resolution, in minutes; all others are multiples of it.
FINE_MINUTES = 1

PARTIALS = T.StructType([T.StructField(name, kind) for name, kind in (
    ("series", T.StringType()), ("t", T.TimestampNTZType()), ("rows", T.LongType()), ("n", T.LongType()),
    ("held", T.LongType()), ("mean", T.DoubleType()), ("m2", T.DoubleType()), ("low", T.DoubleType()),
    ("high", T.DoubleType()), ("newest", T.TimestampNTZType()), ("date", T.DateType()))])


def writer_name(checkpoint: str) -> str:
    """A short name of the stream that owns a checkpoint."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def keep(rows: DataFrame, path: str, checkpoint: str, by: tuple[str, ...],
         change: Callable[[DataFrame, versions.Version], DataFrame],
         merge: Callable[[DataFrame], DataFrame] = lambda df: df, schema: T.StructType | None = None,
         seconds: float | None = FLUSH_SECONDS, most_folders: int = versions.MOST_FOLDERS) -> StreamingQuery:
    """Add ``change(batch, table so far)`` of every micro-batch to the folder table ``path``.

    Parts that have gathered more than ``most_folders`` folders are merged, and folders that no kept commit
    names are deleted. ``received`` and ``stored`` rows are counted in the notes of the commits.
    """
    spark, name = rows.sparkSession, writer_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        before = versions.latest(spark, path)
        if before.notes.get("batches", {}).get(name, -1) >= batch_id:
            return
        held = batch.persist()
        try:
            fresh = change(held, before)
            added = versions.write_folders(fresh, path, f"batch-{name}-{batch_id}", by)
            received = held.count()
        finally:
            held.unpersist()
        written = versions.Version(parts=added)
        stored = versions.read(spark, path, fresh.schema, version=written).count()

        def note(notes: dict) -> dict | None:
            batches = notes.get("batches", {})
            if batches.get(name, -1) >= batch_id:
                return None
            return {**notes, "batches": {**batches, name: batch_id},
                    "received": notes.get("received", 0) + received, "stored": notes.get("stored", 0) + stored}

        versions.commit(spark, path, added, note=note)
        versions.compact(spark, path, schema or fresh.schema, by, merge, most_folders)
        versions.expire(spark, path)

    return _trigger(rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write), seconds).start()


def keep_routed(rows: DataFrame, path: str, checkpoint: str, seconds: float | None = FLUSH_SECONDS,
                by: Sequence[str] = ("table_name", "date"), most_folders: int = versions.MOST_FOLDERS) -> StreamingQuery:
    """Append routed message rows, by table and day; merged folders take the place of batch folders."""

    def ordered(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions(*by, "topic", "timestamp")

    return keep(rows, path, checkpoint, tuple(by), lambda batch, _: batch, ordered, rows.schema, seconds, most_folders)


def keep_unique(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = MESSAGE_KEY,
                ts: str = "timestamp", seconds: float | None = FLUSH_SECONDS,
                most_folders: int = versions.MOST_FOLDERS) -> StreamingQuery:
    """Append rows whose key the table does not have yet, however late they come.

    ``keys`` must contain the time ``ts``: equal keys lie on the same day then, and a batch is compared with
    the days it touches only, of which the keys alone are read. Received rows are the stored ones and the
    repeated ones; none is shut out. Rows with a NULL key are all kept.
    """
    if ts not in keys:
        raise ValueError(f"the keys must contain {ts}")
    spark, keys = rows.sparkSession, list(keys)

    def unseen(batch: DataFrame, before: versions.Version) -> DataFrame:
        dated = batch.withColumn("date", F.to_date(ts))
        days = [f"part_date={r[0]}" for r in dated.select("date").distinct().where("date IS NOT NULL").collect()]
        known = versions.read(spark, path, dated.select(*keys).schema, days, before)
        whole = F.lit(True)
        for key in keys:
            whole = whole & F.col(key).isNotNull()
        return new_rows(known, dated.where(whole), keys).unionByName(dated.where(~whole))

    return keep(rows, path, checkpoint, ("date",), unseen, seconds=seconds, most_folders=most_folders)


def partial_stats(messages: DataFrame, on_error: str = "raise") -> DataFrame:
    """Mergeable statistics per topic and minute: ``rows`` of any kind, ``n`` with a payload, ``held`` values
    with their mean, sum of squared deviations, minimum and maximum, and the newest time. Rows without a time
    are in no bucket."""
    values = messages.where(F.col("timestamp").isNotNull()).select(
        F.col("topic").alias("series"), bucket_start("timestamp", FINE_MINUTES).alias("t"), "timestamp",
        F.col("payload").isNotNull().alias("paid"), cast_value("payload", on_error).alias("v"))
    return values.groupBy("series", "t").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("paid").alias("n"), F.count("v").alias("held"),
        F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"), F.min("v").alias("low"),
        F.max("v").alias("high"), F.max("timestamp").alias("newest"),
    ).withColumn("date", F.to_date("t"))


def merge_partials(partials: DataFrame, minutes: int = FINE_MINUTES) -> DataFrame:
    """Partial statistics at a coarser resolution, or several of the same bucket as one.

    Deviations are moved to the common mean, found first in the same shuffle, so no digits cancel.
    """
    same = Window.partitionBy("series", "t")
    moved = partials.withColumn("t", bucket_start("t", minutes)).withColumn(
        "centre", F.sum(F.col("mean") * F.col("held")).over(same) / F.nullif(F.sum("held").over(same), F.lit(0)))
    shift = F.col("mean") - F.col("centre")
    return moved.groupBy("series", "t").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("held").alias("held"),
        F.max("centre").alias("mean"), F.sum(F.col("m2") + F.col("held") * shift * shift).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("newest").alias("newest"),
    ).withColumn("date", F.to_date("t"))


def keep_summaries(messages: DataFrame, path: str, checkpoint: str, seconds: float | None = 30,
                   on_error: str = "raise", most_folders: int = versions.MOST_FOLDERS) -> StreamingQuery:
    """Keep the partial statistics of a message stream, by day. A batch costs what it brings: days it does
    not touch are neither read nor written."""
    return keep(messages, path, checkpoint, ("date",), lambda batch, _: partial_stats(batch, on_error),
                merge_partials, PARTIALS, seconds, most_folders)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, PARTIALS)


def bucket_rows(partials: DataFrame, minutes: int) -> DataFrame:
    """Level statistics, as the batch operator returns them."""
    return merge_partials(partials, minutes).where(F.col("mean").isNotNull()).select(
        "series", "t", F.col("mean").alias("m"),
        F.coalesce(F.sqrt(F.col("m2") / F.col("held")), F.lit(0.0)).alias("s"), "n",
        F.col("low").alias("min"), F.col("high").alias("max"))


def fresh_levels(partials: DataFrame, messages: DataFrame, resolutions=RESOLUTIONS,
                 on_error: str = "raise") -> dict[str, DataFrame]:
    """The level statistics at each resolution from kept summaries, equal to the batch operator's.

    A look-back ends inside a minute. Whole minutes come from the summaries; of that one minute per topic
    the rows are read from ``messages``, with a time range that reaches the scan.
    """
    newest = newest_per_key(partials, ("series",), "newest")
    found = {}
    for name, minutes, hours in resolutions:
        if hours is None or newest.earliest is None:
            found[name] = bucket_rows(partials, minutes)
            continue
        bound = F.col("_newest") - interval(hours * 3600)
        bounds = newest.table.select("series", bound.alias("_from"))
        span = bounds.agg(F.min("_from").alias("low"), F.max("_from").alias("high")).first()
        small = broadcast_if(bounds, newest.rows, newest.size)
        whole = partials.where(F.col("t") >= moment(span["low"])).join(small, "series").where(
            F.col("t") >= F.col("_from")).drop("_from")
        edge = messages.where(
            (F.col("timestamp") >= moment(span["low"]))
            & (F.col("timestamp") < moment(span["high"] + timedelta(minutes=FINE_MINUTES)))
        ).withColumn("series", F.col("topic")).join(small, "series").where(
            (F.col("timestamp") >= F.col("_from")) & (bucket_start("timestamp", FINE_MINUTES) < F.col("_from")))
        cut = partial_stats(edge.drop("series", "_from"), on_error)
        found[name] = bucket_rows(whole.unionByName(cut), minutes)
    return found
