"""Threshold alerts with a cooldown since the last alert that was sent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.times import from_micros, micros
from gaugeflow.operators.chunks import floor_div, over_groups
from gaugeflow.session import materialize, measured

# Fixed value: hours of silence after an alert.
COOLDOWN_HOURS = 24

# Cooldowns per chunk of time, fewer if more breaches than this would fall in a chunk.
CHUNK_COOLDOWNS = 32
TARGET_CHUNK_ROWS = 1_000_000


def breaches(threshold: float, direction: str, value: str | Column = "value") -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return {"above": column > threshold, "below": column < threshold}[direction]


def _bounds(first: np.ndarray) -> zip:
    starts = np.flatnonzero(first)
    return zip(starts.tolist(), [*starts[1:].tolist(), len(first)])


def _chunk_exits(cooldown: int, length: int):
    """Per chunk, the last alert as a function of the first moment an alert is allowed.

    Row (until, exit): if an alert is allowed from any moment up to ``until`` (and after the
    previous row's), the last alert of the chunk is at ``exit``. Later moments give no alert.
    """

    def compute(table: pa.Table, first: np.ndarray) -> pa.Table:
        us = table.column("us").to_numpy()
        chunk = table.column("chunk").to_numpy()
        rows, until, last = [], [], []
        for a, b in _bounds(first):
            at = us[a:b]
            after = np.searchsorted(at, at + cooldown)
            hop = np.where(after < len(at), after, np.arange(len(at)))
            while True:
                further = hop[hop]
                if np.array_equal(further, hop):
                    break
                hop = further
            # An earlier alert lies before this chunk, so its silence ends within one cooldown.
            entries = np.searchsorted(at, chunk[a] * length + cooldown) + 1
            end = at[hop[:entries]]
            closing = _closing(at[:len(end)], end)
            rows.append(np.full(len(closing), a))
            until.append(at[closing])
            last.append(end[closing])
        index = np.concatenate(rows)
        return pa.table({
            "key": table.column("key").take(pa.array(index)), "chunk": chunk[index],
            "until": np.concatenate(until), "exit": np.concatenate(last)})

    return over_groups(compute, ("key", "chunk"))


def _closing(until: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows of a step function after which it changes."""
    return np.flatnonzero(np.concatenate((last[1:] != last[:-1], [True])))


def _compose(cooldown: int):
    """Two neighbouring step functions as one: first the left one, then the right one.

    An alert in the left half sends the right half its end of silence. Where the left half has no
    alert, its silence ended before the right half begins, so the right half's first row holds. The
    result is at most one row longer than the left half.
    """

    def compute(table: pa.Table, first: np.ndarray) -> pa.Table:
        side = table.column("side").to_numpy()
        until = table.column("until").to_numpy()
        last = table.column("exit").to_numpy()
        rows, untils, exits = [], [], []
        for a, b in _bounds(first):
            cut = a + int(np.searchsorted(side[a:b], 1))
            left_until, left_exit = until[a:cut], last[a:cut]
            right_until, right_exit = until[cut:b], last[cut:b]
            if len(left_until) and len(right_until):
                at = np.searchsorted(right_until, left_exit + cooldown)
                inside = at < len(right_until)
                both = np.where(inside, right_exit[np.minimum(at, len(right_until) - 1)], left_exit)
                right_until, right_exit = np.append(left_until, right_until[0]), np.append(both, right_exit[0])
            elif len(left_until):
                right_until, right_exit = left_until, left_exit
            closing = _closing(right_until, right_exit)
            rows.append(np.full(len(closing), a))
            untils.append(right_until[closing])
            exits.append(right_exit[closing])
        index = np.concatenate(rows)
        return pa.table({
            "key": table.column("key").take(pa.array(index)), "chunk": table.column("chunk").to_numpy()[index],
            "until": np.concatenate(untils), "exit": np.concatenate(exits)})

    return over_groups(compute, ("key", "chunk"))


_MAPS = "key STRING, chunk BIGINT, until BIGINT, exit BIGINT"


def chunk_entries(exits: DataFrame, cooldown: int) -> DataFrame:
    """(key, chunk, entry): from which moment on each chunk may alert.

    Step functions of neighbouring chunks are composed in pairs, and the pairs again, up to one per key;
    then each half gets its entry from the whole on the way down. A task holds two step functions at a
    time, each about as long as one cooldown has breaches, however long the key is.
    """
    exits, seen = measured(exits, "exits", low=F.min("chunk"), high=F.max("chunk"))
    if seen["rows"] == 0:
        return exits.select("key", "chunk", F.col("until").alias("entry"))
    low = seen["low"]
    levels = [exits.withColumn("chunk", F.col("chunk") - low)]
    for _ in range((seen["high"] - low).bit_length()):
        halves = levels[-1].select(
            "key", F.expr("chunk div 2").alias("chunk"), (F.col("chunk") % 2).alias("side"), "until", "exit")
        levels.append(materialize(
            halves.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "side", "until")
            .mapInArrow(_compose(cooldown), _MAPS), "composed"))
    entries = levels.pop().select("key", "chunk").distinct().withColumn(
        "entry", F.lit(np.iinfo(np.int64).min).cast("bigint"))
    while levels:
        maps = levels.pop()
        whole = entries.withColumnRenamed("chunk", "pair")
        lefts = maps.where("chunk % 2 = 0").withColumn("pair", F.expr("chunk div 2")).join(whole, ["key", "pair"])
        moved = lefts.where("until >= entry").groupBy("key", "pair").agg(F.min_by("exit", "until").alias("exit"))
        halves = maps.select("key", "chunk").distinct().withColumn("pair", F.expr("chunk div 2"))
        after = F.when(F.col("chunk") % 2 == 1, F.coalesce(F.col("exit") + cooldown, "entry")).otherwise(F.col("entry"))
        entries = materialize(
            halves.join(whole, ["key", "pair"]).join(moved, ["key", "pair"], "left")
            .select("key", "chunk", after.alias("entry")), "entries")
    return entries.withColumn("chunk", F.col("chunk") + low)


def _walk(cooldown: int):
    def compute(table: pa.Table, first: np.ndarray) -> pa.Table:
        us = table.column("us").to_numpy()
        entry = table.column("entry").to_numpy()
        sent: list[int] = []
        for a, b in _bounds(first):
            at = us[a:b]
            i = int(np.searchsorted(at, entry[a]))
            while i < len(at):
                sent.append(a + i)
                i = int(np.searchsorted(at, at[i] + cooldown))
        return table.select(["key", "us", "value"]).take(pa.array(sent, pa.int64()))

    return over_groups(compute, ("key", "chunk"))


def threshold_alerts(
    df: DataFrame,
    threshold: float,
    direction: str = "above",
    cooldown_hours: float = COOLDOWN_HOURS,
    key: str = "key",
    ts: str = "timestamp",
    value: str = "value",
    order: str = "id",
) -> DataFrame:
    """Alerts (key, timestamp, value) that are sent: the first breach of a key, and then each first
    breach at least a cooldown after the last one sent.

    Which breach is sent depends on all earlier ones of its key, but only through one moment. So
    time is cut into chunks of several cooldowns; each chunk is summed up as a step function from
    "allowed from" to its last alert, the summaries are composed in pairs (:func:`chunk_entries`), and the
    chunks are then walked from their known starting moments. A task holds at most a chunk or two
    summaries of a key, never the whole key.
    """
    cooldown = round(cooldown_hours * 3_600_000_000)
    hits = materialize(
        df.where(breaches(threshold, direction, value))
        .select(F.col(key).cast("string").alias("key"), micros(ts).alias("us"),
                F.col(value).cast("double").alias("value"), F.col(order).alias("_order"))
        .groupBy("key", "us").agg(F.min(F.struct(F.col("_order").isNull(), "_order", "value")).alias("first"))
        .select("key", "us", "first.value"), "breaches")
    slots = hits.groupBy("key", floor_div(F.col("us"), cooldown).alias("slot")).count()
    densest = slots.agg(F.max("count")).first()[0] or 1
    length = cooldown * max(1, min(CHUNK_COOLDOWNS, TARGET_CHUNK_ROWS // densest))
    hits = hits.withColumn("chunk", floor_div(F.col("us"), length))
    exits = (
        hits.select("key", "chunk", "us").repartition("key", "chunk")
        .sortWithinPartitions("key", "chunk", "us").mapInArrow(_chunk_exits(cooldown, length), _MAPS))
    entries = chunk_entries(exits, cooldown)
    sent = (
        hits.join(entries, ["key", "chunk"]).repartition("key", "chunk")
        .sortWithinPartitions("key", "chunk", "us")
        .mapInArrow(_walk(cooldown), "key STRING, us BIGINT, value DOUBLE"))
    return sent.select(F.col("key").alias(key), from_micros("us").alias(ts), F.col("value").alias(value))
