"""Audit of how document filters interact: counts for every order in which five filters can be applied.

* One filter asks for whole texts that are repeats. A counting Bloom filter finds those that cannot be:
  tasks sketch the fingerprints of their texts (sparse counters up to two), the sketches are merged by
  segment, and a text with a counter at one is unique for sure. Only texts whose counters all reach two are
  shuffled, grouped by the whole text, and the least id of each group comes back as a narrow row.
* Each document becomes one mask of failed filters. Masks are counted by part, and all else follows from
  those 32 counts of a part: what is left after a set of filters is the sum over the masks without them.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import pick, stored
from gaugeflow.llm.rolling import mix, spread

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)

# Counters of the sketch for each text, and at most; with more texts than that allows for, fewer are cleared
# and more are shuffled, and the results are the same. The merged sketch has one bit for each counter.
PER_TEXT = 16
MOST_COUNTERS = 1 << 28
SEGMENTS = 256
HASHES = 3

# Counter places that a task gathers before it writes them out.
FLUSH = 1 << 21


def failures(text: Column) -> list[Column]:
    """Which of the filters A to D a text fails; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    count = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        count < 200,
        F.size(F.array_distinct(words)) * 100 < count * 50,
        capitals * 100 > F.length(text) * 2,
        text.rlike(r"[#$%&*|]"),
    ]


def _places(prints: np.ndarray, counters: int) -> np.ndarray:
    """The counters of each fingerprint, one row for each hash."""
    seeds = spread(71, HASHES)[:, None]
    return (mix(prints.view(np.uint64)[None, :] + seeds) & np.uint64(counters - 1)).astype(np.int64)


def _sketched(counters: int):
    """Sparse counters of a task by segment: place in the segment times two, plus one if counted twice or more."""
    width = counters // SEGMENTS

    def flushed(held):
        place, times = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(place, np.arange(SEGMENTS + 1) * width)
        value = ((place % width) * 2 + (times > 1)).astype(np.uint32)
        some = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)),
             pa.array([value[cut[k]:cut[k + 1]].tobytes() for k in some], pa.binary())], ["segment", "counts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(_places(batch.column("print").to_numpy(), counters).ravel())
            size += len(held[-1])
            if size >= FLUSH:
                yield flushed(held)
                held, size = [], 0
        if held:
            yield flushed(held)

    return run


def _merged(counters: int):
    """Rows sorted by segment to one row for each segment: a bit for each counter that reaches two."""
    width = counters // SEGMENTS

    def run(batches):
        now, count = None, np.zeros(width, np.uint8)

        def packed():
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())],
                ["segment", "bits"])

        for batch in batches:
            for segment, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist()):
                if segment != now:
                    if now is not None:
                        yield packed()
                    now = segment
                    count[:] = 0
                value = np.frombuffer(counts, np.uint32)
                place = value >> 1
                count[place] = np.minimum(count[place] + 1 + (value & 1), 2)
        if now is not None:
            yield packed()

    return run


def possible_repeats(prints: DataFrame, rows: int, per_text: int = PER_TEXT, most: int = MOST_COUNTERS):
    """A function of fingerprint columns: may a text with this ``print`` be in ``prints`` more than once?

    Never false for a repeat. The merged sketch, of at most ``most`` bits, is sent to every executor.
    """
    spark = prints.sparkSession
    counters = 1 << max(SEGMENTS, min(most, rows * per_text)).bit_length()
    counters = max(SEGMENTS * 8, min(counters, most))
    merged = (
        prints.select("print").mapInArrow(_sketched(counters), "segment INT, counts BINARY")
        .repartition("segment").sortWithinPartitions("segment")
        .mapInArrow(_merged(counters), "segment INT, bits BINARY"))
    sketch = np.zeros((SEGMENTS, counters // SEGMENTS // 8), np.uint8)
    for line in merged.collect():
        sketch[line["segment"]] = np.frombuffer(line["bits"], np.uint8)
    bits = spark.sparkContext.broadcast(sketch.ravel())

    @F.pandas_udf("boolean")
    def repeated(column: pd.Series) -> pd.Series:
        place = _places(column.to_numpy(np.int64), counters)
        hit = bits.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1
        return pd.Series(hit.all(axis=0))

    return repeated


def fail_masks(docs: DataFrame, per_text: int = PER_TEXT, most: int = MOST_COUNTERS) -> DataFrame:
    """doc_id, part and mask (bit k: filter k of ABCDE is failed) for every row of ``docs``."""
    whole = F.coalesce("text", F.lit(""))
    print_ = F.xxhash64(whole)
    flags = failures(F.col("text"))
    mask = sum((F.when(flag, 1 << k).otherwise(0) for k, flag in enumerate(flags)), F.lit(0))
    facts, seen = stored(pick(docs, "doc_id", "source", "text").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), mask.alias("mask"), print_.alias("print")), "facts")
    repeated = possible_repeats(facts, seen["rows"], per_text, most)
    texts = pick(docs, "doc_id", "text").select("doc_id", whole.alias("text"), print_.alias("print"))
    firsts, _ = stored(
        texts.where(repeated("print")).groupBy("text", "print").agg(F.min("doc_id").alias("doc_id"))
        .where("doc_id IS NOT NULL").select("doc_id", "print").distinct().withColumn("first", F.lit(True)), "firsts")
    marked = facts.withColumn("repeated", repeated("print"))
    clear = marked.where("NOT repeated OR doc_id IS NULL").select("doc_id", "part", "mask")
    judged = marked.where("repeated AND doc_id IS NOT NULL").join(firsts, ["doc_id", "print"], "left").select(
        "doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + (MASKS >> 1)).alias("mask"))
    return clear.unionByName(judged)


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones for each part and mask."""
    marks = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("toxic"))
    return masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), F.count("good").alias("good"), F.count("toxic").alias("toxic"))


def order_effects(counts: DataFrame) -> DataFrame:
    """What each filter does at each step of every order, for each part, from its mask counts."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    # At most 32 entries for each part.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("counts"))

    def total(kind: str, chosen: str) -> str:
        return f"aggregate(counts, 0L, (s, c) -> s + if({chosen}, c.{kind}, 0L))"

    def left(kind: str) -> str:
        """Left after a set of filters, by the set: the sum of the masks without them."""
        return f"transform(sequence(0, {MASKS - 1}), f -> {total(kind, '(c.mask & f) = 0')})"

    def of_each(chosen: str, kind: str = "docs") -> str:
        return f"transform(sequence(0, {len(FILTERS) - 1}), k -> {total(kind, chosen)})"

    # Over all orders, of those that fail n filters each of these comes first in one n-th of the orders.
    share = f"docs * ({len(orders)} div bit_count(c.mask))"
    steps = parts.select(
        "part", *[F.expr(left(kind)).alias(f"{kind}_left") for kind in ("docs", "good", "toxic")],
        F.expr(of_each("(c.mask & shiftleft(1, k)) > 0")).alias("failing"),
        F.expr(of_each("c.mask = shiftleft(1, k)")).alias("alone"),
        F.expr(of_each("(c.mask & shiftleft(1, k)) > 0", share)).alias("first"),
        F.explode(F.split(F.lit(",".join(orders)), ",")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = f"shiftleft(1, instr('{FILTERS}', substring(filter_order, f, 1)) - 1)"
    steps = steps.withColumns({
        "k": F.expr(f"instr('{FILTERS}', substring(filter_order, step, 1)) - 1"),
        "after": F.expr(f"aggregate(sequence(1, step), 0, (s, f) -> s + {bit})"),
    }).withColumn("before", F.expr("after - shiftleft(1, k)"))
    removed = F.expr("docs_left[before] - docs_left[after]")
    return steps.select(
        "part", "filter_order", "step", F.expr("docs_left[after]").alias("kept"), removed.alias("removed"),
        (F.expr("failing[k]") - removed).alias("redundant"), F.expr("alone[k]").alias("unique_fails"),
        F.expr("good_left[before] - good_left[after]").alias("good_lost"),
        F.expr("toxic_left[before] - toxic_left[after]").alias("toxic_lost"), F.expr("first[k]").alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (source), order of the filters ABCDE and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley.

    A: under 200 words; B: fewer than half of the words are different; C: more than 2 % of the code points
    are A-Z; D: holds one of ``#$%&*|``; E: a smaller doc_id has the identical text anywhere in the table.
    Null texts are empty ones; a null source is the part "". A null doc_id is smaller than none and has
    none smaller, so it passes E, and it has no labels. Repeated rows of one doc_id and text count each and
    are not repeats of each other. Of several labels of a doc_id, one that is 1 counts. An empty table
    gives no rows. Other columns are ignored.
    """
    return order_effects(mask_counts(fail_masks(docs), labels))
