"""Ordered work on one long series without one task per series.

A series is cut into chunks, by time or by row position. Window functions run inside a chunk, and
what must cross a chunk border (a neighbour, a running count) travels in a summary table with one
row per chunk. Results are the same as with one window over the whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per chunk when chunks are cut by position.
CHUNK_ROWS = 65_536

# Rows a Python worker gathers before it computes; whole groups only.
BATCH_ROWS = 50_000


def floor_div(column: Column, size: int) -> Column:
    """Whole-number division that rounds down, exact for all BIGINT values."""
    return F.call_function("div", column - F.pmod(column, F.lit(size)), F.lit(size))


def each_sample(rows: DataFrame) -> DataFrame:
    """Rows that stand for the equal samples ``pos`` to ``until`` as one row per sample, at ``pos``.

    They are cut into pieces of bounded length first, so no long list is built for a hot moment.
    """
    piece = F.explode(F.sequence(floor_div(F.col("pos"), CHUNK_ROWS), floor_div(F.col("until"), CHUNK_ROWS)))
    start = F.col("_piece") * CHUNK_ROWS
    samples = F.sequence(F.greatest("pos", start), F.least("until", start + CHUNK_ROWS - 1))
    return rows.withColumn("_piece", piece).withColumn("pos", F.explode(samples)).drop("_piece", "until")


def number_rows(df: DataFrame, order: str, weights: dict[str, Column]) -> DataFrame:
    """Add running positions along each series.

    For every ``name: weight`` the column ``name`` is the sum of the weights of all earlier rows
    of the series and ``name_total`` that of the whole series. A weight of 1 gives row numbers
    from 0. Sums inside a chunk come from a window, the rest from one summary row per chunk.
    ``df`` is read twice and should be a stored table.
    """
    weighted = df
    for name, weight in weights.items():
        weighted = weighted.withColumn(f"_{name}", weight.cast("bigint"))
    sums = weighted.groupBy("series", "chunk").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in weights])
    whole = Window.partitionBy("series")
    earlier = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "series", "chunk",
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in weights],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_total") for n in weights])
    inside = (Window.partitionBy("series", "chunk").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = weighted.select("*", *[
        F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)).alias(n) for n in weights])
    return placed.join(offsets, ["series", "chunk"]).select(
        *df.columns,
        *[(F.col(n) + F.col(f"_{n}_before")).alias(n) for n in weights],
        *[f"{n}_total" for n in weights])


def group_changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True at the first row of every group of a table that is sorted by ``keys``."""
    first = np.zeros(table.num_rows, dtype=bool)
    first[0] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        first[1:] |= pc.fill_null(differs, True).to_numpy(zero_copy_only=False)
    return first


def over_groups(
    compute: Callable[[pa.Table, np.ndarray], pa.Table], keys: Sequence[str],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turn a function of whole groups into one for ``mapInArrow``.

    The partition arrives sorted by ``keys``. Many small groups are computed in one call, and an
    unfinished group waits for its remaining rows only, so memory follows the largest group.
    """

    def computed(table: pa.Table) -> list[pa.RecordBatch]:
        return compute(table, group_changes(table, keys)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        # Rows held, and how many of them lie before the last group.
        rows, cut = 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            first = group_changes(pa.Table.from_batches([*before, batch]), keys)[len(before):]
            if first.any():
                cut = rows + int(np.flatnonzero(first)[-1])
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH_ROWS and cut:
                yield from computed(pa.Table.from_batches(held).slice(0, cut))
                held = pa.Table.from_batches(held).slice(cut).to_batches()
                rows, cut = rows - cut, 0
        if held:
            yield from computed(pa.Table.from_batches(held))

    return run
