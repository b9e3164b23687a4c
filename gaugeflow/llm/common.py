"""Shared helpers: stored tables, bounded groups in Python, batches of text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators.chunks import group_changes
from gaugeflow.session import scratch_path

# Words are what stands between these characters (space and the five control characters).
WORD = r"[^\x20\x09-\x0D]+"

# A broadcast side table has at most this many rows; its rows are counted first.
BROADCAST_ROWS = 200_000

# Text bytes that a Python worker turns over at once.
PIECE_BYTES = 4 << 20


# Rows of an Arrow batch at most, while a table is written: a batch of texts stays at some megabytes.
ARROW_ROWS = 2_000

# For tables of rows of some megabytes each: Parquet's writer looks at its sizes every 100 rows, and readers hold a
# page as a whole and rows of a row group.
LARGE_ROWS = {"parquet.block.row.count.limit": "4", "parquet.page.row.count.limit": "1"}


@contextmanager
def _while_stored(spark: SparkSession, arrow_bytes: int | None = None):
    """Settings for the writing of a table: Spark removes the query's shuffle files when it ends, since
    its result is a table by then, and sends texts to Python in small batches, of about ``arrow_bytes``
    where rows are large."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                rows: str(min(ARROW_ROWS, int(spark.conf.get(rows))))}
    if arrow_bytes:
        settings["spark.sql.execution.arrow.maxBytesPerBatch"] = str(arrow_bytes)
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stored(
    df: DataFrame, label: str, arrow_bytes: int | None = None, options: dict[str, str] | None = None, **metrics: Column,
) -> tuple[DataFrame, dict]:
    """Write ``df`` to the shared folder and read it back, with its row count and other metrics.

    The lineage ends here: a lost executor costs a re-read of the table. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    watch = Observation()
    named = [column.alias(name) for name, column in metrics.items()]
    with _while_stored(spark, arrow_bytes):
        (df.observe(watch, F.count(F.lit(1)).alias("rows"), *named)
         .write.options(**(options or {})).option("compression", "zstd").parquet(path))
    return spark.read.schema(df.schema).parquet(path), watch.get


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a stored side table if its counted rows are few; else Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, whatever else the table has; missing ones are an error."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(
    compute: Callable[[pa.Table, np.ndarray], pa.Table], keys: Sequence[str], limit: int = 32 << 20,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of whole, sorted groups as one for ``mapInArrow``; groups are bounded by the caller.

    ``compute`` gets a table of whole groups of about ``limit`` bytes and the first rows of the groups.
    """

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                held.append(part)
                size += part.nbytes
                if size < limit:
                    continue
                table = pa.Table.from_batches(held)
                first = group_changes(table, keys)
                cut = int(np.flatnonzero(first)[-1])
                if cut:
                    yield from compute(table.slice(0, cut), first[:cut]).to_batches()
                    held = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in held) if cut else 0
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield from compute(table, group_changes(table, keys)).to_batches()

    return run


def bounds(first: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(first).tolist()
    return list(zip(starts, [*starts[1:], len(first)]))


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` text bytes; one row at least."""
    if batch.num_rows == 0:
        return
    texts = batch.column(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = max(start + 1, min(end, batch.num_rows))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, end to end, and the offsets of its rows; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]
