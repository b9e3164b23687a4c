"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window.

Every window of every text is hashed; equal hashes meet in one bucket, where the window that starts
first stays and the others are marked. Marked windows merge into maximal intervals of words to remove.

* Texts are first packed into batches (one row each, a few megabytes). Inside a batch only the first
  of equal windows is sent on, so a window that occurs in a third of all texts adds at most one entry
  per batch to its bucket.
* One row per (batch, bucket) carries the hashes as an array of 8 bytes each. The bucket number comes
  from a second, independent hash and the number of buckets grows with the windows, so two windows
  count as equal if 64 + log2(buckets) bits agree.
* A bucket answers with one bit per window. Bits and batches meet by batch number, one batch at a time.
* Nothing holds more than a few batches: row groups and Arrow batches of packed texts are cut by bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import LARGE_ROWS, partitions, pick, pieces, stored, text_bytes
from gaugeflow.llm.rolling import Powers, window_hashes, word_hashes, word_spans

# Words of a window.
WINDOW = 20

# Windows that one bucket holds on average.
BUCKET_WINDOWS = 1_500_000

# Text bytes of a batch; its windows take many times as much in a Python worker.
BATCH_BYTES = 2 << 20

# Bytes of hashes that Python hands to Spark at once.
SENT_BYTES = 1 << 20

_NO_ID = np.iinfo(np.int64).min
_BATCH = "batch BIGINT, ids ARRAY<BIGINT>, texts ARRAY<STRING>, windows BIGINT"


def _pack(length: int):
    """Texts as batches, ordered by doc_id (nulls first) and text inside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in pieces(batch, limit=BATCH_BYTES):
                table = pa.Table.from_batches([part]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
                ids, texts = (table.column(c).combine_chunks() for c in ("doc_id", "text"))
                if ids.null_count:
                    order = np.argsort(ids.is_valid().to_numpy(zero_copy_only=False), kind="stable")
                    ids, texts = ids.take(pa.array(order)), texts.take(pa.array(order))
                data, offsets = text_bytes(texts)
                counts = np.diff(word_spans(data, offsets)[2])
                size = pa.array([0, len(ids)], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([base + number], pa.int64()), pa.ListArray.from_arrays(size, ids),
                    pa.ListArray.from_arrays(size, texts),
                    pa.array([int(np.maximum(counts - length + 1, 0).sum())], pa.int64()),
                ], ["batch", "ids", "texts", "windows"])
                number += 1

    return run


class _Hasher:
    """Windows of a batch of texts: hash, first word, bucket, and whether the batch has it earlier."""

    def __init__(self, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.powers = [Powers(seed) for seed in (11, 12, 13)]

    def __call__(self, texts: pa.StringArray):
        data, offsets = text_bytes(texts)
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends, 1, self.powers[0])
        hashes, at = window_hashes(words, first, self.length, self.powers[1])
        other, _ = window_hashes(words, first, self.length, self.powers[2])
        bucket = (other % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        again = np.zeros(len(hashes), bool)
        if len(hashes) > 1:
            same = (hashes[order[1:]] == hashes[order[:-1]]) & (bucket[order[1:]] == bucket[order[:-1]])
            again[order[1:]] = same
        sent = np.flatnonzero(~again)
        sent = sent[np.argsort(bucket[sent], kind="stable")]
        return data, offsets, starts, ends, first, hashes, at, bucket, again, sent


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every run of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.diff(np.append(starts, len(values)))


def _texts(packed: DataFrame) -> DataFrame:
    """A row for every text of stored batches: rows of some megabytes would pass through Spark as one object each."""
    return packed.select("batch", F.posexplode(F.arrays_zip("ids", "texts")).alias("pos", "doc")).select(
        "batch", "pos", F.col("doc.ids").alias("doc_id"), F.col("doc.texts").alias("text"))


def _batch(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """doc_ids and texts of one batch, in the order in which it was packed."""
    pos = table.column("pos").to_numpy()
    if (np.diff(pos) < 0).any():
        table = table.take(pa.array(np.argsort(pos)))
    return tuple(pa.concat_arrays(table.column(c).chunks) for c in ("doc_id", "text"))


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Number and texts of each batch. The rows of a batch follow each other, if need be in several Arrow batches."""
    held, number = [], None
    for part in rows:
        numbers = part.column("batch").to_numpy()
        for a, n in zip(*_runs(numbers)):
            if held and numbers[a] != number:
                yield number, pa.Table.from_batches(held)
                held = []
            number = int(numbers[a])
            held.append(part.slice(a, n))
    if held:
        yield number, pa.Table.from_batches(held)


def _send(length: int, buckets: int):
    """One row for each bucket that a batch has windows in: documents, windows of each, hashes."""

    def run(rows):
        hasher = _Hasher(length, buckets)
        for number, table in _batches(rows):
            ids, texts = _batch(table)
            *_, first, hashes, at, bucket, _, sent = hasher(texts)
            if not len(sent):
                continue
            row = np.searchsorted(first, at[sent], "right") - 1
            doc = ids.fill_null(_NO_ID).to_numpy()
            out = {"bucket": [], "docs": [], "counts": [], "hashes": []}
            for a, n in zip(*_runs(bucket[sent])):
                run_at, run_n = _runs(row[a:a + n])
                out["bucket"].append(int(bucket[sent[a]]))
                out["docs"].append(doc[row[a:a + n][run_at]].tobytes())
                out["counts"].append(run_n.astype(np.int32).tobytes())
                out["hashes"].append(hashes[sent[a:a + n]].tobytes())
            whole = pa.RecordBatch.from_arrays(
                [pa.array(out["bucket"], pa.int64()), pa.array([number] * len(out["bucket"]), pa.int64()),
                 *[pa.array(out[c], pa.binary()) for c in ("docs", "counts", "hashes")]],
                ["bucket", "batch", "docs", "counts", "hashes"])
            step = max(1, SENT_BYTES * whole.num_rows // max(1, whole.nbytes))
            yield from (whole.slice(a, step) for a in range(0, whole.num_rows, step))

    return run


def _judge(table: pa.Table) -> pa.Table:
    """In one bucket: a bit for every window, set where an equal window starts earlier."""
    table = table.sort_by("batch")
    parts = {c: table.column(c).to_pylist() for c in ("docs", "counts", "hashes")}
    hashes = np.frombuffer(b"".join(parts["hashes"]), np.uint64)
    counts = np.frombuffer(b"".join(parts["counts"]), np.int32)
    docs = np.repeat(np.frombuffer(b"".join(parts["docs"]), np.int64), counts)
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    member = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    member = member[np.lexsort((member, docs[member], hashes[member]))]
    later = np.zeros(len(hashes), bool)
    if len(member):
        later[member[1:]] = hashes[member[1:]] == hashes[member[:-1]]
    ends = np.cumsum([len(h) // 8 for h in parts["hashes"]])
    bits, kept = [], []
    for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
        if later[a:b].any():
            kept.append(i)
            bits.append(np.packbits(later[a:b]).tobytes())
    return pa.table({
        "batch": table.column("batch").take(pa.array(kept, pa.int64())),
        "bucket": table.column("bucket").take(pa.array(kept, pa.int64())),
        "bits": pa.array(bits, pa.binary())})


def _covered(texts, marks: pa.Table, hasher: _Hasher, length: int):
    """Words of a batch and which of them marked windows cover."""
    data, offsets, starts, ends, first, hashes, at, bucket, again, sent = hasher(texts)
    later = again
    run_at, run_n = _runs(bucket[sent])
    where = {int(bucket[sent[a]]): (int(a), int(n)) for a, n in zip(run_at, run_n)}
    for number, bits in zip(marks.column("bucket").to_pylist(), marks.column("bits").to_pylist()):
        a, n = where[number]
        later[sent[a:a + n]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[later], 1)
    np.add.at(cover, at[later] + length, -1)
    return data, offsets, first, np.cumsum(cover[:-1]) > 0


def _cut(length: int, buckets: int):
    """One batch with its marks: the texts without the marked words."""
    hasher = _Hasher(length, buckets)

    def run(packed: pa.Table, marks: pa.Table) -> pa.Table:
        ids, texts = _batch(packed)
        data, offsets, first, gone = _covered(texts, marks, hasher, length)
        raw = data.tobytes()
        out = {"n_words": [], "n_removed": [], "text": [], "spans": []}
        for k in range(len(ids)):
            words = raw[offsets[k]:offsets[k + 1]].split()
            mask = gone[first[k]:first[k + 1]]
            removed = int(mask.sum())
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
            out["n_words"].append(len(words))
            out["n_removed"].append(removed)
            out["text"].append(b" ".join(compress(words, (~mask).tolist()) if removed else words))
            out["spans"].append(edges.reshape(-1, 2).tolist())
        return pa.table(
            [ids, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
             pa.array(out["text"], pa.binary()).cast(pa.string()),
             pa.array([hashlib.sha256(t).hexdigest() for t in out["text"]], pa.string()),
             pa.array(out["spans"], pa.list_(pa.list_(pa.int32())))],
            ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "removed"])

    return run


def remove_repeats(docs: DataFrame, length: int = WINDOW, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Texts without the words that lie in a window of ``length`` words which also starts earlier.

    ``docs`` has doc_id and text; other columns are ignored. The result has a row for every row:
    doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256, and removed
    (maximal intervals [first word, past last word]). "Earlier" is a smaller doc_id, then a smaller
    start. Null and empty texts have no words, texts shorter than a window lose none. Null doc_ids
    come before all others. Rows that share a doc_id count in the order in which they are stored, so
    of repeated rows one keeps its words. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    packed, seen = stored(
        pick(docs, "doc_id", "text").mapInArrow(_pack(length), _BATCH), "batches",
        arrow_bytes=BATCH_BYTES, options=LARGE_ROWS, windows=F.sum("windows"))
    buckets = max(2 * partitions(spark), -(-(seen["windows"] or 0) // bucket_windows))
    sent = _texts(packed).mapInArrow(
        _send(length, buckets), "bucket BIGINT, batch BIGINT, docs BINARY, counts BINARY, hashes BINARY")
    judged, _ = stored(
        sent.groupBy("bucket").applyInArrow(_judge, "batch BIGINT, bucket BIGINT, bits BINARY"), "marks",
        arrow_bytes=BATCH_BYTES)
    return (
        _texts(packed).groupBy("batch").cogroup(judged.groupBy("batch"))
        .applyInArrow(_cut(length, buckets), "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept_text STRING, "
                                             "kept_sha256 STRING, removed ARRAY<ARRAY<INT>>"))
