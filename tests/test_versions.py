"""Folder tables: commits, merges, repeated and crashed runs; streams and archives on them."""

from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import buckets
from gaugeflow.sources import archive, versions
from gaugeflow.streaming import ingest, tables
from test_timeseries import level_signal, messages

T0 = datetime(2024, 1, 1)


def numbers(spark, values, day=0):
    return spark.createDataFrame([(v, day) for v in values], "v BIGINT, day INT")


def test_commit_merge_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = numbers(spark, [1]).schema
    assert versions.read(spark, path, schema).count() == 0
    for i in range(6):
        added = versions.write_folders(numbers(spark, [i], i // 5), path, f"b{i}", ("day",))
        assert versions.commit(spark, path, added).number == i + 1
    # Written but not committed: not part of the table.
    versions.write_folders(numbers(spark, [99]), path, "lost", ("day",))
    assert sorted(r.v for r in versions.read(spark, path, schema).collect()) == list(range(6))
    assert versions.read(spark, path, schema, ["part_day=1", "part_day=7"]).first().v == 5

    before = versions.latest(spark, path)
    versions.compact(spark, path, schema, ("day",), most=2)
    after = versions.latest(spark, path)
    assert len(after.parts["part_day=0"]) == 1 and after.parts["part_day=1"] == before.parts["part_day=1"]
    assert versions.compact(spark, path, schema, ("day",), most=2) is None
    # An old commit stays readable until it is expired, and a folder is replaced once only.
    assert versions.read(spark, path, schema, version=before).count() == 6
    assert versions.commit(spark, path, {}, before.folders()) is None
    assert versions.expire(spark, path, keep=1) == 5
    assert sorted(r.v for r in versions.read(spark, path, schema).collect()) == list(range(6))
    assert not (tmp_path / "t" / "b0").exists() and (tmp_path / "t" / "lost").exists()
    assert len(list((tmp_path / "t" / "_commits").glob("*.json"))) == 1


def test_torn_commit_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = numbers(spark, [1]).schema
    versions.commit(spark, path, versions.write_folders(numbers(spark, [1]), path, "a", ("day",)))
    (tmp_path / "t" / "_commits" / f"{2:012d}.json").write_text('{"parts": {"part_')
    assert versions.latest(spark, path).number == 1
    after = versions.commit(spark, path, versions.write_folders(numbers(spark, [2]), path, "b", ("day",)))
    assert after.number == 3 and versions.read(spark, path, schema).count() == 2


def stream_in(spark, source, frame, start):
    frame.coalesce(1).write.mode("append").parquet(source)
    start(ingest.file_feed(spark, source, frame.schema)).awaitTermination()


def test_summaries_equal_batch_after_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame = messages(spark, {"a": level_signal(np.random.default_rng(3), 900), "b": (
        pd.DatetimeIndex([T0 + timedelta(days=1, seconds=13.5 * i) for i in range(400)]),
        [None if i % 7 == 0 else 5.0 + i for i in range(400)])})
    frame = frame.withColumn("payload", F.when(F.col("payload") != "None", F.col("payload")))
    # Out of time order, so most batches bring late rows to old minutes.
    for i in range(9):
        stream_in(spark, source, frame.where(F.col("id") % 9 == i), lambda feed: tables.keep_summaries(
            feed, out, state, seconds=None, most_folders=3))
    now = versions.latest(spark, out)
    assert max(len(folders) for folders in now.parts.values()) <= 3
    assert now.notes["received"] == frame.count()
    kept = {p.name for p in Path(out).iterdir() if p.name != "_commits"}
    assert len(kept) <= 9 and len(list(Path(out, "_commits").glob("*.json"))) == versions.KEPT_COMMITS
    partials = tables.read_summaries(spark, out)
    assert partials.agg(F.sum("rows")).first()[0] == frame.count()
    got = tables.fresh_levels(partials, frame)
    for name, want in buckets.multires_levels(frame).items():
        a, b = (buckets.in_order(df).toPandas() for df in (got[name], want))
        assert len(b) > 5
        pd.testing.assert_frame_equal(a[b.columns], b, check_exact=False, rtol=1e-11, atol=1e-9)


def test_no_digits_cancel(spark):
    frame = messages(spark, {"a": (pd.date_range(T0, periods=1200, freq="1s"),
                                   1e6 + np.random.default_rng(5).normal(0, 1e-3, 1200))})
    got = tables.bucket_rows(tables.partial_stats(frame), 60).first()
    want = np.array([float(r.payload) for r in frame.collect()])
    assert got.n == 1200 and got.s == pytest.approx(want.std(), rel=1e-6)


def test_unique_rows_without_watermark(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    times = [0, 100, 1, 200, 0, 100, 1, 5000]
    for i, hours in enumerate(times):
        frame = messages(spark, {"a": (pd.DatetimeIndex([T0 + timedelta(hours=hours)] * 2), [1.0, 2.0])})
        stream_in(spark, source, frame.withColumn("id", F.col("id") + i), lambda feed: tables.keep_unique(
            feed, out, state, seconds=None, most_folders=2))
    rows = versions.read(spark, out, frame.schema)
    assert rows.count() == 5 and rows.select("timestamp").distinct().count() == 5
    notes = versions.latest(spark, out).notes
    assert (notes["received"], notes["stored"]) == (16, 5)
    with pytest.raises(ValueError):
        tables.keep_unique(rows, out, state, keys=("topic",))


def test_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame = messages(spark, {"a": level_signal(np.random.default_rng(4), 60)})

    def start(feed):
        return tables.keep_summaries(feed, out, state, seconds=None)

    # The run dies after its commit, before the checkpoint notes the batch: Spark repeats the batch.
    def dies(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "expire", dies)
        with pytest.raises(Exception, match="lost"):
            stream_in(spark, source, frame, start)
    start(ingest.file_feed(spark, source, frame.schema)).awaitTermination()
    assert tables.read_summaries(spark, out).agg(F.sum("rows")).first()[0] == 60
    # The run dies after its data, before its commit.
    with monkeypatch.context() as patch:
        patch.setattr(versions, "commit", dies)
        with pytest.raises(Exception, match="lost"):
            stream_in(spark, source, frame, start)
    assert tables.read_summaries(spark, out).agg(F.sum("rows")).first()[0] == 60
    start(ingest.file_feed(spark, source, frame.schema)).awaitTermination()
    assert tables.read_summaries(spark, out).agg(F.sum("rows")).first()[0] == 120


@pytest.mark.parametrize("stop", ["copying", "copied", "done"])
def test_archive_resumes(spark, tmp_path, monkeypatch, stop):
    live, store = str(tmp_path / "live"), str(tmp_path / "store")
    frame = messages(spark, {"s": level_signal(np.random.default_rng(9), 50)})
    frame.write.parquet(live)
    record = archive._record

    def dies(spark, path, month, **step):
        if step["state"] == stop:
            raise OSError("lost")
        record(spark, path, month, **step)

    with monkeypatch.context() as patch:
        patch.setattr(archive, "_record", dies)
        with pytest.raises(OSError):
            archive.archive_month(spark, live, store, "2024-01")
    assert archive.archive_month(spark, live, store, "2024-01") == 50
    assert spark.read.parquet(live).count() == 0
    assert spark.read.parquet(f"{store}/archive_month=2024-01").count() == 50
    assert [r.archive_month for r in archive.list_archives(spark, store).collect()] == ["2024-01"]
    with pytest.raises(FileExistsError):
        archive.archive_month(spark, live, store, "2024-01")


def test_archive_version(spark, tmp_path, monkeypatch):
    live, store = str(tmp_path / "live"), str(tmp_path / "store")
    schema = numbers(spark, [1]).schema

    def add(name, values):
        versions.commit(spark, live, versions.write_folders(numbers(spark, values), live, name, ("day",)))

    add("a", [1, 2])
    copy = archive._copy

    def slow(rows, target):
        # A merge and a new batch happen while the first copy is made.
        done = copy(rows, target)
        if versions.latest(spark, live).number == 1:
            add("b", [3])
            versions.compact(spark, live, schema, ("day",), most=1)
            add("c", [4])
        return done

    monkeypatch.setattr(archive, "_copy", slow)
    assert archive.archive_version(spark, live, schema, store, "2024-01") == 4
    assert versions.read(spark, live, schema).count() == 0
    assert spark.read.parquet(f"{store}/archive_month=2024-01").count() == 4
    add("d", [5])
    with pytest.raises(FileExistsError):
        archive.archive_version(spark, live, schema, store, "2024-01")
    assert archive.archive_version(spark, live, schema, store, "2024-02") == 1
