"""Feeds that queries make of a table: files of bounded length, two batches, every row once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeflow import queries


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 9, ("view", "click")[i % 2], float(i), '{"k": 1}')
            for i in range(1_000)]
    frame = spark.createDataFrame(
        rows, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING")
    frame.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("feed", ["_report_feed", "_message_feed"])
def test_feed_files_stay_short(spark, events, tmp_path, monkeypatch, feed):
    monkeypatch.setattr(queries, "FEED_FILE_ROWS", 90, raising=False)
    monkeypatch.setattr(queries, "scratch_path", lambda _, label: str(tmp_path / label))
    stream = getattr(queries, feed)(spark, events)
    path = str(tmp_path / {"_report_feed": "reports", "_message_feed": "feed"}[feed])
    files = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(files) == 1_000 and max(files) <= 90 + 10

    seen = []
    stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(
        lambda batch, _: seen.append(batch.count())).start().awaitTermination()
    assert len(seen) == 2 and sum(seen) == 1_000


def test_small_feeds_have_four_files(spark, events, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch_path", lambda _, label: str(tmp_path / label))
    queries._report_feed(spark, events)
    assert spark.read.parquet(str(tmp_path / "reports")).select(F.input_file_name()).distinct().count() == 4
