"""Stored tables, archives, snapshot documents, streaming ingest and restart."""

import gzip
import json
from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeflow import schemas
from gaugeflow.operators import alerts, buckets, segments
from gaugeflow.plans import snapshot
from gaugeflow.session import build_session, lookup_table, measured, shared_root, sized
from gaugeflow.sources import archive, snapshots, tables
from gaugeflow.streaming import ingest, stateful
from test_timeseries import level_signal, messages

T0 = datetime(2024, 1, 1)
SEASON = (date(2023, 12, 1), date(2024, 1, 15))


def feed_rows(spark, rows):
    return spark.createDataFrame(
        [(t, p, 1, False, T0 + timedelta(seconds=s)) for s, t, p in rows],
        "topic STRING, payload BINARY, qos INT, retain BOOLEAN, timestamp TIMESTAMP_NTZ")


def test_missing_tables_are_empty(spark, tmp_path):
    assert tables.scan_readings(spark, str(tmp_path / "none")).columns == schemas.READINGS.names
    assert tables.scan_readings(spark, table="no_such_table").count() == 0
    assert snapshots.read_snapshots(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        tables.scan_readings(spark, table="bad;name")


def test_lookup_sizes(spark):
    stored, seen = measured(spark.range(10), top=F.max("id"))
    assert seen == {"rows": 10, "top": 9} and stored.count() == 10

    def plan(df):
        return spark.range(5).join(df, "id")._jdf.queryExecution().optimizedPlan().toString()

    assert "broadcast" in plan(lookup_table(spark.range(10)))
    assert "broadcast" not in plan(lookup_table(spark.range(10), max_rows=9))
    assert "broadcast" in plan(sized(stored, 10)) and "broadcast" not in plan(sized(stored, 9))
    assert shared_root(spark)


def test_archive_round_trip(spark, tmp_path):
    live, store = str(tmp_path / "live"), str(tmp_path / "store")
    frame = messages(spark, {"s": level_signal(np.random.default_rng(9), 50)})
    frame.write.parquet(live)
    assert archive.archive_month(spark, live, store, "2024-01") == 50
    assert spark.read.parquet(live).count() == 0
    listed = archive.list_archives(spark, store).collect()
    assert [r.archive_month for r in listed] == ["2024-01"] and listed[0].size > 0
    assert archive.restore_archive(spark, store, "2024-01", str(tmp_path / "back")).count() == 50
    with pytest.raises(FileExistsError):
        archive.archive_month(spark, live, store, "2024-01")


def test_snapshot_document(spark, tmp_path):
    rng = np.random.default_rng(10)
    ts, v = level_signal(rng, 1200)
    frame = messages(spark, {"a": (ts, v), "small": (ts[:3], v[:3])})
    readings = spark.createDataFrame(
        [(i, ts[i].to_pydatetime(), "t", "d", kind, 20.125, 40.0 if kind == "air" else None, 1, -1, "{}")
         for i in range(0, 1200, 100) for kind in ("air", "water")], schemas.READINGS)
    built = snapshot.snapshot_batch(frame, readings, *SEASON, datetime(2024, 1, 15, 23))
    path = tmp_path / "docs"
    snapshots.write_snapshots(built, str(path), per_series=True)
    files = {p.parent.name: json.loads(gzip.decompress(p.read_bytes())) for p in Path(path).glob("*/*.gz")}
    doc = files["series=a"]
    assert doc["season"] == {"start": "2023-12-01", "end": "2024-01-15", "is_active": True}
    assert doc["replay_delay_seconds"] == 300 and doc["generated_at"] == "2024-01-15T23:00:00"
    assert doc["agg_1m"]["interval_minutes"] == 1 and "lookback_hours" not in doc["agg_1h"]
    hours = [p["t"] for p in doc["agg_1h"]["data"]]
    assert hours == sorted(hours) and sum(p["n"] for p in doc["agg_1h"]["data"]) == 1200
    first = v[(ts >= pd.Timestamp(hours[0])) & (ts < pd.Timestamp(hours[0]) + pd.Timedelta("1h"))]
    assert doc["agg_1h"]["data"][0]["m"] == pytest.approx(round(float(first.mean()), 2), abs=0.011)
    last = ts >= ts[-1] - pd.Timedelta("10min")
    assert [m["water_level_mm"] for m in doc["measurements"]] == v[last].tolist()
    assert doc["stats"]["measurement_count"] == int(last.sum())
    assert doc["stats"]["stddev"] == pytest.approx(v[last].std())
    site = files["series=__HIVE_DEFAULT_PARTITION__"]
    assert "yolink_sensors" not in doc and "series" not in site and "part" not in site
    air = site["yolink_sensors"]["agg_1h"]["air"][0]
    assert air["temp"]["m"] == 20.12 and air["humidity"]["m"] == 40.0
    assert "humidity" not in site["yolink_sensors"]["agg_1h"]["water"][0]
    assert {"segments", "extrema"} <= set(doc["analysis"])
    assert all(e["distance_mm"] == round(e["distance_mm"], 2) for e in doc["analysis"]["extrema"]["minima"])
    assert "analysis" not in files["series=small"] and files["series=small"]["stats"]["measurement_count"] == 3
    back = snapshots.read_snapshots(spark, str(path))
    assert back.count() == 3


def test_snapshot_parts_are_optional(spark):
    ts, _ = level_signal(np.random.default_rng(11), 5)
    frame = messages(spark, {"a": (ts, ["1", "2", "3", "4", "5"])})
    text = snapshots.document_text(
        snapshot.snapshot_batch(frame, None, *SEASON, datetime(2024, 2, 1), analysis=False)).first().value
    doc = json.loads(text)
    assert "analysis" not in doc and "yolink_sensors" not in doc and doc["season"]["is_active"] is False
    empty = frame.withColumn("payload", F.lit(None).cast("string"))
    doc = json.loads(snapshots.document_text(
        snapshot.snapshot_batch(empty, None, *SEASON, datetime(2024, 2, 1), analysis=False)).first().value)
    assert doc["stats"] == {} and "agg_1h" not in doc


@pytest.mark.parametrize("items", [1, 7, 1000])
def test_long_lists_go_on_in_parts(spark, items):
    ts, v = level_signal(np.random.default_rng(12), 30)
    frame = messages(spark, {"a": (ts, v), "b": (ts[:3], v[:3])})
    rows = frame.select(F.col("topic").alias("series"), "timestamp", "id",
                        F.col("payload").cast("double").alias("water_level_mm"))
    readings = buckets.sensor_buckets(spark.createDataFrame(
        [(i, t.to_pydatetime(), "t", "d", "air", 20.0, 40.0, 1, -1, "{}") for i, t in enumerate(ts)],
        schemas.READINGS), 1)
    parts = snapshot.Parts(rows, {"agg_1m": buckets.level_buckets(frame, 1)}, {"agg_1m": readings})
    docs = snapshot.assemble_snapshot(parts, *SEASON, T0, part_items=items).collect()
    for series, of_doc in (("a", lambda d: [m.water_level_mm for m in d.measurements or ()]),
                           ("a", lambda d: [p.t for p in (d.agg_1m.data if d.agg_1m else ())]),
                           (None, lambda d: [p.t for p in d.yolink_sensors.agg_1m.air])):
        mine = sorted((d for d in docs if d.series == series), key=lambda d: d.part or 0)
        assert [d.part for d in mine] == [None, *range(1, len(mine))]
        whole = [x for d in mine for x in of_doc(d)]
        assert whole == (v.tolist() if isinstance(whole[0], float) else sorted(whole)) and len(whole) > 1
        assert all(len(of_doc(d)) == items for d in mine[:len(whole) // items])
    assert sum(d.stats is not None for d in docs) == 2


def test_bad_payload_and_lenient(spark):
    frame = messages(spark, {"a": (level_signal(np.random.default_rng(13), 3)[0], ["1", "x", "3"])})
    with pytest.raises(Exception, match="not a number"):
        snapshot.snapshot_batch(frame, None, *SEASON, T0, analysis=False)
    doc = snapshot.snapshot_batch(frame, None, *SEASON, T0, analysis=False, lenient=True, on_error="null").first()
    assert doc.stats.measurement_count == 2


def test_ingest_survives_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    patterns = [("a/+", "first"), ("b/#", "second")]
    schema = feed_rows(spark, [(0, "a", b"")]).schema

    def go():
        rows = ingest.ingest_messages(ingest.file_feed(spark, source, schema), patterns)
        ingest.flush_routed(rows, out, str(tmp_path / "state"), seconds=None).awaitTermination()
        return spark.read.parquet(out)

    feed_rows(spark, [(0, "a/x", b"1"), (1, "b", b"\xff"), (2, "c", b"3")]).write.parquet(source)
    assert sorted((r.table_name, r.payload) for r in go().collect()) == [("first", "1"), ("second", "ff")]
    feed_rows(spark, [(90000, "b/q", b"4")]).write.mode("append").parquet(source)
    rows = go()
    assert sorted(r.payload for r in rows.collect()) == ["1", "4", "ff"]
    assert sorted(r.payload for r in go().collect()) == ["1", "4", "ff"]
    assert rows.where("table_name = 'second' AND date = '2024-01-02'").count() == 1
    packed = ingest.compact(spark, out, str(tmp_path / "packed"))
    assert packed.count() == 3 and "batch_id" not in packed.columns
    with pytest.raises(ValueError):
        ingest.ingest_messages(spark.range(1), [("a", "bad name")])


def test_receipt_time_is_stamped(spark):
    rows = ingest.stamped(spark.createDataFrame([("t", b"1", 0, False)], schemas.FEED))
    assert dict(rows.dtypes)["timestamp"] == "timestamp_ntz" and rows.first().timestamp is not None


def test_streamed_buckets_equal_batch(spark, tmp_path):
    frame = messages(spark, {"a": level_signal(np.random.default_rng(14), 300)})
    frame = frame.withColumn("qos", F.lit(1)).withColumn("retain", F.lit(False)).orderBy("timestamp")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    halves = [frame.limit(150), frame.subtract(frame.limit(150))]
    for part in halves:
        part.coalesce(1).write.mode("append").parquet(source)
        feed = ingest.file_feed(spark, source, frame.schema)
        stateful.write_updates(stateful.stream_buckets(feed, 60), out, str(tmp_path / "state"),
                               seconds=None).awaitTermination()
    got = stateful.latest_updates(spark, out).orderBy("t").toPandas()
    want = buckets.in_order(buckets.level_buckets(frame, 60)).toPandas()
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_streamed_alerts_equal_batch(spark, tmp_path):
    frame = messages(spark, {"a": level_signal(np.random.default_rng(15), 900)}).select(
        "id", F.col("topic").alias("key"), "timestamp", F.col("payload").cast("double").alias("value"))
    ordered = frame.orderBy("timestamp")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = ordered.limit(400)
    for part in (first, ordered.subtract(first)):
        part.coalesce(1).write.mode("append").parquet(source)
        feed = ingest.file_feed(spark, source, frame.schema)
        ingest.append_stream(stateful.stream_alerts(feed, 30.0, cooldown_hours=1), out,
                             str(tmp_path / "state"), seconds=None).awaitTermination()
    want = alerts.threshold_alerts(frame, 30.0, cooldown_hours=1)
    got = spark.read.parquet(out)
    assert want.count() > 3
    assert sorted(map(tuple, got.select("key", "timestamp", "value").collect())) == sorted(
        map(tuple, want.select("key", "timestamp", "value").collect()))


def test_stream_dedup(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = messages(spark, {"a": (pd.DatetimeIndex([T0, T0, T0 + timedelta(seconds=1)]), [1, 2, 3])})
    for _ in range(2):
        frame.write.mode("append").parquet(source)
        feed = ingest.file_feed(spark, source, frame.schema)
        ingest.append_stream(stateful.stream_dedup(feed), out, str(tmp_path / "state"), seconds=None).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_late_rows_are_counted(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    late = 0
    for hours in (0, 100, 1, 200):
        frame = messages(spark, {"a": (pd.DatetimeIndex([T0 + timedelta(hours=hours)]), [1.0])})
        frame.coalesce(1).write.mode("append").parquet(source)
        feed = ingest.file_feed(spark, source, frame.schema)
        run = stateful.write_updates(stateful.stream_buckets(feed, 60), out, state, seconds=None)
        run.awaitTermination()
        late += stateful.dropped_as_late(run)
    assert late == 1 and stateful.latest_updates(spark, out).count() == 3


def test_session_defaults():
    assert build_session().conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert segments.TARGET_MM == 50.0
