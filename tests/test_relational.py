"""Filters, buckets, statistics, routing, merging on small hand-made tables."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeflow.streaming import ingest
from gaugeflow import schemas
from gaugeflow.operators import buckets, derive, filters, merge, routing, stats

T0 = datetime(2024, 1, 1)
LEVEL = "site/level"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def messages(spark, rows):
    """(seconds, payload[, topic]) rows as messages."""
    return spark.createDataFrame(
        [(i, at(r[0]), r[2] if len(r) > 2 else LEVEL, r[1], 1, False) for i, r in enumerate(rows)],
        schemas.MESSAGES)


def readings(spark, rows):
    """(seconds, type, temperature, humidity) rows as readings."""
    return spark.createDataFrame(
        [(i, at(s), "t", "d", kind, temp, hum, None, None, None) for i, (s, kind, temp, hum) in enumerate(rows)],
        schemas.READINGS)


def test_buckets_edges_and_nulls(spark):
    rows = messages(spark, [(0, "1"), (59.999999, "3"), (60, "5"), (61, None), (30, "100", "other")])
    got = buckets.in_order(buckets.level_buckets(rows, 1, topic=LEVEL)).collect()
    assert [r.t for r in got] == sorted(r.t for r in got)
    assert [(r.t, r.m, r.s, r.n, r.min, r.max) for r in got] == [
        (at(0), 2.0, 1.0, 2, 1.0, 3.0), (at(60), 5.0, 0.0, 1, 5.0, 5.0)]


def test_lookback_counts_null_payloads(spark):
    rows = messages(spark, [(0, "1"), (3000, "2"), (5000, None)])
    assert [r.n for r in buckets.level_buckets(rows, 60, 1, topic=LEVEL).collect()] == [1]
    assert [r.n for r in buckets.level_buckets(rows, 60, 1).collect()] == [1]
    literal = buckets.level_buckets(rows, 60, 1, topic=LEVEL, as_of=at(5000))
    assert [r.n for r in literal.collect()] == [1]


def test_lookback_scope(spark):
    rows = readings(spark, [(0, "air", 20.0, 40.0), (7200, "water", 5.0, None), (7300, "water", None, None)])
    assert [r.device_type for r in buckets.sensor_buckets(rows, 60, 1).collect()] == ["water"]
    both = buckets.sensor_buckets(rows, 60, 1, scope="type").collect()
    assert sorted(r.device_type for r in both) == ["air", "water"]


def test_sensor_nulls(spark):
    rows = readings(spark, [(0, "air", 20.0, None), (1, "air", 22.0, 50.0), (2, "air", None, 70.0),
                            (3, "water", 4.0, 9.0), (4, "soil", 1.0, 1.0)])
    got = {r.device_type: r for r in buckets.sensor_buckets(rows, 60).collect()}
    assert set(got) == {"air", "water"}
    assert got["air"].n == 2 and got["air"].humidity.m == 50.0 and got["air"].temp.m == 21.0
    assert got["water"].humidity is None


def test_bad_payload(spark):
    rows = messages(spark, [(0, "1"), (1, "oops")])
    with pytest.raises(Exception, match="not a number"):
        buckets.level_buckets(rows, 1).collect()
    assert buckets.level_buckets(rows, 1, on_error="null").first().m == 1.0


def test_recent_raw_keeps_nulls(spark):
    rows = messages(spark, [(0, "1"), (601, None), (700, "3")])
    assert [r.water_level_mm for r in filters.recent_raw(rows, 10).collect()] == [None, 3.0]
    assert [r.water_level_mm for r in filters.recent_raw(rows, 10, LEVEL).collect()] == [None, 3.0]


def test_query_messages(spark):
    rows = messages(spark, [(0, "a", "t_1"), (1, "b", "tx1"), (2, "c", "t\\1"), (3, "d", "u_1")])
    def topics(**k):
        return [r.topic for r in filters.query_messages(rows, **k).collect()]
    assert topics(topic_like="t_1") == ["t\\1", "tx1", "t_1"]
    assert topics(topic_like="t\\1") == ["t\\1"]
    assert topics(topic_like="%\\_") == ["t\\1"]
    assert topics(start=at(1), end=at(2)) == ["t\\1", "tx1"]
    assert topics(limit=1) == ["u_1"] and len(topics(limit=0)) == 4


def test_season(spark):
    days = spark.createDataFrame([(date(2024, 12, 1),), (date(2025, 1, 15),), (date(2025, 1, 16),)], "d DATE")
    got = days.select(filters.season_flag("d", date(2024, 12, 1), date(2025, 1, 15))).collect()
    assert [r[0] for r in got] == [True, True, False]


def test_replay_and_last_rows(spark):
    rows = messages(spark, [(i * 600, str(i), f"t{i % 2}") for i in range(50)])
    assert filters.replay_visible(rows, at(1200), 600).count() == 2
    assert [r.payload for r in filters.last_rows(rows, 3).collect()] == ["47", "48", "49"]
    each = filters.last_rows(rows, 7, ("topic",)).collect()
    assert sorted(int(r.payload) for r in each) == list(range(36, 50))


@pytest.mark.parametrize("seconds,hz", [([0], 0.0), ([5, 5], 0.0), (list(range(61)), 61 / 60), ([0, 100, 110], 0.2)])
def test_frequency(spark, seconds, hz):
    rows = messages(spark, [(s, "1") for s in seconds]).withColumnRenamed("topic", "series")
    assert stats.frequency_hz(rows).first().hz == pytest.approx(hz)


def test_table_stats(spark):
    rows = messages(spark, [(0, "1", "a"), (9, "1", "a"), (3, "1", "b")])
    got = stats.table_stats(rows).first()
    assert (got["count"], got.first_message, got.last_message, got.unique_topics) == (3, at(0), at(9), 2)
    none = stats.table_stats(rows.where("false")).first()
    assert none["count"] == 0 and none.unique_topics is None


def test_measurement_stats_without_values(spark):
    rows = filters.recent_raw(messages(spark, [(0, None)]), 10)
    assert stats.measurement_stats(rows).count() == 0


def test_latest_reading_prefers_first_resolution_with_rows(spark):
    rows = readings(spark, [(0, "air", 1.0, 2.0), (7200, "water", 3.0, None)])
    parts = list(buckets.multires_sensors(rows).values())
    assert [(r["rank"], r.device_type) for r in stats.latest_reading(parts).collect()] == [(0, "water")]
    assert {(r["rank"], r.device_type) for r in stats.latest_reading(parts[2:]).collect()} == {(0, "air"), (0, "water")}


def feed(spark, rows):
    return spark.createDataFrame(
        [(i, at(i), topic, payload.encode()) for i, (topic, payload) in enumerate(rows)],
        "id BIGINT, timestamp TIMESTAMP_NTZ, topic STRING, payload BINARY")


def test_parse_report(spark):
    def report(event, data):
        return '{"event":"%s","deviceId":"x","data":%s}' % (event, data)

    rows = feed(spark, [
        ("yl-home/h/A/report", report("THSensor.Report", '{"temperature":70.5,"humidity":40,"battery":3,"loraInfo":{"signal":-9}}')),
        ("yl-home/h/W/report", report("THSensor.Report", '{"temperature":50,"humidity":0}')),
        ("yl-home/h/A/report", report("THSensor.Alert", '{"temperature":1}')),
        ("yl-home/h/A/report", report("THSensor.Report", '{"humidity":1}')),
        ("yl-home/h/Z/report", report("THSensor.Report", '{"temperature":1}')),
        ("yl-home/h/A/report", "not json"),
        ("yl-home/h/A/report", report("THSensor.Report", '{"temperature":2,"loraInfo":null}')),
        ("short/topic", report("THSensor.Report", '{"temperature":1}')),
    ])
    devices = spark.createDataFrame([("A", "air"), ("W", "water")], "device_id STRING, device_type STRING")
    good, rejected = routing.parse_report(rows, devices)
    got = {r.id: r for r in good.collect()}
    assert set(got) == {0, 1, 6}
    assert (got[0].temperature, got[0].humidity, got[0].battery, got[0].signal) == (70.5, 40.0, 3, -9)
    assert got[0].topic == "yolink/air/A" and got[0].raw_json.startswith("{")
    assert got[1].humidity is None and got[1].signal is None and got[6].signal is None
    assert [r.id for r in rejected.collect()] == [5]


def test_route_both_ways(spark):
    rows = messages(spark, [(i, "1", t) for i, t in enumerate(["a", "a/b", "a/b/c", "x", "a/b"])])
    patterns = [("a/+", "one"), ("a/#", "many"), ("q", "none")]
    for routed in (routing.route(rows, patterns), routing.join_patterns(rows, patterns)):
        assert sorted((r.id, r.table_name) for r in routed.collect()) == [
            (0, "many"), (1, "one"), (2, "many"), (4, "one")]


def test_merge_dedup(spark):
    old = merge.conform_schema(messages(spark, [(0, "a"), (0, "b"), (5, "c")]), "messages")
    new = merge.conform_schema(messages(spark, [(0, "x"), (7, "y"), (7, "z"), (5, "c", "other")]), "messages")
    merged, counts = merge.merge_dedup(old, new, merge.MESSAGE_KEY)
    assert sorted(r.payload for r in merged.collect()) == ["a", "b", "c", "c", "y"]
    assert counts.first().asDict() == {"old_count": 3, "new_count": 4, "merged_count": 5}
    again, _ = merge.merge_dedup(merged.withColumn("id", F.lit(0)), new, merge.MESSAGE_KEY)
    assert again.count() == 5


def test_merge_tables(spark):
    m, r = messages(spark, [(0, "a")]), readings(spark, [(0, "air", 1.0, 1.0), (1, "air", 1.0, 1.0)])
    merged = merge.merge_tables(
        {"level": m, "yolink_x": r.drop("device_type"), "_hidden": m}, {"yolink_x": r, "fresh": m.unionByName(m)})
    assert {k: v.count() for k, v in merged.items()} == {"level": 1, "yolink_x": 2, "fresh": 1}
    assert merged["level"].columns == ["timestamp", "topic", "payload", "qos", "retain"]
    assert merge.merge_names(["b", "_x"], ["a", "b"]) == ["a", "b"]
    assert merge.merge_table("n", None, None) is None


def test_classify_and_conform(spark):
    assert merge.classify_table("YoLink_old", []) == "readings"
    assert merge.classify_table("t", ["device_id", "device_type"]) == "readings"
    assert merge.classify_table("t", ["device_id"]) == "messages"
    r = readings(spark, [(0, "air", 1.0, 1.0)])
    assert merge.conform_schema(r.drop("device_type"), "readings") is None
    assert merge.conform_schema(r.drop("battery", "id"), "readings").first().battery is None


def test_new_measurements_keep_repeats(spark):
    known = messages(spark, [(0, "a")])
    fetched = messages(spark, [(0, "b"), (1, "c"), (1, "d")])
    got = derive.new_measurements(known, fetched, ("topic", "timestamp"))
    assert sorted(r.payload for r in got.collect()) == ["c", "d"]


def test_segment_buckets_keep_empty_segments(spark):
    segments = spark.createDataFrame(
        [("s", 1, at(0), at(7200), False), ("s", 2, at(3600), at(90000), False), ("s", 3, at(200000), at(200001), True)],
        "series STRING, id BIGINT, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, is_current BOOLEAN")
    points = spark.createDataFrame(
        [("s", at(h * 3600), float(h)) for h in range(26)] + [("u", at(0), 0.0)],
        "series STRING, t TIMESTAMP_NTZ, m DOUBLE")
    got = derive.segment_buckets(segments, points).groupBy("id").agg(F.count("t").alias("n")).collect()
    assert {r.id: r.n for r in got} == {1: 3, 2: 25, 3: 0}


def test_sensor_axes_clamp(spark):
    rows = readings(spark, [(0, "air", 20.0, 2.0), (1, "air", 20.0, 2.0), (7200, "air", 21.0, 99.0)])
    got = derive.sensor_axes(buckets.sensor_buckets(rows, 60)).first()
    assert (got.temp_min, got.temp_max, got.humidity_min, got.humidity_max) == (63, 75, 0, 100)


def test_merge_keeps_values_of_rows_without_id(spark):
    """Rows as an ingest without ids leaves them: the least row of a key stays whole."""
    rows = [(None, datetime(2024, 1, 1), "t", payload, 1, False) for payload in ("b", "a")]
    schema = "id BIGINT, timestamp TIMESTAMP_NTZ, topic STRING, payload STRING, qos INT, retain BOOLEAN"
    frame = spark.createDataFrame(rows, schema)
    for source in (frame, frame.drop("id")):
        merged = merge.merge_tables({}, {"m": source})["m"].collect()
        assert [(r.payload, r.qos, r.retain) for r in merged] == [("a", 1, False)]
    named = spark.createDataFrame([(5, *rows[0][1:]), *rows], schema)
    assert [r.payload for r in merge.merge_tables({}, {"m": named})["m"].collect()] == ["b"]


def test_kafka_batches_have_no_upper_limit():
    options = ingest.kafka_options("host:1", "t")
    assert options["minOffsetsPerTrigger"] == "1000" and options["maxTriggerDelay"] == "60000ms"
    assert "maxOffsetsPerTrigger" not in options
    assert ingest.kafka_options("host:1", "t", max_messages=5)["maxOffsetsPerTrigger"] == "5"


def test_ingest_gives_ids(spark):
    feed = spark.createDataFrame([("a", b"1"), ("a", b"2")], "topic STRING, payload BINARY")
    ids = [r.id for r in ingest.stamped(feed).collect()]
    assert None not in ids and len(set(ids)) == 2
