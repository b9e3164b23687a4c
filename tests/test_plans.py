"""Physical plans: what is pushed down, what is shuffled, what is broadcast."""

from datetime import datetime

import pytest

from gaugeflow import session
from gaugeflow.operators import buckets, filters, merge, routing, stats
from gaugeflow.session import materialize
from gaugeflow.sources import tables


@pytest.fixture(scope="module")
def stored(spark, sf):
    return materialize(tables.messages_from_events(tables.events(spark, sf)))


@pytest.fixture(autouse=True)
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_and_topic_are_pushed(stored):
    text = plan(buckets.level_buckets(stored, 5, 24, topic="events/view/raw"))
    assert "GreaterThanOrEqual(timestamp" in text and "EqualTo(topic,events/view/raw)" in text
    assert "ReadSchema: struct<timestamp:timestamp_ntz,topic:string,payload:string>" in text
    for df in (buckets.level_buckets(stored, 5, 24), filters.query_messages(stored, datetime(2024, 1, 2))):
        assert "GreaterThanOrEqual(timestamp" in plan(df)


def test_buckets_combine_before_one_shuffle(stored):
    text = plan(buckets.level_buckets(stored, 60))
    assert text.count("hashpartitioning") == 1 and "partial_avg" in text


def test_routing_needs_no_shuffle(stored):
    text = plan(routing.route(stored, [("events/+/raw", "a"), ("#", "b")]))
    assert "Exchange" not in text and "Join" not in text


def test_last_rows_are_limited_before_the_shuffle(stored):
    text = plan(filters.last_rows(stored, 5, ("topic",)))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "TakeOrderedAndProject" in plan(filters.query_messages(stored, limit=5))


def test_merge_reduces_both_sides_first(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = merge.conform_schema(stored, "messages")
        text = plan(merge.new_rows(rows, rows, merge.MESSAGE_KEY))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One shuffle per side: the anti-join reuses the hashing of the two aggregations.
    assert text.count("hashpartitioning") == 2 and "LeftAnti" in text
    assert "partial_min" in text


def test_stats_read_two_columns(stored):
    text = plan(stats.table_stats(stored))
    assert "ReadSchema: struct<timestamp:timestamp_ntz,topic:string>" in text and "Expand" not in text


def test_reports_are_parsed_once(spark, sf):
    feed = materialize(tables.report_feed_from_events(tables.events(spark, sf)))
    good, _ = routing.parse_report(feed, tables.devices_from_events(tables.events(spark, sf)))
    assert plan(good).count("from_json") == 1


def test_resolutions_read_the_bounds_once_and_do_not_sort(spark, stored):
    text = "".join(plan(df) for df in buckets.multires_levels(stored).values())
    assert "rangepartitioning" not in text and text.count("topic:string,payload:string") == 3
    assert "rangepartitioning" in plan(buckets.in_order(buckets.level_buckets(stored, 60)))


def test_large_lookups_are_not_broadcast(spark, stored, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(routing.join_patterns(stored, [("events/+/raw", "a")]))
        monkeypatch.setattr(session, "BROADCAST_MAX_BYTES", 10)
        text = plan(routing.join_patterns(stored, [("events/+/raw", "a")]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
