import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import times, topics, values


def column(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], schema).select(expression).collect()]


@pytest.mark.parametrize("pattern,topic,matches", [
    ("a/+", "a/b", True), ("a/+", "a", False), ("a/+", "a/b/c", False), ("a/+", "a/", True),
    ("a/#", "a", True), ("a/#", "a/b/c", True), ("a/#", "ab", False), ("#", "x/y", True), ("#", "", True),
    ("#/a", "x/a", False), ("+/#", "x", True), ("a.b/+", "axb/c", False), ("a/+/c", "a/b/c", True),
    ("#/a/#", "#/a/z", True), ("#/a/#", "x/a/z", False), ("a/b", "a/b\n", False),
])
def test_topic_pattern(spark, pattern, topic, matches):
    got = column(spark, [topic], "t STRING", F.col("t").rlike(topics.pattern_regex(pattern)))
    assert got == [matches]


def test_first_pattern_wins(spark):
    patterns = [("a/+", "one"), ("a/#", "many"), ("#", "rest")]
    got = column(spark, ["a", "a/b", "a/b/c", "x"], "t STRING", topics.route_topic("t", patterns))
    assert got == ["many", "one", "many", "rest"]


def test_long_pattern_lists_choose_alike(spark):
    levels = ["a", "b", "+", "", "#"]
    patterns = [("/".join(p), f"t{i}") for i, p in enumerate(itertools.product(levels, levels, ["c", "+", "#", "#/a"]))]
    names = ["/".join(p) for p in itertools.product(["a", "b", "x", "+", "#"], ["a", "c", ""], ["c", "z"])] + ["a", "", None, "a/b"]
    for shown in (patterns, patterns[::-1], [p for p in patterns if p[0].count("/") == 2][::3]):
        inline = column(spark, names, "t STRING", topics.route_topic("t", shown, inline=1000))
        assert column(spark, names, "t STRING", topics.route_topic("t", shown, inline=0)) == inline
    many = [(f"s{i}/+", f"t{i}") for i in range(1000)]
    assert column(spark, ["s7/x", "s999/y", "q"], "t STRING", topics.route_topic("t", many)) == ["t7", "t999", None]


def test_topic_levels(spark):
    assert column(spark, ["yl-home/h/d/report", "x/y"], "t STRING", topics.relay_topic("t")) == [
        "yolink/d/report", "yolink/x/y"]
    assert column(spark, ["yl-home/h/d/a/b"], "t STRING", topics.relay_topic("t", "p")) == ["p/d/a/b"]
    assert column(spark, ["a/b/c/d", "a/b/c"], "t STRING", topics.topic_device("t")) == ["c", "unknown"]


@pytest.mark.parametrize("name,ok", [("water_level", True), ("a1", True), ("_", False), ("", False), ("a-b", False)])
def test_table_name(name, ok):
    assert topics.valid_table_name(name) is ok


def test_decode_payload(spark):
    got = column(spark, [b"\xffA", b"AB", None, "é".encode()], "b BINARY", values.decode_payload("b"))
    assert got == ["ff41", "AB", None, "é"]


def test_cast_value(spark):
    texts = ["10.42", " 7 ", "-1e3", ".5", "inf", None, "5d", "0x1p3", "abc", ""]
    got = column(spark, texts, "p STRING", values.cast_value("p", "null"))
    assert got == [10.42, 7.0, -1000.0, 0.5, float("inf"), None, None, None, None, None]
    for bad in ("5d", "abc", "5F"):
        with pytest.raises(Exception, match="not a number"):
            column(spark, [bad], "p STRING", values.cast_value("p"))


def test_round_decimal(spark):
    random.seed(1)
    numbers = [2.675, 0.125, -2.675, 1.005, 0.375, -0.125, 1e13 + 0.3, 0.0]
    numbers += [random.randrange(10 ** 7) / 1000 for _ in range(3000)]
    numbers += [random.uniform(-100, 100) for _ in range(500)]
    for digits in (2, 3):
        got = column(spark, numbers, "v DOUBLE", values.round_decimal("v", digits))
        assert got == [round(v, digits) if abs(v) < 1e12 else v for v in numbers]


def test_health_and_units(spark):
    got = column(spark, [39.9, 40.0, 50.0, 50.1, None], "v DOUBLE", values.level_health("v"))
    assert got == ["good", "warning", "warning", "needs water", "good"]
    assert column(spark, [2.0], "v DOUBLE", values.mm_to_ml("v")) == [-50.25]
    assert column(spark, [-50.25], "v DOUBLE", values.ml_to_mm("v")) == [2.0]
    assert column(spark, [100.0], "v DOUBLE", values.celsius_to_fahrenheit("v")) == [212.0]


def test_times(spark):
    stamp = datetime(2024, 1, 11, 10, 38, 47, 500000)
    early = datetime(1969, 12, 31, 23, 59, 59, 999999)
    rows = spark.createDataFrame([(stamp,), (early,)], "t TIMESTAMP_NTZ")
    assert [r[0] for r in rows.select(times.bucket_start("t", 7)).collect()][0] == datetime(2024, 1, 11, 10, 36)
    assert [r[0] for r in rows.select(times.bucket_start("t", 10080)).collect()][0] == datetime(2024, 1, 8)
    back = rows.select(times.micros("t").alias("us"), "t").select("us", times.from_micros("us"), "t").collect()
    assert all(r[1] == r[2] for r in back) and back[1][0] == -1
    assert [r[0] for r in rows.select(times.iso_text("t")).collect()][0] == "2024-01-11T10:38:47.500000"
    assert rows.select(times.iso_text(F.date_trunc("second", "t"))).first()[0] == "2024-01-11T10:38:47"


@pytest.mark.parametrize("seconds,text", [
    (0, "00:00:00"), (-5, "00:00:00"), (3661, "01:01:01"), (100 * 3600 + 59, "100:00:59"), (0.9, "00:00:00")])
def test_countdown(spark, seconds, text):
    row = spark.range(1).select(
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("now")).select(
        (F.col("now") + times.interval(seconds)).alias("then"), "now")
    assert row.select(times.countdown_text("then", "now")).first()[0] == text


def test_times_ignore_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.25' AS t")
        us = row.select(times.micros("t")).first()[0]
        assert us == 1710037800250000
        assert row.select(times.from_micros(F.lit(us))).first()[0] == datetime(2024, 3, 10, 2, 30, 0, 250000)
        assert row.select(times.bucket_start("t", 60)).first()[0] == datetime(2024, 3, 10, 2)
        assert row.select(times.iso_text("t")).first()[0] == "2024-03-10T02:30:00.250000"
        assert row.select(times.year_month("t")).first()[0] == "2024-03"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
