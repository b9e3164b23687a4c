from datetime import datetime, timedelta

import numpy as np
import pytest

from gaugeflow.operators import alerts
from gaugeflow.operators.alerts import breaches, threshold_alerts
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def brute(times, cooldown):
    sent = []
    for t in sorted(set(times)):
        if not sent or t - sent[-1] >= cooldown:
            sent.append(t)
    return sent


def run(spark, rows, **options):
    frame = spark.createDataFrame(
        [(i, k, T0 + timedelta(seconds=float(s)), float(v)) for i, (k, s, v) in enumerate(rows)],
        "id BIGINT, key STRING, timestamp TIMESTAMP_NTZ, value DOUBLE")
    return threshold_alerts(frame, 10.0, **options).collect()


def test_cooldown(spark):
    hours = [0, 1, 24, 30]
    got = run(spark, [("k", h * 3600, 11) for h in hours] + [("k", 100, 9), ("k", 101, 10)])
    assert sorted(r.timestamp for r in got) == [T0, T0 + timedelta(hours=24)]


def test_lowest_id_speaks_for_a_moment(spark):
    assert [r.value for r in run(spark, [("k", 0, 12), ("k", 0, 99)])] == [12.0]


@pytest.mark.parametrize("target", [1, 1_000_000])
@pytest.mark.parametrize("spacing", ["random", "regular", "rare"])
def test_many_chunks(spark, monkeypatch, spacing, target):
    monkeypatch.setattr(alerts, "TARGET_CHUNK_ROWS", target)
    rng = np.random.default_rng(8)
    seconds = {
        "random": np.sort(rng.integers(0, 600 * 3600, 4000)),
        "regular": np.arange(0, 600 * 3600, 600),
        "rare": np.sort(rng.choice(5000, 30, replace=False)) * 3600,
    }[spacing]
    keys = {"hot": seconds, "other": seconds[::7] + 1}
    got = run(spark, [(k, s, 11) for k, ss in keys.items() for s in ss], cooldown_hours=2.5)
    for key, ss in keys.items():
        mine = sorted((r.timestamp - T0).total_seconds() for r in got if r.key == key)
        assert mine == brute(ss.tolist(), 2.5 * 3600)


def test_below_and_none(spark):
    assert [r.value for r in run(spark, [("k", 0, 12), ("k", 5, 3)], direction="below")] == [3.0]
    assert run(spark, [("k", 0, 5)]) == []
    with pytest.raises(KeyError):
        breaches(1.0, "beside", F.lit(1))


def test_rows_without_id_keep_their_value(spark):
    frame = spark.createDataFrame(
        [(None, "k", T0, 12.0), (None, "k", T0, 11.0), (7, "q", T0, 99.0), (None, "q", T0, 12.0)],
        "id BIGINT, key STRING, timestamp TIMESTAMP_NTZ, value DOUBLE")
    assert {r.key: r.value for r in threshold_alerts(frame, 10.0).collect()} == {"k": 11.0, "q": 99.0}


def test_summaries_stay_short_for_a_dense_key(spark, monkeypatch):
    """With chunks of one cooldown a dense key's summaries are as long as its breaches; still no task of
    the composition sees more than two of them."""
    monkeypatch.setattr(alerts, "TARGET_CHUNK_ROWS", 1)
    seen, stored = [], alerts.materialize

    def keep(df, label="table"):
        out = stored(df, label)
        if label == "composed":
            seen.append(out.groupBy("key", "chunk").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(alerts, "materialize", keep)
    seconds = np.sort(np.random.default_rng(3).integers(0, 200 * 3600, 20_000))
    got = run(spark, [("hot", s, 11) for s in seconds], cooldown_hours=1)
    assert sorted((r.timestamp - T0).total_seconds() for r in got) == brute(seconds.tolist(), 3600)
    dense = max(np.histogram(seconds, 200)[0])
    assert len(seen) == 8 and max(seen) <= 1.5 * dense
