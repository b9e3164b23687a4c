"""Time-series operators against direct versions, with chunks made small so that borders matter."""

import brute
import compare
import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import chunks, extrema, medians, segments
from gaugeflow.oracles import ORACLES
from gaugeflow.plans import analysis
from gaugeflow.queries import QUERIES
from gaugeflow.session import materialize, measured

START = pd.Timestamp("2024-01-01")


@pytest.fixture(params=[7, 64, chunks.CHUNK_ROWS])
def chunk_rows(request, monkeypatch):
    for module in (chunks, extrema, segments):
        monkeypatch.setattr(module, "CHUNK_ROWS", request.param)
    return request.param


def level_signal(rng, rows, copies=False, spikes=True):
    """A rising level that drops back now and then, with noise, repeats and outliers."""
    gaps = rng.choice([60, 60, 60, 61, 240], rows)
    if copies:
        gaps[rng.random(rows) < 0.2] = 0
    seconds = np.cumsum(gaps)
    value = 10 + (seconds % 20_000) / 550 + rng.normal(0, 0.4, rows)
    if spikes:
        value[rng.random(rows) < 0.01] += 25
    return START + pd.to_timedelta(seconds, unit="s"), np.round(value, 1)


def messages(spark, series):
    rows = [
        pd.DataFrame({"topic": name, "timestamp": ts, "payload": [str(v) for v in values]})
        for name, (ts, values) in series.items()
    ]
    frame = pd.concat(rows, ignore_index=True)
    return spark.createDataFrame(frame, "topic STRING, timestamp TIMESTAMP_NTZ, payload STRING").withColumn(
        "id", F.monotonically_increasing_id())


def smooth_frame(spark, series, rows):
    """Ready-made smooth series in chunks of ``rows``, one sample a minute."""
    data = []
    for name, values in series.items():
        for i, v in enumerate(values):
            data.append((name, i // rows, i * 60_000_000, 1, float(v)))
    frame = spark.createDataFrame(
        data, "series STRING, chunk BIGINT, us BIGINT, n BIGINT, local_median DOUBLE")
    described = frame.repartition("series", "chunk").sortWithinPartitions("chunk", "series", "us").mapInArrow(
        chunks.over_groups(lambda table, first: extrema.describe_runs(table), ("series", "chunk")),
        "series STRING, chunk BIGINT, us BIGINT, n BIGINT, local_median DOUBLE" + extrema.RUN_SCHEMA)
    return extrema.place_chunks(materialize(described))


def random_series(rng):
    steps = rng.integers(-3, 4, 700)
    return {
        "walk": np.cumsum(steps).astype(float),
        "noise": rng.integers(0, 12, 700).astype(float),
        "zigzag ramp": np.arange(600) * 0.5 + (np.arange(600) % 2) * 6,
        "square": np.where(np.arange(500) % 10 < 5, 0.0, 9.0),
        "flat": np.zeros(150),
        "falling zigzag": -np.arange(400) + (np.arange(400) % 3) * 7.0,
        "short": np.array([1.0, 3, 3, 3, 3, 1]),
        "down": np.array([3.0, 2, 1]),
    }


def test_weighted_range_medians():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        values, weights = rng.integers(0, 9, n).astype(float), rng.integers(1, 5, n)
        lo = rng.integers(0, n, 20)
        hi = np.minimum(n, lo + rng.integers(1, n + 1, 20))
        got = medians.weighted_range_medians(values, weights, lo, hi)
        want = [np.median(np.repeat(values[a:b], weights[a:b])) for a, b in zip(lo, hi)]
        assert got.tolist() == want


def test_frame_edges(spark):
    ts = START + pd.to_timedelta([0, 150, 300, 450], unit="s")
    rows = medians.with_rolling_median(messages(spark, {"s": (ts, [1.0, 10.0, 100.0, 1000.0])}))
    assert [r.local_median for r in rows.orderBy("timestamp").collect()] == [5.5, 55.0, 550.0, 1000.0]


@pytest.mark.parametrize("chunk_us", [150_000_000, 3_600_000_000, 86_400_000_000])
def test_rolling_median_is_pandas(spark, chunk_us):
    rng = np.random.default_rng(1)
    series = {"a": level_signal(rng, 900, copies=True), "b": level_signal(rng, 300)}
    values = materialize(medians.collapse(medians.series_values(messages(spark, series))))
    got = medians.rolling_median(values, 300, per_instant=True, chunk_us=chunk_us).toPandas()
    for name, (ts, v) in series.items():
        want = pd.Series(v, index=ts).rolling("300s", center=True, min_periods=1).median()
        want = want[~want.index.duplicated()]
        mine = got[got.series == name].sort_values("us")
        assert mine.local_median.tolist() == want.tolist()
        assert mine.n.sum() == len(v)


def test_chunk_length_follows_density(spark, monkeypatch):
    ts = START + pd.to_timedelta(np.arange(2000), unit="s")
    values = materialize(medians.series_values(messages(spark, {"a": (ts, np.arange(2000.0))})))
    def length():
        return medians.series_density(values, 150_000_000).chunk_us

    assert length() == 86_400_000_000
    monkeypatch.setattr(medians, "TARGET_CHUNK_ROWS", 400)
    assert length() == 300_000_000
    monkeypatch.setattr(medians, "TARGET_CHUNK_ROWS", 1)
    assert length() == 150_000_000


def test_exact_median(spark):
    rng = np.random.default_rng(2)
    data = {
        "normal": rng.normal(0, 1, 1001), "ties": rng.integers(-2, 3, 400).astype(float),
        "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 250), -(10.0 ** rng.uniform(-300, 300, 251))]),
        "pair": np.array([1.0, 2.0]), "one": np.array([-0.5]), "zero": np.zeros(7),
        "near": 100 + np.arange(100) * 1e-12,
    }
    rows = spark.createDataFrame(
        [(k, float(v), int(w)) for k, vs in data.items()
         for v, w in zip(vs, rng.integers(1, 4, len(vs)))], "series STRING, v DOUBLE, n BIGINT")
    frame = rows.toPandas()
    want = {k: np.median(np.repeat(g.v.values, g.n.values)) for k, g in frame.groupby("series")}
    assert {r.series: r.median for r in medians.exact_median(rows, "v").collect()} == want


def test_median_of_a_dense_bin(spark, monkeypatch):
    """Many different values in one bin, clumps within it, neighbouring doubles and hot values: no more
    rows are ordered than allowed, whatever the rounds."""
    monkeypatch.setattr(medians, "ORDERED_ROWS", 500)
    ordered, order = [], medians._ordered_median
    def watched(inside):
        ordered.append(inside.groupBy("series").count().agg(F.max("count")).first()[0])
        return order(inside)

    monkeypatch.setattr(medians, "_ordered_median", watched)
    rng = np.random.default_rng(12)
    fine = 100 + np.arange(20_001) * 2.0 ** -46
    data = {
        "even": 100 + rng.random(40_000) * 0.01, "clump": np.concatenate([fine, 100 + rng.random(3_000) * 0.02]),
        "next": np.nextafter(7.0, np.repeat([0.0, 8.0], 3_000)), "below": -fine, "few": np.array([3.0, 1.0, 2.0, 9.0]),
        "tiny": rng.integers(1, 9_000, 9_001) * 5e-324, "endless": np.repeat([-np.inf, 1.5, np.inf], [2_000, 1, 2_000]),
        "hot": np.repeat([1.0, 1.00001, 1.00002], [4_000, 1, 3_999])}
    rows = spark.createDataFrame(pd.DataFrame({
        "series": np.repeat(list(data), [len(v) for v in data.values()]), "v": np.concatenate(list(data.values()))}))
    got = {r.series: r.median for r in medians.exact_median(rows.withColumn("n", F.lit(1).cast("bigint")), "v").collect()}
    assert got == {k: np.median(v) for k, v in data.items()}
    assert ordered and max(ordered) <= 500


def test_median_of_many_close_values(spark):
    """Ten million different values within a hundredth of a percent, then all of them with their weights."""
    rows = spark.range(10_000_000).select(
        F.lit("s").alias("series"), (F.lit(100.0) + F.col("id") * 1e-9).alias("v"), F.lit(3).cast("bigint").alias("n"))
    middle = [100.0 + i * 1e-9 for i in (4_999_999, 5_000_000)]
    assert medians.exact_median(rows, "v").first().median == sum(middle) / 2


@pytest.mark.parametrize("target", [1, 500_000])
def test_copies_survive_whatever_the_density(spark, monkeypatch, target):
    """Equal rows may be collapsed on the way; what comes out has them all."""
    monkeypatch.setattr(medians, "TARGET_CHUNK_ROWS", target)
    ts = START + pd.to_timedelta(np.repeat(np.arange(300), 3), unit="s")
    frame = messages(spark, {"a": (ts, np.repeat(np.arange(300.0) % 7, 3))})
    values, density = medians.prepare_values(medians.series_values(frame), 150_000_000)
    rows = medians.expand(medians.residuals(values, chunk_us=density.chunk_us)).collect()
    assert len(rows) == 900 and {r.n for r in rows} == {1}
    clean = medians.expand(analysis.clean_values(values, density)).collect()
    assert len(clean) % 3 == 0 and len(clean) > 0


def test_mad_of_constant_series(spark):
    rows = spark.createDataFrame(
        [("flat", 0.0, 5), ("mostly", 0.0, 8), ("mostly", 3.0, 2)], "series STRING, residual DOUBLE, n BIGINT")
    got = {r.series: r.scale for r in medians.mad_scale(rows).collect()}
    assert got["flat"] == 0.0
    assert got["mostly"] == pytest.approx(np.std([0.0] * 8 + [3.0] * 2))


def test_extrema_are_brute_force(spark, chunk_rows):
    series = random_series(np.random.default_rng(3))
    smooth = smooth_frame(spark, series, chunk_rows)
    points = extrema.turning_points(smooth).where("kind <> 'end'").toPandas()
    assert (points.ord == points["mid"]).all() and (points.us == points["mid"] * 60_000_000).all()
    for name, x in series.items():
        for kind, sign in (("max", 1), ("min", -1)):
            mine = points[(points.series == name) & (points.kind == kind)]
            assert sorted(mine["mid"]) == brute.maxima(list(sign * x)), (name, kind)


def test_prominence_is_brute_force(spark, chunk_rows):
    rng = np.random.default_rng(4)
    series = random_series(rng)
    # Views over many parts: rising and falling peaks, a lone top, stairs seen from far, equal tops.
    teeth = np.tile([0.0, 1.0], 300)
    series |= {
        "rising": np.arange(600) + 40 * teeth, "falling": -np.arange(600) + 40 * teeth,
        "vee": np.abs(np.arange(600) - 300) + 9 * teeth, "roof": -np.abs(np.arange(600) - 300) + 9 * teeth,
        "stairs": np.where(np.arange(600) == 590, 999.0, 600 - np.arange(600) // 40 * 40) * teeth,
        "equal": 5 * teeth, "walk": np.cumsum(rng.integers(-5, 6, 600)).astype(float),
    }
    smooth = smooth_frame(spark, series, chunk_rows)
    got = extrema.prominences(materialize(extrema.turning_points(smooth))).toPandas()
    for name, x in series.items():
        for kind, sign in (("max", 1), ("min", -1)):
            mine = got[(got.series == name) & (got.kind == kind)].sort_values("mid")
            signed = list(sign * x)
            assert mine.prominence.tolist() == [brute.prominence(signed, p) for p in mine["mid"]], (name, kind)
            assert mine["mid"].tolist() == brute.maxima(signed)


def sawtooth(spark, peaks):
    """One series in which every peak is higher, and every valley lower or higher, than all before."""
    pos = F.col("id")
    high = F.when(pos % 2 == 1, pos.cast("double")).otherwise(pos.cast("double") - 1.5)
    return spark.range(2 * peaks).select(
        F.lit("s").alias("series"), F.lit(1).alias("sign"), chunks.floor_div(pos, chunks.CHUNK_ROWS).alias("part"),
        pos.alias("pos"), pos.alias("tag"), high.alias("height"), (pos % 2 == 1).alias("query"))


def test_rising_peaks_stay_in_bounded_groups(spark):
    """Every peak is a record of its part and of the series; still no group holds more than two parts."""
    peaks = 500_000
    samples = materialize(sawtooth(spark, peaks))
    floors = extrema._floors(samples)
    # To the left everything is lower, so the floor is the series' first sample; to the right the next
    # peak is higher, so it is the valley before that.
    wrong = floors.where((F.col("left") != -1.5) | (F.col("right") != F.when(
        F.col("pos") == 2 * peaks - 1, F.col("height")).otherwise(F.col("pos") - 0.5)))
    assert floors.count() == peaks and wrong.count() == 0
    scanned = materialize(samples.repartition("series", "sign", "part").sortWithinPartitions(
        "part", "series", "sign", "pos").mapInArrow(
        chunks.over_groups(extrema._scan_groups, ("series", "sign", "part")), extrema._SCAN_SCHEMA))
    met = extrema._beyond(scanned).groupBy("side", "part", "target").count().toPandas()
    assert met["count"].max() <= 2 * chunks.CHUNK_ROWS
    assert len(met) > peaks // chunks.CHUNK_ROWS


def test_sights_are_two_per_part_and_side():
    """Whatever the tops, parts are taken off the stack once each."""
    rng = np.random.default_rng(9)
    for tops in (np.arange(500.0), -np.arange(500.0), rng.normal(size=500), np.zeros(500), np.append(-np.arange(499.0), 9)):
        rows = pa.record_batch({
            "series": ["s"] * 500, "sign": pa.array([1] * 500, pa.int32()), "side": pa.array([0] * 500, pa.int32()),
            "part": list(range(500)), "top": tops, "low": tops - 1})
        assert sum(b.num_rows for b in extrema._sights([rows])) <= 2 * 500


@pytest.mark.parametrize("rows,halo", [(40, 20), (100, 60), (65_536, 1000)])
def test_min_distance_is_greedy(spark, rows, halo):
    rng = np.random.default_rng(5)
    cases = {
        "random": (np.sort(rng.choice(3000, 900, replace=False)), rng.integers(0, 50, 900)),
        "ramp": (np.arange(0, 2000, 7), np.arange(286)),
        "falling": (np.arange(0, 2000, 7), -np.arange(286)),
        "equal": (np.arange(0, 600, 5), np.zeros(120)),
        "sparse": (np.array([0, 10, 20, 500, 519, 539]), np.array([0.9, 1.0, 0.9, 1, 2, 1])),
    }
    peaks = spark.createDataFrame(
        [(k, "max", int(p), float(h)) for k, (ps, hs) in cases.items() for p, h in zip(ps, hs)],
        "series STRING, kind STRING, mid BIGINT, height DOUBLE").withColumns(
        {"us": F.lit(0).cast("bigint"), "ord": F.lit(0).cast("bigint")})
    got = extrema.min_distance(peaks, 20, rows, halo).toPandas()
    for name, (ps, hs) in cases.items():
        assert sorted(got[got.series == name]["mid"]) == brute.spaced(list(ps), list(hs), 20), name


def test_long_chains_settle_and_are_written_once(spark, monkeypatch):
    """Each peak of a chain waits for the next one; the last one decides all the others."""
    count, step, distance = 200_000, 7, 20
    sizes = []
    monkeypatch.setattr(extrema, "measured", lambda df, *a, **k: (lambda got: sizes.append(got[1]["rows"]) or got)(measured(df, *a, **k)))
    rising = spark.range(count).select(
        F.lit("up").alias("series"), F.lit("max").alias("kind"), (F.col("id") * step).alias("mid"), F.col("id").cast("double").alias("height"))
    both = rising.unionByName(rising.withColumns({"series": F.lit("down"), "height": -F.col("height")})).withColumns(
        {"us": F.lit(0).cast("bigint"), "ord": F.lit(0).cast("bigint")})
    got = extrema.min_distance(both, distance).toPandas()
    skip = -(-distance // step)
    assert sorted(got[got.series == "up"]["mid"]) == [step * k for k in range((count - 1) % skip, count, skip)]
    assert sorted(got[got.series == "down"]["mid"]) == [step * k for k in range(0, count, skip)]
    # The first round settles little, later ones only what is left, in a few rounds.
    assert sizes[0] == 2 * count and len(sizes) <= 5 and all(b <= a for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("copies,dense", [(False, False), (True, False), (True, True)])
def test_analysis_is_brute_force(spark, monkeypatch, copies, dense):
    """``dense`` makes chunks as short as the windows allow and equal rows collapse."""
    if dense:
        monkeypatch.setattr(medians, "TARGET_CHUNK_ROWS", 1)
        for module in (chunks, extrema, segments):
            monkeypatch.setattr(module, "CHUNK_ROWS", 64)
    rng = np.random.default_rng(6)
    series = {
        "a": level_signal(rng, 2500, copies), "b": level_signal(rng, 1500, copies, spikes=False),
        "few": level_signal(rng, 99), "flat": (level_signal(rng, 200)[0], np.full(200, 7.0)),
    }
    found = analysis.analyze_segments(messages(spark, series))
    got, points = found.segments.toPandas(), found.extrema.toPandas()
    forecast = {r.series: r for r in found.prediction.collect()}
    assert sorted(r.series for r in found.series.collect()) == ["a", "b", "flat"]
    total = 0
    for name in ("a", "b", "flat"):
        smooth, low, top, want = brute.analyze(*series[name])
        for kind, index in (("min", low), ("max", top)):
            mine = points[(points.series == name) & (points.kind == kind)].sort_values("index")
            assert mine["index"].tolist() == index
            assert mine.timestamp.tolist() == smooth.index[index].tolist()
        mine = got[got.series == name].drop(columns="series")
        assert len(mine) == len(want)
        if len(want):
            order = ["is_current", "begin_index"]
            pd.testing.assert_frame_equal(
                mine.sort_values(order).reset_index(drop=True)[list(want.columns)],
                want.sort_values(order).reset_index(drop=True), check_dtype=False, rtol=1e-9)
            last = want[want.is_current]
            if len(last) and last.end_distance_mm.iloc[0] < 50:
                hours = (50 - last.end_distance_mm.iloc[0]) / last.slope_mm_per_hr.iloc[0]
                assert forecast[name].time_to_50mm_hours == pytest.approx(hours)
                due = last.end_time.iloc[0] + pd.Timedelta(hours=hours)
                assert abs(pd.Timestamp(forecast[name].predicted_refill_time) - due) < pd.Timedelta("1s")
        total += len(want)
    assert total > 5


@pytest.mark.parametrize("collapsed", [False, True])
def test_hot_instant_and_nan(spark, monkeypatch, collapsed):
    """A third of the rows at one moment, and NaN payloads."""
    rng = np.random.default_rng(7)
    ts, v = level_signal(rng, 600)
    ts = ts.append(pd.DatetimeIndex([ts[300]] * 300))
    v = np.append(v, np.full(300, 15.0))
    order = np.argsort(ts, kind="stable")
    ts, v = ts[order], v[order]
    text = [str(x) for x in v]
    text[10] = "nan"
    frame = messages(spark, {"a": (ts, text)})
    if collapsed:
        monkeypatch.setattr(medians, "TARGET_CHUNK_ROWS", 100)
    values, density = medians.prepare_values(medians.series_values(frame), 300_000_000)
    assert (values.agg(F.max("n")).first()[0] >= 300) is collapsed
    assert density.counts.first().rows == 900 and (density.densest < 100) is collapsed
    smooth = analysis.smooth_from_messages(frame)
    v = v.copy()
    v[10] = np.nan
    want, *_ = brute.analyze(ts, v)
    got = smooth.orderBy("pos").toPandas()
    assert np.repeat(got.smooth.values, got.until - got.pos + 1).tolist() == want.tolist()


def test_two_minima_share_a_maximum(spark):
    rows = [("s", "min", 5), ("s", "min", 9), ("s", "max", 20), ("s", "min", 30), ("s", "max", 31), ("s", "min", 40)]
    frame = spark.createDataFrame([(*r, r[2], r[2], 0.0) for r in rows],
                                  "series STRING, kind STRING, mid BIGINT, ord BIGINT, us BIGINT, value DOUBLE")
    got = sorted((r.begin.mid, r.end.mid) for r in segments.next_max(frame).collect())
    assert got == [(5, 20), (9, 20), (30, 31)]


def test_forecast_limits(spark):
    rows = spark.createDataFrame(
        [("a", 48.0, 1.0, True), ("b", 51.0, 1.0, True), ("c", 48.0, 1.0, False)],
        "series STRING, end_distance_mm DOUBLE, slope_mm_per_hr DOUBLE, is_current BOOLEAN"
    ).withColumn("end_time", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"))
    got = segments.refill_prediction(rows).collect()
    assert [(r.series, r.time_to_50mm_hours, str(r.predicted_refill_time)) for r in got] == [
        ("a", 2.0, "2024-01-01 02:00:00")]


def spans_of(spark, pairs, values):
    point = "STRUCT<mid: BIGINT, ord: BIGINT, us: BIGINT, value: DOUBLE>"
    return spark.createDataFrame(
        [(name, (a, a, a * 60_000_000, float(values[name][a])), (b, b, b * 60_000_000, float(values[name][b])), b - a + 1, k, False)
         for k, (name, a, b) in enumerate(pairs)],
        f"series STRING, begin {point}, end {point}, n_points BIGINT, id BIGINT, is_current BOOLEAN")


@pytest.mark.parametrize("chunk,bin_rows,block", [(50, 8, 128), (7, 64, 64), (10_000, 64, 4_096), (1_000, 1, 1)])
def test_slopes_from_moments(spark, monkeypatch, chunk, bin_rows, block):
    """Any begin and end, in bins and blocks that end with chunks or not, far from the series' start."""
    monkeypatch.setattr(extrema, "BIN_ROWS", bin_rows)
    monkeypatch.setattr(segments, "MOMENT_ROWS", block)
    rng = np.random.default_rng(12)
    values = {"a": np.cumsum(rng.normal(0, 1, 6_000)) + 1e6, "b": rng.normal(0, 1, 300)}
    pairs = [("a", 0, 5_999), ("a", 0, 1), ("a", 5_998, 5_999), ("a", 63, 64), ("a", 64, 128), ("b", 0, 299), ("b", 7, 12)]
    starts = {("a", 0), ("a", 5_998), ("a", 63), ("a", 64), ("b", 0), ("b", 7)}
    for begin in rng.choice(5_900, 40, replace=False).tolist():
        if ("a", begin) not in starts:
            pairs.append(("a", begin, int(rng.integers(begin + 1, 6_000))))
    pairs = list({(name, a): (name, a, b) for name, a, b in pairs}.values())
    got = segments.span_slopes(smooth_frame(spark, values, chunk), spans_of(spark, pairs, values)).collect()
    assert len(got) == len(pairs)
    for row in got:
        a, b = row.begin_ord, row.end_ord
        want = brute.slope(np.arange(b - a + 1) / 60, values[row.series][a:b + 1] - values[row.series][a])
        assert row.slope_mm_per_hr == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_a_span_reads_its_ends_only(spark):
    """Rows and bins that a span is joined with stay the same while it grows."""
    values = {"a": np.arange(40_000) % 977 / 10}
    smooth = smooth_frame(spark, values, 10_000)
    bins = smooth.where("bin_rows IS NOT NULL").select(
        F.col("series").alias("bin_series"), "bin", (F.col("bin") + F.col("bin_rows") - 1).alias("last"),
        F.expr(f"bin div {segments.MOMENT_ROWS}").alias("block"))
    bound = 4 * segments.MOMENT_ROWS // extrema.BIN_ROWS + 8
    for length in (9_000, 39_000):
        spans = spans_of(spark, [("a", 500, 500 + length)], values).select(
            "series", F.col("begin.ord").alias("begin_ord"), F.col("end.ord").alias("end_ord"))
        met = segments.edge_bins(bins, spans).toPandas()
        assert len(met) <= bound and (~met.inside).sum() == 2


def test_groups_wait_for_their_own_rows_only(monkeypatch):
    monkeypatch.setattr(chunks, "BATCH_ROWS", 100, raising=False)
    sizes = [10] * 30 + [1000] + [10] * 200 + [60, 1, 149]
    keys = np.repeat(np.arange(len(sizes)), sizes)
    table = pa.table({"g": keys, "x": np.arange(len(keys))})
    calls = []

    def compute(part, first):
        calls.append(part.num_rows)
        found = part.column("g").to_numpy()
        assert first.tolist() == [True, *(found[1:] != found[:-1])]
        return part

    out = list(chunks.over_groups(compute, ("g",))(iter(table.to_batches(max_chunksize=50))))
    assert pa.Table.from_batches(out).equals(table.combine_chunks())
    # A call has the rows asked for and a batch, or the largest group and at most what stood before and behind it.
    assert sorted(calls)[-1] <= 1000 + 100 + 50 and sorted(calls)[-2] <= 150


def test_chunks_of_dense_series_are_short(spark):
    us = F.col("id") * 200_000
    values = spark.range(300_000).select(
        F.lit("a").alias("series"), us.alias("us"), F.lit(1.0).alias("value"), F.lit(1).cast("bigint").alias("n"))
    density = medians.series_density(values, 300_000_000)
    rows = values.groupBy(chunks.floor_div(F.col("us"), density.chunk_us)).count().agg(F.max("count")).first()[0]
    assert 50_000 < rows <= 100_000


@pytest.fixture(scope="module")
def shared_times(tmp_path_factory):
    """Events of which several come at one moment, and one moment that holds hundreds."""
    rng = np.random.default_rng(11)
    frames = []
    for number, name in enumerate(("a", "b")):
        ts, values = level_signal(rng, 1_500, copies=True)
        ts, values = ts.append(pd.DatetimeIndex([ts[700]] * 300)), np.append(values, np.full(300, values[700]))
        frames.append(pd.DataFrame({
            "event_id": np.arange(len(ts)) * 2 + number, "ts": ts.astype("datetime64[us]"), "user_id": 7, "event_type": name,
            "value": values, "props": "{}"}))
    folder = tmp_path_factory.mktemp("events")
    pd.concat(frames).astype({"user_id": "int64"}).to_parquet(folder / "events.parquet", index=False)
    return str(folder)


@pytest.mark.parametrize("name", ["row_index", "segment_points"])
def test_samples_at_one_moment_all_come(spark, monkeypatch, shared_times, name):
    for module in (chunks, extrema, segments):
        monkeypatch.setattr(module, "CHUNK_ROWS", 64)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{shared_times}/events.parquet'")
    assert db.execute(f"SELECT count(*) - count(DISTINCT (series, timestamp)) FROM ({ORACLES[name]})").fetchone()[0] > 300
    assert compare.differences(QUERIES[name](spark, shared_times), db, ORACLES[name]) == ""
