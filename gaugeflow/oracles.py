"""Independent SQL for the registered queries, in the dialect of the checking engine (DuckDB)."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# -- shared relations --------------------------------------------------------------------------------

MESSAGES = """messages AS (
  SELECT event_id AS id, ts AS timestamp, 'events/' || event_type || '/raw' AS topic, value,
         CAST(user_id % 3 AS INTEGER) AS qos, false AS retain
  FROM events)"""

# As messages, with NULL values where a payload is missing.
GAPPY = """gappy AS (
  SELECT event_id AS id, ts AS timestamp, 'events/' || event_type || '/raw' AS topic,
         CASE WHEN user_id % 3 <> 1 THEN value END AS value
  FROM events)"""

READINGS = """readings AS (
  SELECT event_id AS id, ts AS timestamp, CAST(user_id AS VARCHAR) AS device_id,
         CASE WHEN user_id % 2 = 0 THEN 'air' ELSE 'water' END AS device_type, value AS temperature,
         CASE WHEN user_id % 2 = 0
              THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS humidity,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS battery,
         -CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS signal
  FROM events)"""

REPORTS = """reports AS (
  SELECT r.id, r.timestamp, 'yolink/' || r.device_type || '/' || r.device_id AS topic, r.device_id,
         r.device_type, round(r.temperature, 6) AS temperature, round(r.humidity, 6) AS humidity,
         r.battery, CASE WHEN e.user_id % 5 <> 0 THEN r.signal END AS signal
  FROM readings r JOIN events e ON e.event_id = r.id
  WHERE e.event_type NOT IN ('signup', 'error') AND e.user_id % 7 <> 0)"""

PLAIN = "id, timestamp, topic, qos, retain, round(value, 6) AS value"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def levels(source: str, minutes: int, where: str = "true", more: str = "") -> str:
    return f"""SELECT topic AS series, time_bucket(INTERVAL {minutes} MINUTE, timestamp) AS t,
  round(avg(value), 6) AS m, round(stddev_pop(value), 6) AS s, count(*) AS n,
  round(min(value), 6) AS "min", round(max(value), 6) AS "max"{more}
FROM {source} WHERE value IS NOT NULL AND {where} GROUP BY topic, t"""


def recent(source: str, interval: str) -> str:
    return f"""timestamp >= (SELECT max(b.timestamp) FROM {source} b
  WHERE b.topic = {source}.topic) - INTERVAL {interval}"""


SENSOR_COLUMNS = ", ".join(
    f"round({f}({c}), 6) AS {b}_{n}"
    for b, c in (("temp", "temperature"), ("humidity", "humidity"))
    for n, f in (("m", "avg"), ("s", "stddev_pop"), ("min", "min"), ("max", "max")))


def sensors(minutes: int, where: str = "true") -> str:
    return f"""SELECT device_type, time_bucket(INTERVAL {minutes} MINUTE, timestamp) AS t, count(*) AS n,
  {SENSOR_COLUMNS}
FROM readings WHERE temperature IS NOT NULL AND {where} GROUP BY device_type, t"""


READING_LATEST = "(SELECT max(timestamp) FROM readings)"

# -- scans, sources, sinks ---------------------------------------------------------------------------

ORACLES["scan_messages"] = _with(MESSAGES) + f"SELECT {PLAIN} FROM messages"
ORACLES["restore_archive"] = ORACLES["scan_messages"]
ORACLES["scan_readings"] = _with(READINGS) + """SELECT id, timestamp,
  'yolink/' || device_type || '/' || device_id AS topic, device_id, device_type,
  round(temperature, 6) AS temperature, round(humidity, 6) AS humidity, battery, signal FROM readings"""

_TABLE = """CASE topic WHEN 'events/click/raw' THEN 'clicks' WHEN 'events/signup/raw' THEN 'signups'
  WHEN 'events/view/raw' THEN 'views' WHEN 'events/purchase/raw' THEN 'purchases' END"""
_ROUTED = f"routed AS (SELECT *, {_TABLE} AS table_name FROM messages)"

ORACLES["ingest_messages"] = _with(MESSAGES, _ROUTED) + f"""SELECT {PLAIN}, table_name,
  CAST(timestamp AS DATE) AS date FROM routed WHERE table_name IS NOT NULL"""
ORACLES["flush_routed"] = _with(MESSAGES, _ROUTED) + """SELECT table_name, CAST(timestamp AS DATE) AS date,
  count(*) AS n, min(timestamp) AS first_message, max(timestamp) AS last_message
FROM routed WHERE table_name IS NOT NULL GROUP BY ALL"""
ORACLES["route_topic"] = _with(MESSAGES, _ROUTED) + """SELECT id, topic, table_name FROM routed
WHERE table_name IS NOT NULL"""
ORACLES["join_pattern"] = ORACLES["route_topic"]
ORACLES["ingest_readings"] = _with(READINGS, REPORTS) + "SELECT * FROM reports"

_BODY = """CASE WHEN event_type = 'error' THEN '{"event": ' || user_id ELSE
  '{"event":"' || CASE WHEN event_type = 'signup' THEN 'THSensor.Alert' ELSE 'THSensor.Report' END
  || '","deviceId":"' || user_id || '","data":{"temperature":' || CAST(value AS VARCHAR)
  || ',"humidity":' || regexp_extract(props, '([0-9]+)', 1) || '.0,"battery":'
  || regexp_extract(props, '([0-9]+)', 1)
  || CASE WHEN user_id % 5 <> 0
          THEN ',"loraInfo":{"signal":' || -CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) || '}'
          ELSE '' END || '}}' END"""

ORACLES["relay_topic"] = f"""SELECT 'yolink/' || user_id || '/report' AS topic, count(*) AS n,
  CAST(sum(length({_BODY})) AS BIGINT) AS bytes FROM events GROUP BY user_id"""
ORACLES["keep_raw"] = f"""SELECT event_id AS id, {_BODY} AS raw_json FROM events
WHERE event_type NOT IN ('signup', 'error') AND user_id % 7 <> 0"""
ORACLES["parse_report"] = ORACLES["ingest_readings"]
ORACLES["parse_report_rejected"] = f"""SELECT event_id AS id, ts AS timestamp,
  'yl-home/h1/' || user_id || '/report' AS topic, {_BODY} AS payload FROM events WHERE event_type = 'error'"""
ORACLES["ingest_reports"] = f"""SELECT 'reading' AS part, id, timestamp, topic FROM ({ORACLES["ingest_readings"]})
UNION ALL SELECT 'rejected', id, timestamp, topic FROM ({ORACLES["parse_report_rejected"]})"""
ORACLES["event_filter"] = """SELECT event_id AS id, 'THSensor.Report' AS event FROM events
WHERE event_type NOT IN ('signup', 'error')"""

_RESOLUTIONS = (("agg_1m", 1, "1 HOUR"), ("agg_5m", 5, "24 HOUR"), ("agg_1h", 60, None))


def _multires(source: str = "gappy") -> str:
    return " UNION ALL ".join(
        f"({levels(source, m, recent(source, h) if h else 'true', f', {chr(39)}{name}{chr(39)} AS resolution')})"
        for name, m, h in _RESOLUTIONS)


ORACLES["multires"] = _with(GAPPY) + _multires()
def shown(value: str, digits: int) -> str:
    """Rounded as documents show it: by the exact binary value, half to even."""
    return f"CAST(printf('%.{digits}f', {value}) AS DOUBLE)"


_RAW_LEVELS = """topic AS series, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi"""
ORACLES["snapshot_batch_levels"] = _with(GAPPY, "parts AS (" + " UNION ALL ".join(
    f"""(SELECT '{name}' AS resolution, time_bucket(INTERVAL {m} MINUTE, timestamp) AS t, {_RAW_LEVELS} FROM gappy
    WHERE value IS NOT NULL AND {recent('gappy', h) if h else 'true'} GROUP BY topic, t)"""
    for name, m, h in _RESOLUTIONS) + ")") + f"""SELECT series, resolution, strftime(t, '%Y-%m-%dT%H:%M:%S') AS t, n,
  {shown('m', 2)} AS m, {shown('s', 3)} AS s, {shown('lo', 2)} AS "min", {shown('hi', 2)} AS "max" FROM parts"""
_RAW_SENSORS = ", ".join(f"{f}({c}) AS {b}_{n}" for b, c in (("temp", "temperature"), ("humidity", "humidity"))
                         for n, f in (("m", "avg"), ("s", "stddev_pop"), ("min", "min"), ("max", "max")))
ORACLES["snapshot_batch_sensors"] = _with(READINGS, "parts AS (" + " UNION ALL ".join(
    f"""(SELECT '{name}' AS resolution, device_type, time_bucket(INTERVAL {m} MINUTE, timestamp) AS t,
      count(temperature) AS n, {_RAW_SENSORS} FROM readings WHERE temperature IS NOT NULL AND {
        f'timestamp >= {READING_LATEST} - INTERVAL {h}' if h else 'true'} GROUP BY device_type, t)"""
    for name, m, h in _RESOLUTIONS) + ")") + "SELECT resolution, device_type, strftime(t, '%Y-%m-%dT%H:%M:%S') AS t, n, " + (
    ", ".join(f"{shown(f'{b}_{c}', 3 if c == 's' else 2)} AS {b}_{c}" for b in ("temp", "humidity")
              for c in ("m", "s", "min", "max"))) + " FROM parts"
ORACLES["snapshot_source"] = _with(GAPPY) + f"""SELECT topic AS series,
  CASE WHEN date_trunc('second', timestamp) = timestamp THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp,
  round(value, 6) AS water_level_mm FROM gappy WHERE {recent('gappy', '360 MINUTE')}"""
ORACLES["snapshot_sink"] = """SELECT DISTINCT 'events/' || event_type || '/raw' AS series,
  CAST(1 AS BIGINT) AS documents, CAST(1 AS BIGINT) AS files FROM events"""
ORACLES["archive_month"] = """SELECT 'archive' AS part, count(*) AS n, max(ts) AS last FROM events
UNION ALL SELECT 'live', 0, NULL"""
ORACLES["list_archives"] = """SELECT '2024-01' AS archive_month, count(*) > 0 AS has_bytes FROM events"""

# -- projections, filters, predicates ----------------------------------------------------------------

ORACLES["query_messages"] = _with(MESSAGES) + f"""SELECT {PLAIN} FROM messages
WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-09 12:00:00'
  AND topic LIKE 'events/_i%'"""
ORACLES["top_recent"] = _with(MESSAGES) + f"""SELECT {PLAIN} FROM messages
ORDER BY timestamp DESC, id DESC LIMIT 50"""
ORACLES["last_500"] = _with(MESSAGES) + f"""SELECT {PLAIN} FROM messages
ORDER BY timestamp DESC, id DESC LIMIT 500"""
ORACLES["last_500_by_topic"] = _with(MESSAGES) + f"""SELECT {PLAIN} FROM messages
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY timestamp DESC, id DESC) <= 500"""
ORACLES["decode_payload"] = """SELECT event_id, CASE WHEN user_id % 2 = 0
  THEN 'ff' || format('{:08x}', event_id) ELSE props END AS text FROM events"""
ORACLES["cast_value"] = """SELECT event_id AS id, round(value, 6) AS value, TRY_CAST(props AS DOUBLE) AS bad
FROM events"""
ORACLES["topic_eq"] = _with(GAPPY) + """SELECT id, timestamp, topic FROM gappy
WHERE topic = 'events/click/raw' AND value IS NOT NULL"""
ORACLES["lookback"] = _with(GAPPY) + f"""SELECT id, timestamp, topic FROM gappy
WHERE {recent('gappy', '24 HOUR')}"""
ORACLES["lookback_scope"] = _with(READINGS) + f"""SELECT id, timestamp, device_type FROM readings
WHERE timestamp >= {READING_LATEST} - INTERVAL 24 HOUR"""
ORACLES["join_latest"] = """WITH rows AS (SELECT event_id AS id, ts AS timestamp FROM events
  WHERE event_type = 'view'), latest AS (SELECT max(timestamp) AS top FROM rows)
SELECT id, timestamp FROM rows, latest WHERE timestamp >= top - INTERVAL 6 HOUR"""
ORACLES["recent_raw"] = _with(GAPPY) + f"""SELECT topic AS series, timestamp, id,
  round(value, 6) AS water_level_mm FROM gappy WHERE {recent('gappy', '360 MINUTE')}"""
ORACLES["topic_fields"] = """SELECT event_id AS id,
  CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'unknown' END AS device_id FROM events"""
ORACLES["relay_topic_expr"] = """SELECT event_id AS id, 'yolink/' || CASE WHEN user_id % 2 = 0
  THEN user_id || '/report' ELSE 'events/' || event_type || '/raw' END AS topic FROM events"""
ORACLES["join_device"] = _with(READINGS) + """SELECT r.id, r.device_id, r.device_type FROM readings r
JOIN events e ON e.event_id = r.id WHERE e.user_id % 7 <> 0"""
ORACLES["mask_humidity"] = _with(READINGS) + """SELECT id, device_type,
  CAST(humidity AS INTEGER) AS humidity FROM readings"""
ORACLES["synthetic_topic"] = _with(READINGS) + """SELECT id,
  'yolink/' || device_type || '/' || device_id AS topic FROM readings"""
ORACLES["conform_schema"] = _with(MESSAGES) + """SELECT id, timestamp, topic, CAST(NULL AS VARCHAR) AS payload,
  CAST(NULL AS INTEGER) AS qos, retain FROM messages"""
ORACLES["season_flag"] = """SELECT event_id,
  CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AS in_season FROM events"""
ORACLES["replay_visible"] = _with(MESSAGES) + """SELECT id, timestamp FROM messages
WHERE TIMESTAMP '2024-01-20 12:00:00' - timestamp >= INTERVAL 300 SECOND"""
ORACLES["level_health"] = """SELECT event_id, CASE WHEN value > 50 THEN 'needs water'
  WHEN value >= 40 THEN 'warning' ELSE 'good' END AS health FROM events"""
ORACLES["unit_conversions"] = """SELECT event_id, round(-25.125::DOUBLE * value, 6) AS ml,
  round(value, 6) AS mm, round(value * 9 / 5 + 32, 6) AS fahrenheit FROM events"""
ORACLES["time_functions"] = """SELECT event_id, time_bucket(INTERVAL 7 MINUTE, ts) AS bucket_7m,
  CAST(time_bucket(INTERVAL 7 DAY, ts) AS TIMESTAMP) AS bucket_week,
  CASE WHEN date_trunc('second', ts) = ts THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso,
  strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S') AS iso_minute,
  strftime(ts, '%Y-%m') AS month,
  printf('%02d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) AS countdown
FROM (SELECT *, greatest(0, CAST(floor(
  (epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) / 1000000.0) AS BIGINT)) AS s FROM events)"""
ORACLES["round_decimal"] = "SELECT event_id, round(value, 2) AS up, round(value, 2) AS down FROM events"

# -- joins, merges -----------------------------------------------------------------------------------

_MERGE = """olds AS (SELECT * FROM messages UNION ALL SELECT * FROM messages),
moved AS (SELECT id, CASE WHEN topic IN ('events/view/raw', 'events/error/raw')
    THEN timestamp + INTERVAL 1 SECOND ELSE timestamp END AS timestamp, topic, value, qos, retain
  FROM messages),
news AS (SELECT * FROM moved UNION ALL SELECT * FROM moved),
fresh AS (SELECT * FROM news n WHERE NOT EXISTS (
    SELECT 1 FROM messages o WHERE o.timestamp = n.timestamp AND o.topic = n.topic)),
added AS (SELECT * FROM fresh
  QUALIFY row_number() OVER (PARTITION BY timestamp, topic ORDER BY id) = 1)"""

ORACLES["merge_dedup"] = _with(MESSAGES, _MERGE) + """SELECT timestamp, topic, qos, retain,
  round(value, 6) AS value FROM (SELECT * FROM olds UNION ALL SELECT * FROM added)"""
ORACLES["union_merge"] = _with(MESSAGES, _MERGE) + f"SELECT {PLAIN} FROM added"
ORACLES["merge_counts"] = _with(MESSAGES, _MERGE) + """SELECT (SELECT count(*) FROM olds) AS old_count,
  (SELECT count(*) FROM news) AS new_count,
  (SELECT count(*) FROM olds) + (SELECT count(*) FROM added) AS merged_count"""
ORACLES["merge_tables"] = _with(MESSAGES, _MERGE, """merged AS (
  SELECT 'water_level' AS table_name, timestamp FROM olds
  UNION ALL SELECT 'water_level', timestamp FROM added
  UNION ALL SELECT 'extra', timestamp FROM (SELECT DISTINCT timestamp, topic FROM news)
  UNION ALL SELECT 'yolink_sensors', ts FROM events)""") + """SELECT table_name, count(*) AS records,
  min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM merged GROUP BY table_name"""
ORACLES["merge_report"] = """SELECT table_name, count(*) AS records, min(ts) AS first_timestamp,
  max(ts) AS last_timestamp FROM events, (VALUES ('messages'), ('readings')) v(table_name) GROUP BY table_name"""
ORACLES["new_measurements"] = _with(MESSAGES, _MERGE) + "SELECT id, topic, timestamp FROM fresh"

# -- aggregations ------------------------------------------------------------------------------------

ORACLES["level_buckets"] = _with(GAPPY) + levels("gappy", 60)
ORACLES["level_buckets_24h"] = _with(GAPPY) + levels("gappy", 5, recent("gappy", "24 HOUR"))
ORACLES["bucket_origin"] = _with(MESSAGES) + levels("messages", 7)
ORACLES["level_buckets_topic"] = _with(GAPPY) + levels(
    "gappy", 60, f"topic = 'events/view/raw' AND {recent('gappy', '240 HOUR')}")
ORACLES["sensor_buckets"] = _with(READINGS) + sensors(60)
ORACLES["sensor_buckets_24h"] = _with(READINGS) + sensors(
    5, f"timestamp >= {READING_LATEST} - INTERVAL 24 HOUR")
ORACLES["measurement_stats"] = _with(GAPPY) + f"""SELECT topic AS series, round(min(value), 6) AS min_level,
  round(max(value), 6) AS max_level, round(avg(value), 6) AS avg_level,
  round(stddev_pop(value), 6) AS stddev, count(value) AS measurement_count
FROM gappy WHERE value IS NOT NULL AND {recent('gappy', '4320 MINUTE')} GROUP BY topic"""
_STATS = """count(*) AS count, min(timestamp) AS first_message, max(timestamp) AS last_message,
  count(DISTINCT topic) AS unique_topics"""
ORACLES["table_stats"] = _with(MESSAGES) + f"SELECT {_STATS} FROM messages"
ORACLES["table_stats_by_key"] = _with(READINGS) + f"""SELECT device_type, {_STATS} FROM (
  SELECT *, 'yolink/' || device_type || '/' || device_id AS topic FROM readings) GROUP BY device_type"""
ORACLES["frequency_hz"] = _with(MESSAGES) + f"""SELECT topic AS series, round(CASE WHEN count(*) >= 2
  AND max(timestamp) > min(timestamp)
  THEN count(*) / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6) ELSE 0 END, 6) AS hz
FROM messages WHERE {recent('messages', '7200 SECOND')} GROUP BY topic"""
_SENSOR_PARTS = " UNION ALL ".join(
    f"""SELECT {rank} AS rank, * FROM ({sensors(
        m, f'timestamp >= {READING_LATEST} - INTERVAL {h}' if h else 'true')})"""
    for rank, (_, m, h) in enumerate(_RESOLUTIONS))
ORACLES["latest_reading"] = _with(READINGS, f"parts AS ({_SENSOR_PARTS})") + """SELECT rank, device_type, t,
  temp_m, humidity_m, n FROM parts WHERE rank = (SELECT min(rank) FROM parts)
QUALIFY row_number() OVER (PARTITION BY device_type ORDER BY t DESC) = 1"""
ORACLES["current_level"] = _with(MESSAGES) + """SELECT topic AS series, timestamp,
  round(value, 6) AS water_level_mm FROM messages
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY timestamp DESC, id DESC) = 1"""

# -- time series -------------------------------------------------------------------------------------


def rolling(half: int, source: str) -> str:
    return f"""median(value) OVER (PARTITION BY topic ORDER BY timestamp
    RANGE BETWEEN INTERVAL '{half - 1}.999999 seconds' PRECEDING
          AND INTERVAL '{half} seconds' FOLLOWING) FROM {source}"""


RESIDUALS = f"""local AS (SELECT id, topic, timestamp, value, {rolling(150, 'messages').replace(
    ' FROM', ' AS local_median FROM')}),
residuals AS (SELECT *, value - local_median AS residual FROM local),
scales AS (SELECT topic, CASE WHEN median(abs(residual - centre)) = 0 THEN stddev_pop(residual)
    ELSE median(abs(residual - centre)) END AS scale
  FROM (SELECT *, median(residual) OVER (PARTITION BY topic) AS centre FROM residuals) GROUP BY topic)"""

SMOOTH = f"""clean AS (SELECT r.id, topic, timestamp, value FROM residuals r JOIN scales USING (topic)
  WHERE abs(residual) <= 6.0 * scale),
smoothed AS (SELECT id, topic, timestamp, {rolling(300, 'clean').replace(' FROM', ' AS v FROM')}),
sized AS (SELECT *, count(*) OVER (PARTITION BY topic) AS total FROM smoothed),
smooth AS (SELECT topic AS series, timestamp, v,
    row_number() OVER (PARTITION BY topic ORDER BY timestamp, id) - 1 AS i FROM sized
  WHERE total >= 50)"""

POINTS = """marked AS (SELECT *, lag(v) OVER w AS before FROM smooth WINDOW w AS (PARTITION BY series ORDER BY i)),
runs AS (SELECT series, i, v, before, lead(v) OVER w AS after, lead(i) OVER w AS after_i
  FROM marked WHERE before IS NULL OR before <> v WINDOW w AS (PARTITION BY series ORDER BY i)),
points AS (SELECT series, CASE WHEN v > before THEN 'max' ELSE 'min' END AS kind,
    (i + after_i - 1) // 2 AS i, v FROM runs
  WHERE (v > before AND v > after) OR (v < before AND v < after))"""

# Greedy choice by height: the peaks of a series are visited from the highest down, and one is
# taken if no taken one is closer than 20 samples.
SPACED = """ranked AS (SELECT series, kind, i, v, row_number() OVER (PARTITION BY series, kind
    ORDER BY CASE WHEN kind = 'max' THEN v ELSE -v END DESC, i DESC) AS r FROM points),
chosen AS (
  SELECT series, kind, r, [i] AS taken FROM ranked WHERE r = 1
  UNION ALL
  SELECT p.series, p.kind, p.r, CASE WHEN len(list_filter(c.taken, lambda k: abs(k - p.i) < 20)) = 0
      THEN list_append(c.taken, p.i) ELSE c.taken END
  FROM chosen c JOIN ranked p ON p.series = c.series AND p.kind = c.kind AND p.r = c.r + 1),
spaced AS (SELECT series, kind, unnest(taken) AS i FROM chosen
  QUALIFY r = max(r) OVER (PARTITION BY series, kind))"""

# Signed copies make minima the maxima of the negated series.
PROMINENT = """signed AS (SELECT series, i, v, 'max' AS kind FROM smooth
  UNION ALL SELECT series, i, -v, 'min' FROM smooth),
heights AS (SELECT series, kind, i, CASE WHEN kind = 'max' THEN v ELSE -v END AS h FROM points),
walls AS (SELECT p.series, p.kind, p.i, p.h,
    coalesce((SELECT max(s.i) FROM signed s WHERE s.series = p.series AND s.kind = p.kind
              AND s.i < p.i AND s.v > p.h), -1) AS lo,
    coalesce((SELECT min(s.i) FROM signed s WHERE s.series = p.series AND s.kind = p.kind
              AND s.i > p.i AND s.v > p.h), 9000000000) AS hi
  FROM heights p),
prominent AS (SELECT w.series, w.kind, w.i, w.h, w.h - greatest(
    min(CASE WHEN s.i <= w.i THEN s.v END), min(CASE WHEN s.i >= w.i THEN s.v END)) AS prominence
  FROM walls w JOIN signed s ON s.series = w.series AND s.kind = w.kind AND s.i > w.lo AND s.i < w.hi
  GROUP BY w.series, w.kind, w.i, w.h)"""

EXTREMA = """extrema AS (SELECT p.series, p.kind, p.i, s.timestamp, s.v
  FROM prominent p JOIN spaced USING (series, kind, i)
  JOIN smooth s ON s.series = p.series AND s.i = p.i WHERE p.prominence >= 5.0)"""

SPANS = """pairs AS (SELECT a.series, a.i AS a, (SELECT min(b.i) FROM extrema b
    WHERE b.series = a.series AND b.kind = 'max' AND b.i > a.i) AS b
  FROM extrema a WHERE a.kind = 'min'),
done AS (SELECT p.series, p.a, p.b, row_number() OVER (PARTITION BY p.series ORDER BY p.a) AS id
  FROM pairs p JOIN smooth x ON x.series = p.series AND x.i = p.a
  JOIN smooth y ON y.series = p.series AND y.i = p.b
  WHERE p.b - p.a + 1 >= 20 AND y.timestamp - x.timestamp >= INTERVAL 3 HOUR),
ends AS (SELECT e.series, max(e.i) AS a, (SELECT max(s.i) FROM smooth s WHERE s.series = e.series) AS b
  FROM extrema e WHERE e.kind = 'min' GROUP BY e.series),
current AS (SELECT e.series, e.a, e.b FROM ends e
  JOIN smooth x ON x.series = e.series AND x.i = e.a JOIN smooth y ON y.series = e.series AND y.i = e.b
  WHERE e.b - e.a + 1 >= 20 AND y.timestamp - x.timestamp >= INTERVAL 1 HOUR),
spans AS (SELECT series, a, b, id, false AS is_current FROM done
  UNION ALL SELECT series, a, b, NULL, true FROM current)"""

SEGMENTS = """slopes AS (SELECT p.series, p.a, p.b, p.id, p.is_current,
    regr_slope(s.v, (epoch_us(s.timestamp) - epoch_us(x.timestamp)) / 3600000000.0) AS slope
  FROM spans p JOIN smooth s ON s.series = p.series AND s.i BETWEEN p.a AND p.b
  JOIN smooth x ON x.series = p.series AND x.i = p.a GROUP BY ALL),
segments AS (SELECT k.series, CAST(coalesce(k.id, 1 + count(*) FILTER (NOT k.is_current)
      OVER (PARTITION BY k.series)) AS BIGINT) AS id,
    x.timestamp AS start_time, y.timestamp AS end_time, round(x.v, 6) AS start_distance_mm,
    round(y.v, 6) AS end_distance_mm, round(k.slope, 6) AS slope_mm_per_hr,
    round((epoch_us(y.timestamp) - epoch_us(x.timestamp)) / 3600000000.0, 6) AS duration_hours,
    CAST(k.b - k.a + 1 AS BIGINT) AS n_points, k.is_current, k.a AS begin_index, k.slope AS exact_slope
  FROM slopes k JOIN smooth x ON x.series = k.series AND x.i = k.a
  JOIN smooth y ON y.series = k.series AND y.i = k.b WHERE k.slope > 0)"""

_TO_SMOOTH = (MESSAGES, RESIDUALS, SMOOTH)
_TO_POINTS = (*_TO_SMOOTH, POINTS)
_TO_EXTREMA = (*_TO_POINTS, SPACED, PROMINENT, EXTREMA)
_TO_SEGMENTS = (*_TO_EXTREMA, SPANS, SEGMENTS)


def _segment_sql(*more: str) -> str:
    return _with(*_TO_SEGMENTS, *more, recursive=True)


for _name, _half in (("rolling_median", 150), ("rolling_median_10m", 300)):
    ORACLES[_name] = _with(MESSAGES) + f"""SELECT id, topic AS series, timestamp, round(value, 6) AS value,
  round(local_median, 6) AS local_median FROM (SELECT id, topic, timestamp, value, {rolling(
      _half, 'messages').replace(' FROM', ' AS local_median FROM')})"""
ORACLES["mad_scale"] = _with(MESSAGES, RESIDUALS) + "SELECT topic AS series, round(scale, 6) AS scale FROM scales"
ORACLES["exact_median"] = _with(MESSAGES, RESIDUALS) + """SELECT topic AS series,
  round(median(residual), 6) AS median FROM residuals GROUP BY topic"""
ORACLES["residual"] = _with(MESSAGES, RESIDUALS) + """SELECT topic AS series, timestamp,
  round(local_median, 6) AS local_median, round(residual, 6) AS residual FROM residuals"""
ORACLES["outlier"] = _with(MESSAGES, RESIDUALS) + """SELECT topic AS series, timestamp, round(value, 6) AS value,
  round(residual, 6) AS residual, abs(residual) > 3.0 * scale AS is_outlier
FROM residuals JOIN scales USING (topic)"""
ORACLES["clean_series"] = _with(*_TO_SMOOTH) + """SELECT topic AS series, timestamp, round(value, 6) AS value,
  CAST(1 AS BIGINT) AS n FROM clean"""
ORACLES["row_index"] = _with(*_TO_SMOOTH) + """SELECT series, timestamp, i AS index,
  round(v, 6) AS smooth FROM smooth"""
ORACLES["local_extrema"] = _with(*_TO_POINTS) + "SELECT series, kind, i AS index, round(v, 6) AS value FROM points"
ORACLES["min_distance"] = _with(*_TO_POINTS, SPACED, recursive=True) + """SELECT series, kind, i AS index,
  round(CASE WHEN kind = 'max' THEN v ELSE -v END, 6) AS height FROM spaced JOIN points USING (series, kind, i)"""
ORACLES["prominence"] = _with(*_TO_POINTS, PROMINENT) + """SELECT series, kind, i AS index,
  round(CASE WHEN kind = 'max' THEN h ELSE -h END, 6) AS value, round(prominence, 6) AS prominence FROM prominent"""
ORACLES["extrema"] = _with(*_TO_EXTREMA, recursive=True) + """SELECT series, kind, timestamp,
  round(v, 6) AS distance_mm FROM extrema"""
ORACLES["next_max"] = _with(*_TO_EXTREMA, SPANS, recursive=True) + """SELECT series, a AS min_index,
  b AS max_index FROM pairs WHERE b IS NOT NULL"""
ORACLES["segment_points"] = _with(*_TO_EXTREMA, SPANS, recursive=True) + """SELECT d.series, d.id, s.i AS index,
  s.timestamp, round(s.v, 6) AS value FROM done d JOIN smooth s ON s.series = d.series AND s.i BETWEEN d.a AND d.b"""
ORACLES["regr_slope"] = _segment_sql() + """SELECT series, a AS begin_index, is_current,
  round(slope, 6) AS slope_mm_per_hr FROM slopes"""
ORACLES["analyze_segments"] = _segment_sql() + "SELECT * EXCLUDE (exact_slope) FROM segments"
ORACLES["segments"] = ORACLES["analyze_segments"] + " WHERE NOT is_current"
TIDES = MESSAGES.replace("value,", """10.0::DOUBLE + 38.0::DOUBLE * (((epoch_us(ts) + 86400000000) % 388800000000)
           / 388800000000.0::DOUBLE) + value * 0.001::DOUBLE AS value,""")
ORACLES["current_segment"] = (ORACLES["analyze_segments"] + " WHERE is_current").replace(MESSAGES, TIDES)
ORACLES["refill_prediction"] = _segment_sql().replace(MESSAGES, TIDES) + """SELECT series,
  end_distance_mm AS current_distance_mm,
  slope_mm_per_hr, round((50.0 - end_distance_mm) / exact_slope, 4) AS time_to_50mm_hours,
  date_trunc('second', end_time + to_microseconds(CAST(
    (50.0 - end_distance_mm) / exact_slope * 3600000000 AS BIGINT)) + INTERVAL 500 MILLISECOND) AS predicted_refill_time
FROM segments WHERE is_current AND end_distance_mm < 50"""

ORACLES["assemble_snapshot"] = _with(*(
    part.replace("messages", "gappy_rows") for part in (
        MESSAGES.replace("messages", "messages_all"),
        "messages AS (SELECT * FROM messages_all WHERE qos <> 1)",
        RESIDUALS, SMOOTH, POINTS, SPACED, PROMINENT, EXTREMA, SPANS, SEGMENTS)),
    GAPPY, recursive=True) + f"""SELECT g.topic AS series, '2024-01-20T12:00:00' AS generated_at,
  '2024-01-05' AS season_start, true AS is_active, CAST(300 AS INTEGER) AS replay_delay_seconds,
  CAST(count(*) AS INTEGER) AS n_measurements, count(value) AS measurement_count,
  round(max(value), 6) AS max_level,
  CAST((SELECT count(*) FROM segments s WHERE s.series = g.topic) AS INTEGER) AS n_segments,
  CAST((SELECT count(*) FROM extrema s WHERE s.series = g.topic AND kind = 'min') AS INTEGER) AS n_minima,
  CAST((SELECT count(*) FROM extrema s WHERE s.series = g.topic AND kind = 'max') AS INTEGER) AS n_maxima
FROM gappy g WHERE {recent('gappy', '360 MINUTE').replace('gappy.topic', 'g.topic')} GROUP BY g.topic"""

# -- dashboard series --------------------------------------------------------------------------------

_HOURLY = f"hourly AS ({levels('messages', 60)})"

ORACLES["slope_trend"] = _segment_sql() + """SELECT series, id, is_current,
  make_timestamp((epoch_us(start_time) + epoch_us(end_time)) // 2) AS mid_time, slope_mm_per_hr FROM segments"""
ORACLES["fit_lines"] = _segment_sql() + """SELECT series, id, is_current, CAST(0 AS INTEGER) AS point,
  start_time AS t, start_distance_mm AS value FROM segments
UNION ALL SELECT series, id, is_current, 1, end_time, end_distance_mm FROM segments"""
ORACLES["segment_buckets"] = _segment_sql(_HOURLY) + """SELECT s.series, id, start_time, end_time, is_current, t, m
FROM segments s LEFT JOIN hourly h ON h.series = s.series AND t >= start_time AND t <= end_time"""
ORACLES["union_times"] = _segment_sql(_HOURLY) + """SELECT series, t FROM hourly
UNION ALL SELECT series, start_time FROM segments UNION ALL SELECT series, end_time FROM segments"""
ORACLES["axis_ranges"] = _segment_sql(_HOURLY, """times AS (SELECT series, t FROM hourly
  UNION ALL SELECT series, start_time FROM segments UNION ALL SELECT series, end_time FROM segments)""") + """SELECT series,
  make_timestamp(lo - CAST(round((hi - lo) * 0.02) AS BIGINT)) AS x_min,
  make_timestamp(hi + CAST(round((hi - lo) * 0.02) AS BIGINT)) AS x_max
FROM (SELECT series, min(epoch_us(t)) AS lo, max(epoch_us(t)) AS hi FROM times GROUP BY series)"""
ORACLES["sensor_axes"] = _with(READINGS, f"parts AS ({sensors(60)})") + """SELECT
  CAST(floor(min(temp_m * 9 / 5 + 32) - 5) AS BIGINT) AS temp_min,
  CAST(ceil(max(temp_m * 9 / 5 + 32) + 5) AS BIGINT) AS temp_max,
  CAST(greatest(0, floor(min(humidity_m) - 5)) AS BIGINT) AS humidity_min,
  CAST(least(100, ceil(max(humidity_m) + 5)) AS BIGINT) AS humidity_max FROM parts"""
ORACLES["overlay_sensors"] = _with(MESSAGES, READINGS, _HOURLY, """beside AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS t,
    round(avg(temperature) FILTER (device_type = 'water') * 9 / 5 + 32, 6) AS water_f,
    round(avg(temperature) FILTER (device_type = 'air') * 9 / 5 + 32, 6) AS air_f,
    round(avg(humidity), 6) AS humidity FROM readings GROUP BY t)""") + """SELECT series,
  coalesce(h.t, b.t) AS t, m, water_f, air_f, humidity FROM hourly h FULL JOIN beside b ON h.t = b.t"""

# -- streaming, alerts -------------------------------------------------------------------------------


def alert_sql(condition: str, hours: int) -> str:
    return _with(MESSAGES, f"hits AS (SELECT topic, timestamp, value FROM messages WHERE {condition})", f"""
sent AS (
  SELECT topic, min(timestamp) AS timestamp FROM hits GROUP BY topic
  UNION ALL
  SELECT s.topic, (SELECT min(h.timestamp) FROM hits h WHERE h.topic = s.topic
      AND h.timestamp >= s.timestamp + INTERVAL {hours} HOUR) AS timestamp
  FROM sent s WHERE s.timestamp IS NOT NULL)""", recursive=True) + """SELECT topic AS key, timestamp,
  round(value, 6) AS value FROM sent JOIN hits USING (topic, timestamp)"""


ORACLES["threshold_alerts"] = alert_sql("value > 120.0", 24)
ORACLES["threshold_alerts_below"] = alert_sql("value < 10.0", 1)
ORACLES["stream_alerts"] = ORACLES["threshold_alerts"]
ORACLES["stream_buckets"] = _with(MESSAGES) + levels("messages", 60)
ORACLES["stream_dedup"] = _with(MESSAGES) + "SELECT id, timestamp, topic FROM messages"

# -- folder tables kept by streams -------------------------------------------------------------------

ORACLES["keep_routed"] = ORACLES["ingest_messages"]
ORACLES["keep_unique"] = _with(MESSAGES) + f"SELECT {PLAIN} FROM messages"
ORACLES["multires_fresh"] = _with(MESSAGES) + _multires("messages")
ORACLES["archive_version"] = _with(MESSAGES) + f"""SELECT 'archive' AS part, {PLAIN},
  CAST(timestamp AS DATE) AS date FROM messages"""
