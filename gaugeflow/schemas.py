"""Fixed schemas of the stored tables and of the vendor report."""

from pyspark.sql import types as T

MESSAGES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("topic", T.StringType(), False),
    T.StructField("payload", T.StringType()),
    T.StructField("qos", T.IntegerType()),
    T.StructField("retain", T.BooleanType()),
])

READINGS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("topic", T.StringType(), False),
    T.StructField("device_id", T.StringType(), False),
    T.StructField("device_type", T.StringType(), False),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("battery", T.IntegerType()),
    T.StructField("signal", T.IntegerType()),
    T.StructField("raw_json", T.StringType()),
])

# What arrives from a broker or a file drop, before routing and decoding.
FEED = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("qos", T.IntegerType()),
    T.StructField("retain", T.BooleanType()),
])

# The vendor's device report, as far as it is used.
REPORT = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("deviceId", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("temperature", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("battery", T.IntegerType()),
        T.StructField("loraInfo", T.StructType([T.StructField("signal", T.IntegerType())])),
    ])),
])

_AGG = T.StructType([
    T.StructField("m", T.DoubleType()),
    T.StructField("s", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
])

_LEVEL_POINT = T.StructType([
    T.StructField("t", T.StringType()),
    T.StructField("m", T.DoubleType()),
    T.StructField("s", T.DoubleType()),
    T.StructField("n", T.LongType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
])

_SENSOR_POINT = T.StructType([
    T.StructField("t", T.StringType()),
    T.StructField("temp", _AGG),
    T.StructField("n", T.LongType()),
    T.StructField("humidity", _AGG),
])


def _resolution(*data: T.StructField) -> T.StructType:
    return T.StructType([
        T.StructField("interval_minutes", T.IntegerType()),
        T.StructField("lookback_hours", T.IntegerType()),
        *data,
    ])


_LEVEL_SERIES = _resolution(T.StructField("data", T.ArrayType(_LEVEL_POINT)))
_SENSOR_SERIES = _resolution(
    T.StructField("air", T.ArrayType(_SENSOR_POINT)),
    T.StructField("water", T.ArrayType(_SENSOR_POINT)),
)
_EXTREMUM = T.ArrayType(T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("distance_mm", T.DoubleType()),
]))

SNAPSHOT = T.StructType([
    T.StructField("series", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("season", T.StructType([
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
    ])),
    T.StructField("measurements", T.ArrayType(T.StructType([
        T.StructField("timestamp", T.StringType()),
        T.StructField("water_level_mm", T.DoubleType()),
    ]))),
    T.StructField("replay_delay_seconds", T.IntegerType()),
    T.StructField("stats", T.StructType([
        T.StructField("min_level", T.DoubleType()),
        T.StructField("max_level", T.DoubleType()),
        T.StructField("avg_level", T.DoubleType()),
        T.StructField("stddev", T.DoubleType()),
        T.StructField("measurement_count", T.LongType()),
    ])),
    T.StructField("agg_1m", _LEVEL_SERIES),
    T.StructField("agg_5m", _LEVEL_SERIES),
    T.StructField("agg_1h", _LEVEL_SERIES),
    T.StructField("analysis", T.StructType([
        T.StructField("segments", T.ArrayType(T.StructType([
            T.StructField("id", T.LongType()),
            T.StructField("start_time", T.StringType()),
            T.StructField("end_time", T.StringType()),
            T.StructField("start_distance_mm", T.DoubleType()),
            T.StructField("end_distance_mm", T.DoubleType()),
            T.StructField("slope_mm_per_hr", T.DoubleType()),
            T.StructField("duration_hours", T.DoubleType()),
            T.StructField("n_points", T.LongType()),
            T.StructField("is_current", T.BooleanType()),
        ]))),
        T.StructField("extrema", T.StructType([
            T.StructField("minima", _EXTREMUM),
            T.StructField("maxima", _EXTREMUM),
        ])),
        T.StructField("current_prediction", T.StructType([
            T.StructField("current_distance_mm", T.DoubleType()),
            T.StructField("slope_mm_per_hr", T.DoubleType()),
            T.StructField("time_to_50mm_hours", T.DoubleType()),
            T.StructField("predicted_refill_time", T.StringType()),
        ])),
    ])),
    T.StructField("yolink_sensors", T.StructType([
        T.StructField("agg_1m", _SENSOR_SERIES),
        T.StructField("agg_5m", _SENSOR_SERIES),
        T.StructField("agg_1h", _SENSOR_SERIES),
    ])),
])
