"""Column contracts shared by every job."""

from pyspark.sql import types as T

# Metric names, their order, time-of-day windows, causes.
METRICS = ("cpu", "ram", "network", "disk_io", "disk_usage", "load_avg")
ROLLING_METRICS = ("cpu", "ram", "load_avg")
ROLLING_N = 10
WINDOWS = ("night", "morning", "afternoon", "evening")
CAUSES = (
    "cpu_spike",
    "memory_leak",
    "network_flood",
    "disk_saturation",
    "silent_failure",
    "cascade",
)
WEAK_CAUSES = ("memory_leak", "cascade")
VERDICTS = ("true_positive", "false_positive", "true_negative", "false_negative")
SAFETY_NET_CAUSE = "unknown (flagged by safety-net model only)"
NETWORK_GEAR = ("router", "firewall", "dns")

STD_FLOOR = 1e-8
GLOBAL_STD_FLOOR = 1.0
Z_THRESHOLD = 3.0
PREDICT_THRESHOLD = 0.85
DOWNSTREAM_WEIGHT = 0.15
FEEDBACK_WEIGHT = 5.0
MAX_RECALL_DROP = 0.05

# Columns that describe a reading and are never model features.
META = ("timestamp", "machine", "type", "label", "anomaly_type", "hour", "window", "event_id")

READING_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("machine", T.StringType()),
        T.StructField("type", T.StringType()),
        *[T.StructField(m, T.DoubleType()) for m in METRICS],
        T.StructField("label", T.IntegerType()),
        T.StructField("anomaly_type", T.StringType()),
    ]
)

# The wider, one-minute form of the same reading.
READING_WIDE_SCHEMA = T.StructType(
    READING_SCHEMA.fields[:9]
    + [T.StructField("response_time", T.DoubleType()), T.StructField("packet_loss", T.DoubleType())]
    + READING_SCHEMA.fields[9:]
)

METRIC_FEED_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("machine", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("machine", T.StringType(), False),
        T.StructField("machine_type", T.StringType()),
        T.StructField("time_window", T.StringType()),
        T.StructField("features_json", T.StringType(), False),
        T.StructField("raw_metrics_json", T.StringType(), False),
        T.StructField("model_version", T.StringType(), False),
        T.StructField("predict_threshold", T.DoubleType(), False),
        T.StructField("xgb_p_normal", T.DoubleType()),
        T.StructField("xgb_cause", T.StringType()),
        T.StructField("iso_score", T.DoubleType()),
        T.StructField("final_is_anomaly", T.IntegerType(), False),
        T.StructField("final_cause", T.StringType()),
        T.StructField("operator_verdict", T.StringType()),
        T.StructField("verdict_timestamp", T.TimestampType()),
        T.StructField("verdict_notes", T.StringType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("run_ts", T.TimestampType(), False),
        T.StructField("model", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
