"""Fixed record and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# A series is identified by these four columns; instance_id is NOT part of it
# (all instances of a service share one baseline).
SERIES_KEY = ("source", "metric_name", "env", "region")

# Metric point as it travels on the metric stream (7 snake_case JSON keys).
METRIC_FIELDS = ("source", "metric_name", "value", "env", "region",
                 "instance_id", "timestamp")
METRIC_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("env", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("instance_id", T.StringType()),
    T.StructField("timestamp", T.LongType()),       # unix seconds
])
# Point plus the broker sequence that orders ties.
POINT_SCHEMA = T.StructType(METRIC_SCHEMA.fields + [T.StructField("seq", T.LongType())])

# Detector statistics appended to a point.
STATS_FIELDS = ("n", "baseline", "mad", "lower", "upper", "is_anomaly")

# The 13 data fields of an anomaly (nested under ``data`` and repeated flat).
_DATA_FIELDS = [
    T.StructField("source", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("env", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("instance_id", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("baseline", T.DoubleType()),
    T.StructField("mad", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("window_size", T.LongType()),
    T.StructField("threshold_k", T.DoubleType()),
    T.StructField("detector", T.StringType()),
]
DATA_FIELD_NAMES = tuple(f.name for f in _DATA_FIELDS)
META_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_version", T.LongType()),
    T.StructField("producer", T.StringType()),
    T.StructField("occurred_at", T.StringType()),
    T.StructField("produced_at", T.StringType()),
    T.StructField("trace_id", T.StringType()),
])
DATA_SCHEMA = T.StructType(_DATA_FIELDS)
ENVELOPE_SCHEMA = T.StructType(
    [T.StructField("meta", META_SCHEMA), T.StructField("data", DATA_SCHEMA)] + _DATA_FIELDS)

# Decoded anomaly (what the read-model projector consumes).
DTO_COLUMNS = ("source", "metric_name", "env", "region", "instance_id", "timestamp",
               "value", "baseline", "mad", "threshold", "window_size", "threshold_k",
               "detector", "event_id", "event_type", "producer", "occurred_at",
               "produced_at", "trace_id", "event_version")

# Read-model table columns.
ANOMALY_EVENT_COLUMNS = ("source", "metric_name", "env", "region", "instance_id", "ts",
                         "value", "baseline", "mad", "threshold", "window_size",
                         "threshold_k", "detector", "producer", "trace_id", "event_id",
                         "event_type", "event_version", "occurred_at", "produced_at")
SERIES_STATE_COLUMNS = ("source", "metric_name", "env", "region", "last_ts", "last_value",
                        "baseline", "mad", "threshold", "window_size", "threshold_k",
                        "detector", "producer", "trace_id", "event_id", "event_version",
                        "occurred_at", "produced_at", "updated_at")
# Columns served by the list / get queries.
LIST_ANOMALIES_COLUMNS = ("id", "source", "metric_name", "env", "region", "instance_id",
                          "ts", "value", "baseline", "mad", "threshold", "window_size",
                          "threshold_k", "detector", "producer", "trace_id", "event_id",
                          "created_at")
SERIES_VIEW_COLUMNS = ("source", "metric_name", "env", "region", "last_ts", "last_value",
                       "baseline", "mad", "threshold", "window_size", "threshold_k",
                       "detector", "producer", "trace_id", "updated_at")
