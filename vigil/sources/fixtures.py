"""Stand-in streams built from the driver tables.

The reference reads metric points and anomaly envelopes from a message
broker. For batch checks we build those streams from ``events``: the metric
requests are the M-1 points, and the anomaly stream is the real detector
output, encoded as envelopes. Defects are injected by fixed rules on the
point's ``seq`` so that Spark and the SQL oracle build the same input. The
jobs that consume these frames do not know the rules; they only see rows in
the stream schema.

Injected defects (fixed rules):
  metric requests: seq % 89 = 0 -> empty source; seq % 97 = 0 -> value NaN;
                   seq % 101 = 0 -> NULL metric name; seq % 103 = 0 -> +Inf
  metric payloads: seq % 97 = 0 -> '{bad'; seq % 89 = 0 -> value as a string;
                   seq % 83 = 0 -> only source and metric_name keys
  anomaly stream:  seq % 97 = 0 -> '{bad'; seq % 89 = 0 -> empty source;
                   seq % 79 = 0 -> flat version-1 envelope;
                   seq % 83 = 0 -> delivered twice (second stream_seq = seq + 10^9)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.config import EVENT_TYPE, MadConfig
from vigil.operators.envelope import encode_envelope, encode_flat_envelope, stamp_anomaly_events
from vigil.operators.ingest import METRIC_FIELDS, encode_metric_json
from vigil.operators.mad import detect_anomalies
from vigil.session import store_table
from vigil.sources.tables import metric_points_from_events

FIXED_CLOCK = "2024-02-01T00:00:00Z"
REDELIVERY_OFFSET = 1_000_000_000
SUBJECT = EVENT_TYPE


def metric_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = metric_points_from_events(spark, sf_dir)
    s = F.col("seq")
    return p.select(
        F.when(s % 89 == 0, F.lit("")).otherwise(F.col("source")).alias("source"),
        F.when(s % 101 == 0, F.lit(None).cast("string")).otherwise(F.col("metric_name")).alias("metric_name"),
        F.when(s % 97 == 0, F.lit(float("nan"))).when(s % 103 == 0, F.lit(float("inf")))
        .otherwise(F.col("value")).alias("value"),
        "env", "region", "instance_id", "timestamp", "seq")


def metric_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, received_ts, payload) as the metric stream carries it; the
    broker's receive time is the point's timestamp."""
    p = metric_points_from_events(spark, sf_dir)
    s = F.col("seq")
    good = encode_metric_json(p)
    str_value = F.to_json(F.struct("source", "metric_name", F.col("value").cast("string").alias("value")))
    partial = F.to_json(F.struct("source", "metric_name"))
    def typed(**other) -> F.Column:  # the same record with fields of other JSON types
        return F.to_json(F.struct(*[other.get(c, F.col(c)).alias(c) for c in METRIC_FIELDS]),
                         {"ignoreNullFields": "false"})

    payload = (F.when(s % 97 == 0, F.lit("{bad")).when(s % 89 == 0, str_value)
               .when(s % 83 == 0, partial)
               .when(s % 79 == 0, typed(source=F.lit(5)))
               .when(s % 73 == 0, typed(env=F.create_map(F.lit("a"), F.lit(1))))
               .when(s % 71 == 0, typed(instance_id=F.lit(True)))
               .when(s % 67 == 0, typed(region=F.lit(None).cast("string")))
               .when(s % 61 == 0, typed(metric_name=F.lit(7)))
               .when(s % 59 == 0, typed(timestamp=F.lit("x")))
               .when(s % 53 == 0, typed(region=F.array(F.lit("eu"))))
               .otherwise(good))
    return p.select("seq", F.col("timestamp").alias("received_ts"), payload.alias("payload"))


#: Payload texts by seq % 16, with ``{s}`` the source, ``{m}`` the metric, ``{v}``
#: a whole number and ``{t}`` the timestamp.
PAYLOAD_TEXTS = (
    '{"source":"{s}","metric_name":"{m}","value":{v},"timestamp":{t}}',
    '{"source":"{s}","metric_name":"{m}","value":{v},"timestamp":{t}} trailing',
    '{"source":"{s}","metric_name":"{m}","value":{v}}{"source":"b"}',
    '{"source":"{s}","metric_name":"{m}","value":{v}}}',
    '{"source":"{s}"},{"metric_name":"{m}","value":{v}}',
    '{"source":"{s}","value":{v}}],[{"source":"b"}',
    '{"source":"x","source":"{s}","metric_name":"{m}","value":1,"value":{v}}',
    '{"source":5,"source":"{s}","metric_name":"{m}","value":{v}}',
    '{"source":5,"source":6,"metric_name":"{m}","value":{v}}',
    '  null ',
    ' {"source":"{s}" , "metric_name":"{m}","value":{v},"more":{"a":1,"a":[2]},"env":null}  ',
    '[{"source":"{s}","metric_name":"{m}","value":{v}}]',
    '{"source":"{s}","metric_name":"{m}","value":"{v}","value":{v}}',
    '{"source":"{s}","metric_name":"{m}","value":0{v}}',
    "{'source':'{s}','metric_name':'{m}','value':{v}}",
    '',
)


def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, payload): the points' values in texts that are, or nearly are, a
    JSON object."""
    p = metric_points_from_events(spark, sf_dir)
    text = F.element_at(F.array(*(F.lit(t) for t in PAYLOAD_TEXTS)), (F.col("seq") % len(PAYLOAD_TEXTS) + 1).cast("int"))
    whole = F.floor("value").cast("long").cast("string")
    for mark, value in (("{s}", F.col("source")), ("{m}", F.col("metric_name")), ("{v}", whole),
                        ("{t}", F.col("timestamp").cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    return p.select("seq", text.alias("payload"))


def envelope_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, stream_seq, payload): the payload texts as flat envelopes, and
    (rows of odd half) as version-2 envelopes around them."""
    p = payload_texts(spark, sf_dir)
    inner = F.concat(F.lit('{"meta":{"event_id":"e'), F.col("seq").cast("string"), F.lit('"},"data":'), F.col("payload"), F.lit("}"))
    half = F.floor(F.col("seq") / len(PAYLOAD_TEXTS)) % 2 == 1
    return p.select(F.lit(SUBJECT).alias("subject"), F.col("seq").alias("stream_seq"),
                    F.when(half, inner).otherwise(F.col("payload")).alias("payload"))


def anomaly_events_stamped(spark: SparkSession, sf_dir: str, cfg: MadConfig) -> DataFrame:
    anomalies = detect_anomalies(metric_points_from_events(spark, sf_dir), cfg)
    return stamp_anomaly_events(anomalies, cfg.threshold_k, clock=FIXED_CLOCK)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a parquet table below the checkpoint dir and read it
    back (what a broker or table would hold); cuts the lineage so branches
    that read it do not recompute it."""
    return store_table(df, name)


def stored_anomaly_events(spark: SparkSession, sf_dir: str, cfg: MadConfig) -> DataFrame:
    """The stamped anomaly events, detected once and stored."""
    return store(anomaly_events_stamped(spark, sf_dir, cfg), "anomaly-events")


def anomaly_stream(spark: SparkSession, sf_dir: str, cfg: MadConfig,
                   events: DataFrame | None = None) -> DataFrame:
    """(subject, stream_seq, payload) rows of the anomaly stream."""
    ev = events if events is not None else stored_anomaly_events(spark, sf_dir, cfg)
    s = F.col("seq")
    ev = ev.withColumn("source", F.when(s % 89 == 0, F.lit("")).otherwise(F.col("source")))
    payload = (F.when(s % 97 == 0, F.lit("{bad"))
               .when(s % 79 == 0, encode_flat_envelope(ev))
               .otherwise(encode_envelope(ev)))
    first = ev.select(F.lit(SUBJECT).alias("subject"), s.alias("stream_seq"), payload.alias("payload"))
    again = first.filter(F.col("stream_seq") % 83 == 0).withColumn(
        "stream_seq", F.col("stream_seq") + F.lit(REDELIVERY_OFFSET))
    return first.unionByName(again)


def late_resends(spark: SparkSession, sf_dir: str, cfg: MadConfig,
                 events: DataFrame | None = None) -> DataFrame:
    """Re-sends of anomalies with seq % 7 = 0 as new events (new event_id)
    arriving after everything else (stream_seq = seq + 2 * 10^9): their
    timestamps are older than later anomalies of the same series."""
    ev = events if events is not None else stored_anomaly_events(spark, sf_dir, cfg)
    ev = ev.filter(F.col("seq") % 7 == 0)
    s = F.col("seq")
    ev = (ev.withColumn("source", F.when(s % 89 == 0, F.lit("")).otherwise(F.col("source")))
          .withColumn("event_id", F.sha2(F.concat(F.col("event_id"), F.lit(":late")), 256)))
    return ev.select(F.lit(SUBJECT).alias("subject"), (s + F.lit(2 * REDELIVERY_OFFSET)).alias("stream_seq"),
                     encode_envelope(ev).alias("payload"))
