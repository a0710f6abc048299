"""Structured Streaming sources, sinks and the read-model projector.

Sources
  * ``metric_stream``: metric points from a file source (parquet/JSON) or a
    Kafka topic (``format="kafka"``; the connector jar must be on the
    classpath). Kafka rows decode their ``value`` JSON; ``seq`` is made of
    partition and offset.
  * ``anomaly_stream``: anomaly envelopes (subject, stream_seq, payload).

Sinks
  * ``write_metric_stream`` / ``write_anomaly_stream`` /
    ``write_prediction_stream``: the JSON payload as ``value`` text, to files
    or Kafka.

Projector
  ``Projector`` is a ``foreachBatch`` function that turns each micro-batch of
  envelopes into the read model. It is idempotent per batch id, so a batch
  that is re-run after a failure gives the same tables:
  * each table (events by ``event_date``, processed keys and series state by
    hash bucket) holds a batch's rows in a folder of its own, which batch N
    overwrites; its dedup check looks at batches ``< N`` only;
  * the dedup check asks the Bloom filters of the processed keys first, and
    then reads the buckets in which one of the batch's keys may be;
  * the state of a batch is its own changed series; readers take the newest
    row of each (see ``vigil.streaming.store``);
  * every ``compact_every`` batches the files so far are merged.
  Malformed and invalid envelopes go to a quarantine table, also per batch.
  Envelopes are parsed once per batch.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.envelope import encode_envelope, parse_envelope, split_envelopes
from vigil.operators.ingest import decode_metric_json, encode_metric_json
from vigil.operators.projection import first_wins, fold_series_state, to_anomaly_events, with_dedup_key
from vigil.schemas import SERIES_KEY
from vigil.session import fresh_subdir
from vigil.streaming.store import BUCKETS, BatchTable, KeyedStore, KeyLedger, path_exists


def kafka_sequence() -> F.Column:
    """A number that is unique over the partitions of a topic and grows with
    the offset within each: the partition above 48 bits of offset."""
    return F.shiftleft(F.col("partition").cast("long"), 48).bitwiseOR(F.col("offset"))


def metric_stream(spark: SparkSession, path_or_topic: str, *, fmt: str = "parquet", schema=None,
                  options: dict | None = None, quarantine: bool = False):
    """Streaming metric records. File formats need ``schema``. A Kafka topic
    carries JSON; with ``quarantine`` its malformed payloads are returned too:
    (points, quarantine) instead of points."""
    reader = spark.readStream.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if fmt == "kafka":
        raw = reader.option("subscribe", path_or_topic).load()
        pts, bad = decode_metric_json(raw.select(kafka_sequence().alias("seq"),
                                                 F.col("value").cast("string").alias("payload")))
        return (pts, bad) if quarantine else pts
    if quarantine:
        raise ValueError("only JSON payloads can be malformed")
    return reader.schema(schema).load(path_or_topic)


def anomaly_stream(spark: SparkSession, path_or_topic: str, *, fmt: str = "parquet", schema=None,
                   options: dict | None = None) -> DataFrame:
    """Streaming anomaly envelopes as (subject, stream_seq, payload)."""
    reader = spark.readStream.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if fmt == "kafka":
        raw = reader.option("subscribe", path_or_topic).load()
        return raw.select(F.col("topic").alias("subject"), kafka_sequence().alias("stream_seq"),
                          F.col("value").cast("string").alias("payload"))
    schema = schema or "subject string, stream_seq long, payload string"
    return reader.schema(schema).load(path_or_topic)


def _sink(df: DataFrame, value: F.Column, target: str, checkpoint: str, fmt: str,
          options: dict | None):
    w = df.select(value.alias("value")).writeStream.format(fmt).option("checkpointLocation", checkpoint)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    return w.option("topic" if fmt == "kafka" else "path", target)


def write_metric_stream(points: DataFrame, target: str, checkpoint: str, *, fmt: str = "text",
                        options: dict | None = None):
    """DataStreamWriter publishing the 7-field metric JSON (call ``.start()``)."""
    return _sink(points, encode_metric_json(points), target, checkpoint, fmt, options)


def write_anomaly_stream(events: DataFrame, target: str, checkpoint: str, *, fmt: str = "text",
                         options: dict | None = None):
    """DataStreamWriter publishing V2(+flat) anomaly envelopes."""
    return _sink(events, encode_envelope(events), target, checkpoint, fmt, options)


def write_prediction_stream(predictions: DataFrame, target: str, checkpoint: str, *,
                            fmt: str = "text", options: dict | None = None):
    """DataStreamWriter publishing prediction events as JSON: metric_name,
    source (the producer label), results {if_anomaly, custom_loss,
    is_degradation}, timestamp (call ``.start()``)."""
    value = F.to_json(F.struct("metric_name", F.col("producer").alias("source"), "results", "timestamp"))
    return _sink(predictions, value, target, checkpoint, fmt, options)


#: Columns of the stored events (``anomaly_events`` rows).
EVENT_SCHEMA = (
    "id long, source string, metric_name string, env string, region string, instance_id string, ts long, value double, "
    "baseline double, mad double, threshold double, window_size int, threshold_k double, detector string, producer string, "
    "trace_id string, event_id string, event_type string, event_version int, occurred_at string, produced_at string, "
    "created_at timestamp, dedup_key string, subject string, stream_seq long, event_date date")
_STATE_VALUES = (
    "last_ts long, last_value double, baseline double, mad double, threshold double, window_size int, threshold_k double, "
    "detector string, producer string, trace_id string, event_id string, event_version int, occurred_at string, "
    "produced_at string, last_seq long, updated_at timestamp")


class Projector:
    """``foreachBatch`` handler: envelopes -> anomaly_events + series_state."""

    def __init__(self, root: str, *, compact_every: int = 20, buckets: int = BUCKETS):
        self.root, self.compact_every = root.rstrip("/"), compact_every
        self.stored = BatchTable(f"{self.root}/anomaly_events", EVENT_SCHEMA, "event_date")
        self.ledger = KeyLedger(f"{self.root}/processed", more="subject string, stream_seq long", buckets=buckets)
        self.state = KeyedStore(f"{self.root}/series_state", SERIES_KEY, _STATE_VALUES, version="last_seq", buckets=buckets)
        self.quarantine_path = f"{self.root}/quarantine"

    def _require(self, spark: SparkSession, batch_id: int) -> None:
        """Every batch leaves a mark; without the one before, earlier state
        and keys are lost, and going on would repeat or forget events."""
        if batch_id and not (spark.read.schema("batch_id long").option("basePath", f"{self.root}/done")
                             .parquet(f"{self.root}/done").filter(F.col("batch_id") == batch_id - 1).limit(1).count()
                             if path_exists(spark, f"{self.root}/done") else 0):
            raise RuntimeError(f"batch {batch_id - 1} is missing below {self.root}; "
                               "restore it, or replay the stream from its start into an empty folder")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self._require(spark, batch_id)
        if self.compact_every and batch_id and batch_id % self.compact_every == 0:
            self.compact(spark, batch_id - 1)  # earlier batches can't run again
        parsed = parse_envelope(batch).persist(StorageLevel.MEMORY_AND_DISK)  # parsed once
        try:
            decoded, quarantine = split_envelopes(parsed, batch.columns)
            quarantine.write.mode("overwrite").parquet(f"{self.quarantine_path}/batch_id={batch_id}")
            decoded = with_dedup_key(decoded)
            old = self.ledger.known(decoded.select("dedup_key").distinct(), before=batch_id)
            events = to_anomaly_events(first_wins(decoded, old))
            self.stored.write(events, batch_id)
        finally:
            parsed.unpersist()
        written = spark.read.schema(EVENT_SCHEMA).parquet(self.stored.changes(batch_id))
        self.ledger.write(written.select("dedup_key", "subject", "stream_seq"), batch_id)
        self.state.write(fold_series_state(written), batch_id)  # the changed series only
        (spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/done/batch_id={batch_id}"))

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Merge the files of the batches up to ``upto`` in all tables."""
        for table in (self.stored, self.ledger, self.state):
            table.compact(spark, upto)

    def events(self, spark: SparkSession) -> DataFrame:
        """All events, with ``event_date`` as the partition column."""
        return self.stored.read(spark)

    def latest_state(self, spark: SparkSession) -> DataFrame:
        """The newest state of every series."""
        return self.state.latest(spark)


def run_available_now(writer, timeout_s: int | None = None) -> None:
    """Start a DataStreamWriter with the availableNow trigger and wait."""
    q = writer.trigger(availableNow=True).start()
    try:
        if timeout_s is None:
            q.awaitTermination()
        elif not q.awaitTermination(timeout_s):
            raise TimeoutError(f"streaming query did not finish in {timeout_s}s")
        if q.exception() is not None:
            raise q.exception()
    finally:
        if q.isActive:
            q.stop()


def run_until_drained(writer, interval: str = "1 second", timeout_s: int | None = None,
                      empty_ok: bool = False) -> None:
    """Run a DataStreamWriter on a processing-time trigger until everything
    available is processed, then stop it. Queries with processing-time state
    TTL keep firing no-data batches, so neither ``availableNow`` nor
    ``processAllAvailable`` ends them. Instead the query's progress is
    polled: it is drained once input was seen, the latest batch read nothing
    and no data is pending. Only with ``empty_ok`` may no input come at all."""
    import time
    q = writer.trigger(processingTime=interval).start()
    try:
        t0, seen = time.time(), False
        while True:
            if q.exception() is not None:
                raise q.exception()
            prog = q.recentProgress
            seen = seen or any(p["numInputRows"] > 0 for p in prog)
            st = q.status
            idle = prog and prog[-1]["numInputRows"] == 0 and not st["isDataAvailable"]
            if idle and (seen or (empty_ok and len(prog) >= 3)):
                return
            if timeout_s is not None and time.time() - t0 > timeout_s:
                raise TimeoutError(f"streaming query not drained in {timeout_s}s")
            time.sleep(0.5)
    finally:
        q.stop()


def stream_to_parquet(df: DataFrame, name: str, timeout_s: int | None = None, base: str | None = None,
                      drain: bool = False) -> DataFrame:
    """Run a streaming frame to completion into a parquet folder below the
    checkpoint dir and return the stored result as a batch frame. With the
    ``base`` of an earlier run it resumes from that run's checkpoint. ``drain``:
    the query has processing-time state (see ``run_until_drained``)."""
    spark = df.sparkSession
    base = base or fresh_subdir(spark, name)
    writer = (df.writeStream.format("parquet").outputMode("append")
              .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt"))
    if drain:
        run_until_drained(writer, timeout_s=timeout_s, empty_ok=True)  # files without rows count as seen
    else:
        run_available_now(writer, timeout_s)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def project_stream(envelopes: DataFrame, name: str = "projector", timeout_s: int | None = None,
                   base: str | None = None, **options) -> Projector:
    """Run the projector over a streaming envelope frame to completion, from
    the checkpoint of an earlier run where ``base`` names one."""
    spark = envelopes.sparkSession
    base = base or fresh_subdir(spark, name)
    proj = Projector(f"{base}/tables", **options)
    writer = (envelopes.writeStream.foreachBatch(proj)
              .option("checkpointLocation", f"{base}/ckpt"))
    run_available_now(writer, timeout_s)
    return proj
