"""Read-model projection: idempotent append + latest state per series.

* dedup key = ``event_id``, or ``"<subject>:<stream_seq>"`` when it is empty;
* first arrival (lowest ``stream_seq``) of a key wins; a key already in the
  ledger of processed events is skipped entirely (no append, no upsert);
* every surviving event is appended to ``anomaly_events``;
* ``series_state`` keeps, per series, the event that arrived *last* (highest
  ``stream_seq``) — no timestamp guard, an older ``ts`` arriving later wins.

Both reductions are ``min_by`` / ``max_by`` aggregates, which Spark combines
map-side before the shuffle, so a storm of copies of one event or one very
hot series is folded down before any exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.envelope import rfc3339
from vigil.schemas import ANOMALY_EVENT_COLUMNS, SERIES_KEY

STATE_VALUE_COLUMNS = ("last_ts", "last_value", "baseline", "mad", "threshold", "window_size",
                       "threshold_k", "detector", "producer", "trace_id", "event_id",
                       "event_version", "occurred_at", "produced_at")


def with_dedup_key(decoded: DataFrame) -> DataFrame:
    key = F.when(F.col("event_id") == "", F.concat_ws(":", F.col("subject"),
                                                      F.col("stream_seq").cast("string"))) \
        .otherwise(F.col("event_id"))
    return decoded.withColumn("dedup_key", key)


def first_wins(decoded: DataFrame, ledger: DataFrame | None = None, *,
               with_deliveries: bool = False) -> DataFrame:
    """One row per dedup key: the earliest arrival. Keys present in
    ``ledger`` (a frame with a ``dedup_key`` column) are dropped.
    ``with_deliveries`` adds how many copies of the key arrived (same
    aggregation pass)."""
    df = decoded if "dedup_key" in decoded.columns else with_dedup_key(decoded)
    cols = [c for c in df.columns if c != "dedup_key"]
    aggs = [F.min_by(F.struct(*cols), F.col("stream_seq")).alias("_r")]
    if with_deliveries:
        aggs.append(F.count(F.lit(1)).alias("deliveries"))
    firsts = (df.groupBy("dedup_key").agg(*aggs)
              .select("dedup_key", "_r.*", *(["deliveries"] if with_deliveries else [])))
    if ledger is not None:
        firsts = firsts.join(ledger.select("dedup_key"), "dedup_key", "left_anti")
    return firsts


def to_anomaly_events(firsts: DataFrame, created_at: str | None = None) -> DataFrame:
    """Rows for the append-only ``anomaly_events`` table.

    ``id`` is the stream sequence of the stored (first) arrival: unique and
    increasing in arrival order, like an insertion serial, but computed
    without any global ordering step. ``ts`` is the point timestamp;
    ``event_date`` (UTC day of ``ts``) is the table's partition column."""
    created = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    return firsts.select(
        F.col("stream_seq").alias("id"),
        *[F.col("timestamp").alias("ts") if c == "ts" else F.col(c) for c in ANOMALY_EVENT_COLUMNS],
        created.alias("created_at"),
        "dedup_key", "subject", "stream_seq",
        F.to_date(F.timestamp_seconds(F.col("timestamp"))).alias("event_date"),
    )


def processed_ledger(firsts: DataFrame) -> DataFrame:
    """The processed-events ledger rows (dedup_key, subject, stream_seq)."""
    return firsts.select("dedup_key", "subject", "stream_seq",
                         F.current_timestamp().alias("processed_at"))


def fold_series_state(events: DataFrame, previous: DataFrame | None = None,
                      updated_at: str | None = None) -> DataFrame:
    """Latest state per series from ``anomaly_events`` rows (last arrival
    wins). With ``previous`` state, the new events are merged into it: the
    union is reduced again by arrival order, which is what an upsert does."""
    upd = F.lit(updated_at).cast("timestamp") if updated_at else F.current_timestamp()
    new = events.select(*SERIES_KEY,
                        F.col("ts").alias("last_ts"), F.col("value").alias("last_value"),
                        *[c for c in STATE_VALUE_COLUMNS if c not in ("last_ts", "last_value")],
                        F.col("stream_seq").alias("last_seq"), upd.alias("updated_at"))
    if previous is not None:
        new = previous.select(*new.columns).unionByName(new)
    vals = [c for c in new.columns if c not in SERIES_KEY]
    return (new.groupBy(*SERIES_KEY)
            .agg(F.max_by(F.struct(*vals), F.col("last_seq")).alias("_s"))
            .select(*SERIES_KEY, "_s.*"))


def project(decoded: DataFrame, ledger: DataFrame | None = None,
            previous_state: DataFrame | None = None, *, created_at: str | None = None,
            updated_at: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decoded anomalies -> (new anomaly_events rows, new ledger rows,
    series_state). One batch of the projector."""
    firsts = first_wins(decoded, ledger)
    events = to_anomaly_events(firsts, created_at)
    state = fold_series_state(events, previous_state, updated_at)
    return events, processed_ledger(firsts), state


def series_view(state: DataFrame) -> DataFrame:
    """The 15 served series columns; ``updated_at`` as RFC3339 text."""
    return state.select(*SERIES_KEY, "last_ts", "last_value", "baseline", "mad", "threshold",
                        "window_size", "threshold_k", "detector", "producer", "trace_id",
                        rfc3339(F.col("updated_at")).alias("updated_at"))
