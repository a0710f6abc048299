"""Extensions: behaviour the reference only *describes* in its documents
(no reference code exists). Each is labelled with its survey id (D-n).

All are plain DataFrame aggregates / filters: map-side partial aggregation
handles hot groups, and the only join (bounds rules) is salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.operators.mad import DEFAULT_TARGET_CHUNK_ROWS, _with_chunk, plan_chunks
from vigil.schemas import SERIES_KEY

# --- fixed values (from the reference's guideline text) --------------------
OVERSIZE_BYTES = 1024 * 1024      # payloads above 1 MiB go to the dead letters
OVERSIZE_KEEP_BYTES = 1024        # ... keeping the first 1 KiB
DLQ_FETCH = 50                    # oldest dead letters fetched at a time
DLQ_RETENTION_SECONDS = 7 * 86400
P99_TARGET_MS = {"normalise": 200, "classify": 500, "publish": 50}
ERROR_RATE_TARGET = 0.001
DLQ_PER_HOUR_TARGET = 5
CARDINALITY_LIMIT = 100
# ---------------------------------------------------------------------------
RULE_SALTS = 16


def bounds_check(points: DataFrame, rules: DataFrame) -> DataFrame:
    """D-1: reject values outside [lo, hi] of their metric's rule. ``rules``
    has (metric_name, lo, hi); metrics without a rule pass. Adds
    ``bounds_reason`` (NULL when within bounds). Spark broadcasts the rules
    when they are under its size threshold; otherwise points and rules meet on
    the metric and a salt, so that one common metric is spread over
    ``RULE_SALTS`` tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.lit(RULE_SALTS)).cast("int")
    r = (rules.select(F.col("metric_name").alias("_metric"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
         .withColumn("_rule_salt", F.explode(F.sequence(F.lit(0), F.lit(RULE_SALTS - 1)))))
    j = points.withColumn("_salt", salt).join(
        r, (F.col("metric_name") == F.col("_metric")) & (F.col("_salt") == F.col("_rule_salt")), "left")
    out = (F.col("_lo").isNotNull() & ((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi"))))
    return (j.withColumn("bounds_reason", F.when(out, F.lit("value out of bounds")))
            .select(*points.columns, "bounds_reason"))


def dead_letters(*quarantines: DataFrame, payload: str = "payload", seq: str = "seq",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """D-2: one dead-letter frame from several quarantine outputs (terminal
    errors only; duplicates are never dead letters because dedup drops them
    silently). Columns: seq, reason, payload (whole), payload_bytes and any
    ``keep`` columns. Only ``oversize_guard`` cuts payloads."""
    parts = [q.select(F.col(seq).alias("seq"), "reason", *keep, F.col(payload).alias("payload"),
                      F.octet_length(F.col(payload)).alias("payload_bytes")) for q in quarantines]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_bytes(text: Column, n: int) -> Column:
    """The longest prefix of at most ``n`` UTF-8 bytes that ends with a whole
    code point."""
    data = text.cast("binary")
    # a cut is whole if the byte after it doesn't continue a code point
    starts = lambda k: ~F.hex(F.substring(data, k + 1, 1)).between("80", "BF")
    cut = F.coalesce(*[F.when(starts(k), F.lit(k)) for k in range(n, n - 4, -1)], F.lit(n))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(data, F.lit(1), cut).cast("string"))


def oversize_guard(df: DataFrame, payload: str, limit_bytes: int = OVERSIZE_BYTES) -> tuple[DataFrame, DataFrame]:
    """D-3: split (accepted, dead letters) on payload byte size; dead letters
    keep only the first 1 KiB of the payload, cut between code points."""
    size = F.octet_length(F.col(payload))
    ok = df.filter(size <= F.lit(limit_bytes))
    dlq = (df.filter(size > F.lit(limit_bytes))
           .withColumn("payload_bytes", size)
           .withColumn(payload, first_bytes(F.col(payload), OVERSIZE_KEEP_BYTES))
           .withColumn("reason", F.lit("payload too large")))
    return ok, dlq


def dlq_oldest(dlq: DataFrame, ts_col: str, n: int = DLQ_FETCH) -> DataFrame:
    """D-4: the ``n`` oldest dead letters (top-k, ties by seq)."""
    return dlq.orderBy(F.col(ts_col).asc(), F.col("seq").asc()).limit(n)


def dlq_purge(dlq: DataFrame, ts_col: str, now_ts: int,
              retention_s: int = DLQ_RETENTION_SECONDS) -> DataFrame:
    """D-4: dead letters that survive a purge of entries older than the
    retention period (``now_ts`` in unix seconds)."""
    return dlq.filter(F.col(ts_col) >= F.lit(now_ts - retention_s))


def red_rollup(points: DataFrame, bucket_seconds: int, error_metric: str = "error",
               keys=("source",)) -> DataFrame:
    """D-7: rate / errors / duration roll-up per tumbling time bucket and
    label: message count, error count, value sum, min, max."""
    b = (F.floor(F.col("timestamp") / F.lit(bucket_seconds)) * F.lit(bucket_seconds)).alias("bucket")
    return (points.groupBy(*keys, b)
            .agg(F.count(F.lit(1)).alias("messages"),
                 F.sum(F.when(F.col("metric_name") == error_metric, 1).otherwise(0)).alias("errors"),
                 F.sum("value").alias("value_sum"), F.min("value").alias("value_min"),
                 F.max("value").alias("value_max")))


def p_at_most(value: Column, target: float, q: float) -> Column:
    """Aggregate: True when the q-quantile (nearest rank) of ``value`` is at
    most ``target``, i.e. at least a fraction q of values are <= target. Exact,
    and a plain sum/count, so it combines map-side (no per-group sort)."""
    return F.avg(F.when(value <= F.lit(target), 1.0).otherwise(0.0)) >= F.lit(q)


def slo_report(points: DataFrame, bucket_seconds: int, latency_target: float,
               error_metric: str = "error", keys=("source",)) -> DataFrame:
    """D-8: per label and bucket: p99 of ``value`` within target, error rate
    below 0.1 %, and both together."""
    b = (F.floor(F.col("timestamp") / F.lit(bucket_seconds)) * F.lit(bucket_seconds)).alias("bucket")
    agg = points.groupBy(*keys, b).agg(
        p_at_most(F.col("value"), latency_target, 0.99).alias("p99_ok"),
        (F.sum(F.when(F.col("metric_name") == error_metric, 1).otherwise(0)) / F.count(F.lit(1)))
        .alias("error_rate"))
    return (agg.withColumn("error_rate_ok", F.col("error_rate") < F.lit(ERROR_RATE_TARGET))
            .withColumn("slo_ok", F.col("p99_ok") & F.col("error_rate_ok")))


def alerts_with_hold(points: DataFrame, bucket_seconds: int, threshold: float, hold_buckets: int,
                     error_metric: str = "error", keys=("source",)) -> DataFrame:
    """D-9: alert when the error share exceeds ``threshold`` for at least
    ``hold_buckets`` consecutive buckets (gaps-and-islands over the
    aggregated bucket table; an empty bucket breaks a run). One row per
    alert: keys, first and last bucket of the run, run length."""
    b = F.floor(F.col("timestamp") / F.lit(bucket_seconds)).alias("b")
    rate = (points.groupBy(*keys, b)
            .agg((F.sum(F.when(F.col("metric_name") == error_metric, 1).otherwise(0))
                  / F.count(F.lit(1))).alias("err")))
    hot = rate.filter(F.col("err") > F.lit(threshold))
    w = Window.partitionBy(*keys).orderBy("b")
    islands = hot.withColumn("grp", F.col("b") - F.row_number().over(w))
    runs = islands.groupBy(*keys, "grp").agg(F.min("b").alias("b0"), F.max("b").alias("b1"),
                                             F.count(F.lit(1)).alias("buckets"))
    return (runs.filter(F.col("buckets") >= F.lit(hold_buckets))
            .select(*keys, (F.col("b0") * bucket_seconds).alias("start_ts"),
                    (F.col("b1") * bucket_seconds).alias("end_ts"), "buckets"))


def cardinality_audit(df: DataFrame, columns: list[str], limit: int = CARDINALITY_LIMIT,
                      rsd: float = 0.01) -> DataFrame:
    """D-10: approximate distinct count per label column (HyperLogLog++, one
    pass, fixed memory) and whether it exceeds the limit."""
    row = df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in columns])
    stacked = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(c).alias("approx_distinct")) for c in columns])).alias("s"))
    return stacked.select("s.label", "s.approx_distinct",
                          (F.col("s.approx_distinct") > F.lit(limit)).alias("violation"))


def list_predictions(predictions: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """D-14: newest-first page over prediction events (same clamps as the
    anomaly list)."""
    from vigil.operators.read_api import clamp_anomaly_page
    lim, off = clamp_anomaly_page(limit, offset)
    page = predictions.orderBy(F.col("timestamp").desc(), F.col("seq").desc())
    if off:
        page = page.offset(off)
    return page.limit(lim)


def trend_ttf(points: DataFrame, window: int, limit: float, chunk_seconds="auto") -> DataFrame:
    """D-13: least-squares slope of value over time across the last
    ``window`` points of the series (times centred on the current point for
    numerical stability) and time-to-failure = (limit - value) / slope when
    the trend rises toward a limit not yet reached. Adds ``slope`` (value
    units per second; NULL with fewer than 2 points or a flat time axis) and
    ``ttf_seconds``. Uses the detector's skew-safe framing."""
    from vigil.config import MadConfig
    from vigil.operators.mad import _normalize_keys, _window_frames, plan_chunks
    keys = list(SERIES_KEY)
    pts = _normalize_keys(points, keys)
    if isinstance(chunk_seconds, str) and chunk_seconds == "auto":
        chunk_seconds = plan_chunks(pts, keys)
    cfg = MadConfig(window_size=window, warmup=1).normalized()
    fr = _window_frames(pts, cfg, keys, True, chunk_seconds)

    def fold(arr):
        return F.aggregate(arr, F.lit(0.0), lambda a, b: a + b)

    t = F.transform("_frame", lambda e: (e["ts"] - F.col("timestamp")).cast("double"))
    v = F.transform("_frame", lambda e: e["v"])
    n = F.size("_frame").cast("double")
    st, sv = fold(t), fold(v)
    stv = fold(F.zip_with(t, v, lambda a, b: a * b))
    stt = fold(F.transform(t, lambda a: a * a))
    den = n * stt - st * st
    slope = F.when((n >= 2) & (den != 0), (n * stv - st * sv) / den)
    out = fr.withColumn("slope", slope).drop("_frame")
    ttf = F.when((F.col("slope") > 0) & (F.col("value") < F.lit(limit)),
                 (F.lit(limit) - F.col("value")) / F.col("slope"))
    return out.withColumn("ttf_seconds", ttf)


# --- fixed values (daily sequence format) ----------------------------------
DAILY_SEQ_MIN, DAILY_SEQ_SPAN = 1000, 10000   # start drawn from 1000..10999
# ---------------------------------------------------------------------------


def daily_sequence(df: DataFrame, tenant: str, *, target_chunk_rows: int = DEFAULT_TARGET_CHUNK_ROWS) -> DataFrame:
    """D-6: number each tenant's messages per UTC day in (timestamp, seq)
    order as ``YYYYMMDD:N``; N restarts every day at a per-(tenant, day)
    start in [1000, 10999] (derived from SHA-256 of ``tenant|YYYYMMDD``, so
    it is stable across reruns).

    Skew: a tenant-day of more than ``target_chunk_rows`` messages is cut by
    counts (``plan_chunks``: hours, seconds, ranges of ``seq``), so no task
    holds more than twice as many. The row number runs per chunk, and each
    chunk's offset comes from a small count table (a window over the chunks of
    one tenant-day)."""
    day = F.date_format(F.timestamp_seconds(F.col("timestamp")), "yyyyMMdd")
    base = df.withColumn("_day", F.coalesce(day, F.lit(""))).withColumn(tenant, F.coalesce(tenant, F.lit("")))
    plan = plan_chunks(base, [tenant, "_day"], target_chunk_rows)
    base = base.withColumn("_chunk", F.lit(0).cast("long")) if plan is None else _with_chunk(base, plan)
    base = base.withColumnRenamed("_chunk", "_dchunk")
    key = [tenant, "_day", "_dchunk"]
    w = Window.partitionBy(*key).orderBy("timestamp", "seq")
    ranked = base.withColumn("_lrn", F.row_number().over(w))
    wc = Window.partitionBy(tenant, "_day").orderBy("_dchunk")
    counts = (base.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(
                  F.sum("_n").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("_n"))
    start = F.lit(DAILY_SEQ_MIN) + F.pmod(
        F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(tenant), F.col("_day")), 256), 1, 8), 16, 10)
        .cast("long"), F.lit(DAILY_SEQ_SPAN))
    out = ranked.join(counts, key).withColumn(
        "daily_id", F.concat(F.col("_day"), F.lit(":"),
                             (start + F.col("_before") + F.col("_lrn") - 1).cast("string")))
    return out.drop("_day", "_dchunk", "_lrn", "_before")


def trace_lookup(events: DataFrame, trace_id: str) -> DataFrame:
    """D-11: events of one trace (equality filter, pushed to the scan)."""
    return events.filter(F.col("trace_id") == F.lit(trace_id))


def recent_errors(points: DataFrame, tenant: str, now_ts: int, window_s: int = 3600,
                  error_metric: str = "error", tenant_col: str = "source") -> DataFrame:
    """D-11: a tenant's error records in the last ``window_s`` seconds before
    ``now_ts`` (inclusive range, pushed-down filters)."""
    return points.filter((F.col(tenant_col) == F.lit(tenant))
                         & (F.col("metric_name") == F.lit(error_metric))
                         & F.col("timestamp").between(now_ts - window_s, now_ts))


def outbox_batch(outbox: DataFrame, after_id: int, batch: int = 100) -> DataFrame:
    """D-12: the next relay batch: unpublished rows (id above the published
    cursor) in id order, at most ``batch`` (a top-k, no full sort). Publishing
    is idempotent when the sink is keyed by ``id``."""
    return outbox.filter(F.col("id") > F.lit(after_id)).orderBy("id").limit(batch)


# --- fixed values (TTL dedup) -----------------------------------------------
TTL_DEDUP_SECONDS = 300            # duplicates are remembered for 5 minutes
# ---------------------------------------------------------------------------


def canonical_dedup_key(*cols: str) -> Column:
    """D-5: SHA-256 of the canonical identity fields joined by ``|``."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def ttl_dedup_stream(df: DataFrame, key_col: str, event_time_col: str,
                     ttl_seconds: int = TTL_DEDUP_SECONDS, seq_col: str | None = None) -> DataFrame:
    """D-5 (streaming): drop messages whose key was seen within the TTL, which
    runs from the key's last accepted message by the clock of the stream job.
    A message of a new key always passes, however late its event time is: no
    watermark drops it. Of copies within one micro-batch the one of least event
    time passes, and of those the one of least ``seq_col``, if it is given. State is one flag per key; copies are read as they come, so a
    storm of copies of one key costs no memory."""
    schema = df.schema
    order = [event_time_col, *([seq_col] if seq_col else [])]

    def first_only(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for pdf in batches:
            row = pdf.sort_values(order, kind="stable").head(1)
            if best is None or tuple(row[order].iloc[0]) < tuple(best[order].iloc[0]):
                best = row
        if best is not None and not state.exists:
            state.update((True,))
            state.setTimeoutDuration(int(ttl_seconds) * 1000)
            yield best

    return df.groupBy(key_col).applyInPandasWithState(
        first_only, schema, "seen boolean", "append", "ProcessingTimeTimeout")
