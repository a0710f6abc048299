"""DuckDB oracle SQL builders.

These are independent formulations of each query in plain SQL (window
``list()`` + ``list_sort`` for the detector, ``lag`` + running sums for
idle resets, ``arg_max``/``row_number`` for state), used to check the Spark
plans. Tables are the driver's pre-registered views.
"""

from __future__ import annotations

from vigil.config import MODE_BOTH, MODE_DOWN, MadConfig

MAD_CONSISTENCY = 1.4826  # the literal, so that a wrong constant of the engine shows

KEY_SQL = "source, metric_name, env, region"


def lit(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


# Metric view M-1 over ``events`` (same mapping as sources.tables).
EVENTS_POINTS = """
SELECT 'svc-' || CAST(user_id % 3 AS VARCHAR) AS source,
       event_type AS metric_name,
       CASE WHEN user_id % 3 = 2 THEN 'dev' ELSE 'prod' END AS env,
       CASE WHEN user_id % 3 = 0 THEN 'eu-central-1' ELSE 'us-east-1' END AS region,
       'user-' || CAST(user_id AS VARCHAR) AS instance_id,
       epoch_us(ts) // 1000000 AS timestamp,
       value,
       event_id AS seq
FROM events"""

LINEITEM_POINTS = """
SELECT 'supp-' || CAST(l_suppkey AS VARCHAR) AS source,
       'extendedprice' AS metric_name, 'prod' AS env, 'us-east-1' AS region,
       'order-' || CAST(l_orderkey AS VARCHAR) AS instance_id,
       epoch_us(l_shipdate) // 1000000 AS timestamp,
       l_extendedprice AS value,
       l_orderkey * 8 + l_linenumber AS seq
FROM lineitem"""


def _median(arr: str, n: str) -> str:
    return (f"CASE WHEN {n} = 0 THEN 0.0 WHEN {n} % 2 = 1 THEN {arr}[({n} + 1) // 2] "
            f"ELSE ({arr}[{n} // 2] + {arr}[{n} // 2 + 1]) / 2 END")


def mad_sql(points_sql: str, cfg: MadConfig, stale_gap: int | None = None) -> str:
    """A CTE chain ending in ``scored``: every point with n, baseline, mad,
    lower, upper, is_anomaly (and reset/epoch with a stale gap)."""
    cfg = cfg.normalized()
    w = cfg.window_size
    part = KEY_SQL
    pre = f"pts AS ({points_sql})"
    if stale_gap is not None:
        pre += f""",
gaps AS (
  SELECT *, COALESCE(timestamp - lag(timestamp) OVER (PARTITION BY {KEY_SQL} ORDER BY timestamp, seq)
                     > {int(stale_gap)}, false) AS reset
  FROM pts),
ep AS (
  SELECT *, SUM(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY_SQL} ORDER BY timestamp, seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch
  FROM gaps)"""
        src = "ep"
        part = KEY_SQL + ", epoch"
    else:
        src = "pts"
    mode = cfg.effective_mode
    if mode == MODE_DOWN:
        hit = "value < lo"
    elif mode == MODE_BOTH:
        hit = "(value > up OR value < lo)"
    else:
        hit = "value > up"
    if cfg.min_delta > 0:
        hit = f"({hit} AND NOT (abs(value - base) < {lit(cfg.min_delta)}))"
    return f"""WITH {pre},
win AS (
  SELECT *, list(value) OVER (PARTITION BY {part} ORDER BY timestamp, seq
                              ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS l
  FROM {src}),
s1 AS (SELECT *, CAST(len(l) AS INTEGER) AS n, list_sort(l) AS sl FROM win),
s2 AS (SELECT *, {_median('sl', 'n')} AS base FROM s1),
s3 AS (SELECT *, list_sort(list_transform(l, lambda x: abs(x - base))) AS dl FROM s2),
s4 AS (SELECT *, {_median('dl', 'n')} AS mad0 FROM s3),
s5 AS (SELECT *, CASE WHEN mad0 < {lit(cfg.min_mad)} THEN {lit(cfg.min_mad)} ELSE mad0 END AS madf FROM s4),
s6 AS (SELECT *, {lit(cfg.threshold_k)} * ({lit(MAD_CONSISTENCY)} * madf) AS delta FROM s5),
s7 AS (SELECT *, n < {cfg.warmup} AS warm, base + delta AS up, base - delta AS lo FROM s6),
scored AS (
  SELECT *,
         CASE WHEN warm THEN 0.0 ELSE base END AS baseline,
         CASE WHEN warm THEN 0.0 ELSE madf END AS mad,
         CASE WHEN warm THEN 0.0 ELSE lo END AS lower,
         CASE WHEN warm THEN 0.0 ELSE up END AS upper,
         (NOT warm AND {hit}) AS is_anomaly
  FROM s7)"""


# ------------------------------------------------------------ ingest/decode --
METRIC_REQUESTS = f"""
SELECT CASE WHEN seq % 89 = 0 THEN '' ELSE source END AS source,
       CASE WHEN seq % 101 = 0 THEN NULL ELSE metric_name END AS metric_name,
       CASE WHEN seq % 97 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN seq % 103 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS value,
       env, region, instance_id, timestamp, seq
FROM ({EVENTS_POINTS})"""

REQ_VALID = ("COALESCE(source, '') <> '' AND COALESCE(metric_name, '') <> '' "
             "AND isfinite(COALESCE(value, 0.0))")


# ------------------------------------------------------- anomaly pipeline --
FIXED_CLOCK = "2024-02-01T00:00:00Z"
PRODUCER = "vigil-detector"


def stamped_sql(cfg: MadConfig) -> str:
    """CTE chain ending in ``stamped``: anomaly events with deterministic ids."""
    return mad_sql(EVENTS_POINTS, cfg) + f""",
stamped AS (
  SELECT seq, source, metric_name, env, region, instance_id, timestamp, value, baseline, mad,
         CASE WHEN value < lower THEN lower ELSE upper END AS threshold,
         CAST(n AS BIGINT) AS window_size, {lit(cfg.threshold_k)} AS threshold_k,
         'MAD' AS detector,
         sha256(concat_ws('|', source, metric_name, env, region, instance_id,
                          CAST(timestamp AS VARCHAR), CAST(seq AS VARCHAR))) AS event_id,
         'anomaly.detected' AS event_type, CAST(2 AS BIGINT) AS event_version,
         '{PRODUCER}' AS producer, '{FIXED_CLOCK}' AS occurred_at, '{FIXED_CLOCK}' AS produced_at,
         '' AS trace_id
  FROM scored WHERE is_anomaly)"""


def decoded_sql(cfg: MadConfig, late: bool = False) -> str:
    """CTE chain ending in ``decoded`` (valid envelopes of the stand-in
    anomaly stream, with dedup keys) and ``quarantined``."""
    late_rows = ""
    if late:
        late_rows = """
  UNION ALL
  SELECT s.* REPLACE (sha256(event_id || ':late') AS event_id), seq + 2000000000 AS stream_seq,
         false AS v1, seq % 89 = 0 AS invalid, false AS malformed
  FROM stamped s WHERE seq % 7 = 0"""
    return stamped_sql(cfg) + f""",
sent AS (
  SELECT s.*, seq AS stream_seq, seq % 79 = 0 AS v1, seq % 89 = 0 AS invalid, seq % 97 = 0 AS malformed
  FROM stamped s
  UNION ALL
  SELECT s.*, seq + 1000000000 AS stream_seq, seq % 79 = 0 AS v1, seq % 89 = 0 AS invalid,
         seq % 97 = 0 AS malformed
  FROM stamped s WHERE seq % 83 = 0{late_rows}),
quarantined AS (
  SELECT stream_seq, CASE WHEN malformed THEN 'malformed payload' ELSE 'invalid envelope' END AS reason
  FROM sent WHERE malformed OR invalid),
decoded0 AS (
  SELECT stream_seq, 'anomaly.detected' AS subject, source, metric_name, env, region, instance_id,
         timestamp, value, baseline, mad, threshold, CAST(window_size AS INTEGER) AS window_size,
         threshold_k, detector,
         CASE WHEN v1 THEN '' ELSE event_id END AS event_id,
         CASE WHEN v1 THEN '' ELSE event_type END AS event_type,
         CASE WHEN v1 THEN '' ELSE producer END AS producer,
         CASE WHEN v1 THEN '' ELSE occurred_at END AS occurred_at,
         CASE WHEN v1 THEN '' ELSE produced_at END AS produced_at,
         '' AS trace_id,
         CAST(CASE WHEN v1 THEN 0 ELSE event_version END AS INTEGER) AS event_version
  FROM sent WHERE NOT malformed AND NOT invalid),
decoded AS (
  SELECT *, CASE WHEN event_id = '' THEN subject || ':' || CAST(stream_seq AS VARCHAR)
                 ELSE event_id END AS dedup_key
  FROM decoded0),
firsts AS (
  SELECT * FROM decoded QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY stream_seq) = 1),
events_t AS (
  SELECT stream_seq AS id, source, metric_name, env, region, instance_id, timestamp AS ts, value,
         baseline, mad, threshold, window_size, threshold_k, detector, producer, trace_id, event_id,
         event_type, event_version, occurred_at, produced_at, stream_seq
  FROM firsts),
state_t AS (
  SELECT source, metric_name, env, region, ts AS last_ts, value AS last_value, baseline, mad,
         threshold, window_size, threshold_k, detector, producer, trace_id, event_id, event_version,
         occurred_at, produced_at, stream_seq AS last_seq
  FROM events_t QUALIFY row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY stream_seq DESC) = 1)"""
