"""Named queries: each is a Spark plan over the driver tables plus (where SQL
can express it) an independent DuckDB formulation of the same result.

Doubles are rounded to 6 digits in both forms; every output carries ``seq``
or the series key so rows are unique.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.config import MODE_BOTH, MODE_DOWN, MODE_UP, MadConfig
from vigil.operators.mad import detect_anomalies, mad_detect, stale_resets_per_series
from vigil.plans import sql as S
from vigil.sources.tables import metric_points_from_events, metric_points_from_lineitem


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


SERVICE = MadConfig.service_defaults()
LIBRARY = MadConfig.library_defaults()
STALE_GAP_TEST = 6 * 3600  # idle gap used on the sparse test series

# ---------------------------------------------------------------- detector --
_STATS_OUT = ("seq", "n", "baseline", "mad", "lower", "upper", "is_anomaly")


def _stats_select(df: DataFrame) -> DataFrame:
    return df.select("seq", "n", r6("baseline"), r6("mad"), r6("lower"), r6("upper"),
                     "is_anomaly")


_STATS_SQL_SELECT = ("SELECT seq, n, round(baseline, 6) AS baseline, round(mad, 6) AS mad, "
                     "round(lower, 6) AS lower, round(upper, 6) AS upper, is_anomaly FROM scored")


@register("mad_stats", S.mad_sql(S.EVENTS_POINTS, SERVICE) + "\n" + _STATS_SQL_SELECT)
def q_mad_stats(spark, sf):
    """Window statistics for every point (service defaults: W 50, warm-up 20,
    K 3, BOTH, min MAD 1, deadband 10)."""
    return _stats_select(mad_detect(metric_points_from_events(spark, sf), SERVICE))


@register("mad_chunked", S.mad_sql(S.EVENTS_POINTS, SERVICE) + "\n" + _STATS_SQL_SELECT)
def q_mad_chunked(spark, sf):
    """Same statistics through the skew-safe plan: series cut into one-day
    chunks with exact halos (chunks hold fewer than W points, so halos reach
    back over several chunks). Must equal ``mad_stats``."""
    return _stats_select(mad_detect(metric_points_from_events(spark, sf), SERVICE,
                                    chunk_seconds=86400))


# Uneven series, cut by the planned chunks (tens of points per chunk, so that
# every level of the plan is used): name -> (SQL, Spark) form of the timestamp.
_UNEVEN = {
    "mad_hot_stray": ("CASE WHEN seq % 500 = 0 THEN 0 ELSE timestamp END", 60),
    "mad_hot_second": ("timestamp - timestamp % 1000000", 40),
    "mad_hot_burst": ("CASE WHEN seq % 2 = 0 THEN timestamp ELSE 1704067200 + timestamp % 3600 END", 50),
}


def _register_uneven(name: str, expr: str, target: int) -> None:
    points = f"SELECT * REPLACE (CAST({expr} AS BIGINT) AS timestamp) FROM ({S.EVENTS_POINTS})"

    @register(name, S.mad_sql(points, SERVICE) + "\n" + _STATS_SQL_SELECT)
    def query(spark, sf):
        pts = metric_points_from_events(spark, sf).withColumn("timestamp", F.expr(expr).cast("long"))
        return _stats_select(mad_detect(pts, SERVICE, target_chunk_rows=target))

    query.__doc__ = f"Window statistics of series whose time is uneven ({expr}), cut into chunks of ~{target} points."


for _name, (_expr, _target) in _UNEVEN.items():
    _register_uneven(_name, _expr, _target)


# Windows of thousands of points: the MAD over the window is DuckDB's own.
_LARGE = SERVICE.with_(window_size=5000, warmup=500)
_LARGE_SQL = f"""WITH pts AS ({S.EVENTS_POINTS}),
w AS (SELECT *, CAST(least(row_number() OVER k, 5000) AS INTEGER) AS n, median(value) OVER f AS base, mad(value) OVER f AS mad0
      FROM pts WINDOW k AS (PARTITION BY source ORDER BY timestamp, seq),
                      f AS (PARTITION BY source ORDER BY timestamp, seq ROWS BETWEEN 4999 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, greatest(mad0, 1.0::DOUBLE) AS m, 3.0::DOUBLE * (1.4826::DOUBLE * greatest(mad0, 1.0::DOUBLE)) AS delta FROM w)
SELECT seq, n, CASE WHEN n < 500 THEN 0.0 ELSE round(base, 6) END AS baseline, CASE WHEN n < 500 THEN 0.0 ELSE round(m, 6) END AS mad,
       CASE WHEN n < 500 THEN 0.0 ELSE round(base - delta, 6) END AS lower, CASE WHEN n < 500 THEN 0.0 ELSE round(base + delta, 6) END AS upper,
       n >= 500 AND (value > base + delta OR value < base - delta) AND NOT abs(value - base) < 10 AS is_anomaly FROM d"""


@register("mad_window_5000", _LARGE_SQL)
def q_mad_window_5000(spark, sf):
    """Window statistics of each service's points over 5,000 points, by the
    incremental engine."""
    return _stats_select(mad_detect(metric_points_from_events(spark, sf), _LARGE, keys=["source"], engine="rolling"))


@register("mad_window_5000_chunked", _LARGE_SQL)
def q_mad_window_5000_chunked(spark, sf):
    """The same with series cut into chunks by rank (of twice the window)."""
    return _stats_select(mad_detect(metric_points_from_events(spark, sf), _LARGE, keys=["source"], engine="rolling",
                                    target_chunk_rows=100))


# Sequence numbers far apart, most of them within one second.
_SPARSE_SQL = f"""SELECT * REPLACE (CASE WHEN seq % 10 < 8 THEN 1704067200 ELSE timestamp END AS timestamp,
                  seq * 1000003 AS seq) FROM ({S.EVENTS_POINTS})"""


def _sparse_points(spark, sf):
    pts = metric_points_from_events(spark, sf)
    second = F.when(F.col("seq") % 10 < 8, F.lit(1704067200).cast("long")).otherwise(F.col("timestamp"))
    return pts.withColumn("timestamp", second).withColumn("seq", F.col("seq") * F.lit(1000003).cast("long"))


@register("mad_sparse_seq", S.mad_sql(_SPARSE_SQL, SERVICE) + "\n" + _STATS_SQL_SELECT)
def q_mad_sparse_seq(spark, sf):
    """Window statistics where most points share a second and their sequence
    numbers are far apart, cut by quantiles of the sequence."""
    return _stats_select(mad_detect(_sparse_points(spark, sf), SERVICE, target_chunk_rows=50))


@register("mad_sparse_seq_rolling", S.mad_sql(_SPARSE_SQL, SERVICE) + "\n" + _STATS_SQL_SELECT)
def q_mad_sparse_seq_rolling(spark, sf):
    """The same by the incremental engine, cut by rank."""
    return _stats_select(mad_detect(_sparse_points(spark, sf), SERVICE, engine="rolling", target_chunk_rows=100))


_ANOM_OUT_SQL = ("SELECT seq, source, metric_name, env, region, instance_id, timestamp, "
                 "round(value, 6) AS value, n, round(baseline, 6) AS baseline, round(mad, 6) AS mad, "
                 "round(CASE WHEN value < lower THEN lower ELSE upper END, 6) AS threshold "
                 "FROM scored WHERE is_anomaly")


def _anom_select(df: DataFrame) -> DataFrame:
    return df.select("seq", "source", "metric_name", "env", "region", "instance_id", "timestamp",
                     r6("value"), "n", r6("baseline"), r6("mad"), r6("threshold"))


def _mode_cfg(mode: str) -> MadConfig:
    return SERVICE.with_(mode=mode)


@register("mad_up", S.mad_sql(S.EVENTS_POINTS, _mode_cfg(MODE_UP)) + "\n" + _ANOM_OUT_SQL)
def q_mad_up(spark, sf):
    """Upward spikes (service defaults with MODE_UP)."""
    return _anom_select(detect_anomalies(metric_points_from_events(spark, sf), _mode_cfg(MODE_UP)))


_DOWN_POINTS = f"SELECT * REPLACE (500 - value AS value) FROM ({S.EVENTS_POINTS})"


@register("mad_down", S.mad_sql(_DOWN_POINTS, _mode_cfg(MODE_DOWN)) + "\n" + _ANOM_OUT_SQL)
def q_mad_down(spark, sf):
    """Downward dips, MODE_DOWN, on the mirrored series ``500 - value``."""
    pts = metric_points_from_events(spark, sf).withColumn("value", F.lit(500.0) - F.col("value"))
    return _anom_select(detect_anomalies(pts, _mode_cfg(MODE_DOWN)))


_BOTH_POINTS = (f"SELECT * REPLACE (CASE WHEN seq % 2 = 0 THEN value ELSE -value END AS value) "
                f"FROM ({S.EVENTS_POINTS})")


@register("mad_both", S.mad_sql(_BOTH_POINTS, _mode_cfg(MODE_BOTH)) + "\n" + _ANOM_OUT_SQL)
def q_mad_both(spark, sf):
    """Both directions on a series whose odd points are negated."""
    pts = metric_points_from_events(spark, sf).withColumn(
        "value", F.when(F.col("seq") % 2 == 0, F.col("value")).otherwise(-F.col("value")))
    return _anom_select(detect_anomalies(pts, _mode_cfg(MODE_BOTH)))


@register("mad_library_defaults", S.mad_sql(S.EVENTS_POINTS, LIBRARY) + "\n" + _ANOM_OUT_SQL)
def q_mad_library(spark, sf):
    """Library defaults: W 50, warm-up 20, K 6, UP, min MAD 1, no deadband."""
    return _anom_select(detect_anomalies(metric_points_from_events(spark, sf), LIBRARY))


_WARM = MadConfig(window_size=30, warmup=45, threshold_k=2.0, mode=MODE_BOTH).normalized()


@register("mad_warmup", S.mad_sql(S.EVENTS_POINTS, _WARM) +
          "\nSELECT seq, n, round(baseline, 6) AS baseline, is_anomaly FROM scored")
def q_mad_warmup(spark, sf):
    """Warm-up gate with warm-up > window (capped to W = 30): n grows 1..30,
    statistics are 0 until n reaches 30."""
    df = mad_detect(metric_points_from_events(spark, sf), _WARM)
    return df.select("seq", "n", r6("baseline"), "is_anomaly")


_DEADBAND = SERVICE.with_(mode=MODE_UP, min_delta=150.0)


@register("mad_deadband", S.mad_sql(S.EVENTS_POINTS, _DEADBAND) + "\n" + _ANOM_OUT_SQL)
def q_mad_deadband(spark, sf):
    """Deadband of 150: spikes closer than 150 to the baseline are ignored."""
    return _anom_select(detect_anomalies(metric_points_from_events(spark, sf), _DEADBAND))


_FLOOR = SERVICE.with_(min_mad=25.0, min_delta=0.0)


@register("mad_floor", S.mad_sql(S.EVENTS_POINTS, _FLOOR) +
          "\nSELECT seq, n, round(mad, 6) AS mad, round(upper, 6) AS upper, is_anomaly FROM scored")
def q_mad_floor(spark, sf):
    """MAD floor of 25: the floored MAD is reported and widens the bounds."""
    df = mad_detect(metric_points_from_events(spark, sf), _FLOOR)
    return df.select("seq", "n", r6("mad"), r6("upper"), "is_anomaly")


@register("mad_stale_reset", S.mad_sql(S.EVENTS_POINTS, SERVICE, STALE_GAP_TEST) +
          "\nSELECT seq, reset, n, round(baseline, 6) AS baseline, is_anomaly FROM scored")
def q_mad_stale_reset(spark, sf):
    """Idle-series reset: a series silent for more than 6 h starts a fresh
    window (and warms up again)."""
    df = mad_detect(metric_points_from_events(spark, sf), SERVICE,
                    stale_gap_seconds=STALE_GAP_TEST)
    return df.select("seq", "reset", "n", r6("baseline"), "is_anomaly")


@register("mad_stale_reset_chunked", S.mad_sql(S.EVENTS_POINTS, SERVICE, STALE_GAP_TEST) +
          "\nSELECT seq, reset, n, round(baseline, 6) AS baseline, is_anomaly FROM scored")
def q_mad_stale_reset_chunked(spark, sf):
    """``mad_stale_reset`` through the chunked (skew-safe) plan."""
    df = mad_detect(metric_points_from_events(spark, sf), SERVICE,
                    stale_gap_seconds=STALE_GAP_TEST, chunk_seconds=86400)
    return df.select("seq", "reset", "n", r6("baseline"), "is_anomaly")


@register("stale_series_count", S.mad_sql(S.EVENTS_POINTS, SERVICE, STALE_GAP_TEST) +
          f"\nSELECT {S.KEY_SQL}, CAST(SUM(CASE WHEN reset THEN 1 ELSE 0 END) AS BIGINT) AS resets, "
          f"COUNT(*) AS points FROM scored GROUP BY {S.KEY_SQL}")
def q_stale_series_count(spark, sf):
    """Idle resets per series at a 6 h gap."""
    df = mad_detect(metric_points_from_events(spark, sf), SERVICE,
                    stale_gap_seconds=STALE_GAP_TEST)
    return stale_resets_per_series(df)


@register("mad_lineitem", S.mad_sql(S.LINEITEM_POINTS, SERVICE) + "\n" + _ANOM_OUT_SQL)
def q_mad_lineitem(spark, sf):
    """Detector over 1,000 supplier series built from ``lineitem``."""
    return _anom_select(detect_anomalies(metric_points_from_lineitem(spark, sf), SERVICE))


# ------------------------------------------------------------------ ingest --
from vigil.operators.envelope import decode_envelope  # noqa: E402
from vigil.operators.ingest import decode_metric_json, ingest_metrics, ml_payload_filter  # noqa: E402
from vigil.operators.projection import (first_wins, fold_series_state,  # noqa: E402
                                        to_anomaly_events, with_dedup_key)
from vigil.operators.read_api import get_series_state, list_anomalies, list_series  # noqa: E402
from vigil.sources import fixtures as FX  # noqa: E402

_POINT_OUT = ("seq", "source", "metric_name", "env", "region", "instance_id", "timestamp")


@register("ingest_accepted", f"SELECT seq, source, metric_name, env, region, instance_id, timestamp, "
          f"round(value, 6) AS value FROM ({S.METRIC_REQUESTS}) WHERE {S.REQ_VALID}")
def q_ingest_accepted(spark, sf):
    """Metric requests that pass validation (non-empty source and metric
    name, finite value)."""
    acc, _ = ingest_metrics(FX.metric_requests(spark, sf))
    return acc.select(*_POINT_OUT, r6("value"))


@register("ingest_rejected", "SELECT seq, CASE WHEN COALESCE(source, '') = '' OR "
          "COALESCE(metric_name, '') = '' THEN 'invalid metric' ELSE 'non-finite value' END AS reason "
          f"FROM ({S.METRIC_REQUESTS}) WHERE NOT ({S.REQ_VALID})")
def q_ingest_rejected(spark, sf):
    """Rejected metric requests with the reason."""
    _, rej = ingest_metrics(FX.metric_requests(spark, sf))
    return rej.select("seq", "reason")


# the stand-in payloads with a wrongly typed field (see sources.fixtures): the
# first rule that fits a row decides
_TYPED_BAD = "(CASE WHEN seq % 83 = 0 THEN false WHEN seq % 79 = 0 OR seq % 73 = 0 OR seq % 71 = 0 THEN true " \
    "WHEN seq % 67 = 0 THEN false ELSE seq % 61 = 0 OR seq % 59 = 0 OR seq % 53 = 0 END)"
_DECODE_OK = f"(seq % 97 <> 0 AND seq % 89 <> 0 AND NOT {_TYPED_BAD})"


@register("decode_metrics", f"""SELECT seq, source, metric_name,
  CASE WHEN seq % 83 = 0 THEN '' ELSE env END AS env,
  CASE WHEN seq % 83 = 0 OR seq % 67 = 0 THEN '' ELSE region END AS region,
  CASE WHEN seq % 83 = 0 THEN '' ELSE instance_id END AS instance_id,
  CASE WHEN seq % 83 = 0 THEN 0 ELSE timestamp END AS timestamp,
  CASE WHEN seq % 83 = 0 THEN 0.0 ELSE round(value, 6) END AS value
FROM ({S.EVENTS_POINTS}) WHERE {_DECODE_OK}""")
def q_decode_metrics(spark, sf):
    """Metric stream payloads decoded; missing fields take zero values."""
    pts, _ = decode_metric_json(FX.metric_payloads(spark, sf))
    return pts.select(*_POINT_OUT, r6("value"))


@register("decode_quarantine", "SELECT seq, 'malformed payload' AS reason "
          f"FROM ({S.EVENTS_POINTS}) WHERE NOT ({_DECODE_OK})")
def q_decode_quarantine(spark, sf):
    """Payloads that are not valid JSON or carry a wrongly typed field."""
    _, bad = decode_metric_json(FX.metric_payloads(spark, sf))
    return bad.select("seq", "reason")


def _texts_sql() -> str:
    """CTEs ``t`` (seq, payload) of the payload texts, and ``fields``: every
    key of every text that is one JSON object, read from the text."""
    text = "CASE seq % 16 " + " ".join(f"WHEN {k} THEN '" + t.replace("'", "''") + "'" for k, t in enumerate(FX.PAYLOAD_TEXTS)) + " END"
    for mark, value in (("{s}", "source"), ("{m}", "metric_name"), ("{v}", "CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)"),
                        ("{t}", "CAST(timestamp AS VARCHAR)")):
        text = f"replace({text}, '{mark}', {value})"
    return f"""WITH t AS (SELECT seq, {text} AS payload FROM ({S.EVENTS_POINTS})),
ok AS (SELECT seq, payload FROM t WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
fields AS (SELECT ok.seq, j.key AS k, j.type AS kind, j.value AS v, j.id AS pos FROM ok, json_each(ok.payload) j),
typed AS (SELECT seq FROM ok WHERE seq NOT IN (SELECT seq FROM fields WHERE
            (k IN ('source', 'metric_name', 'env', 'region', 'instance_id') AND kind NOT IN ('VARCHAR', 'NULL'))
            OR (k IN ('value', 'timestamp') AND kind NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL')))),
last AS (SELECT seq, k, arg_max(CAST(v AS VARCHAR), pos) AS v, arg_max(kind, pos) AS kind FROM fields GROUP BY seq, k)"""


def _field_sql(k: str) -> str:
    return f"max(CASE WHEN k = '{k}' THEN v END)"


@register("decode_payload_text", _texts_sql() + f""",
points AS (SELECT seq, coalesce(json_extract_string({_field_sql('source')}, '$'), '') AS source,
       coalesce(json_extract_string({_field_sql('metric_name')}, '$'), '') AS metric_name,
       coalesce(CAST({_field_sql('timestamp')} AS BIGINT), 0) AS timestamp, coalesce(CAST({_field_sql('value')} AS DOUBLE), 0.0) AS value
  FROM last SEMI JOIN typed USING (seq) GROUP BY seq)
SELECT * FROM points UNION ALL SELECT seq, '', '', 0, 0.0 FROM t WHERE trim(payload) = 'null'""")
def q_decode_payload_text(spark, sf):
    """Payloads that are, or nearly are, one JSON object: the accepted ones.
    The oracle parses the texts."""
    pts, _ = decode_metric_json(FX.payload_texts(spark, sf))
    return pts.select("seq", "source", "metric_name", "timestamp", "value")


@register("decode_payload_rejected", _texts_sql() + """
SELECT seq, payload, 'malformed payload' AS reason FROM t ANTI JOIN typed USING (seq) WHERE trim(payload) <> 'null'""")
def q_decode_payload_rejected(spark, sf):
    """The rejected ones, with their payloads."""
    _, bad = decode_metric_json(FX.payload_texts(spark, sf))
    return bad.select("seq", "payload", "reason")


@register("ml_payload_text", _texts_sql() + f"""
SELECT seq, json_extract_string({_field_sql('metric_name')}, '$') AS metric_name, CAST({_field_sql('value')} AS DOUBLE) AS value
FROM last GROUP BY seq HAVING max(CASE WHEN k = 'value' THEN kind END) IN ('BIGINT', 'UBIGINT', 'DOUBLE')""")
def q_ml_payload_text(spark, sf):
    """The same texts at the model-scoring intake, where the last of repeated
    keys stands."""
    keep, _ = ml_payload_filter(FX.payload_texts(spark, sf))
    return keep.select("seq", "metric_name", "value")


@register("envelope_payload_text", _texts_sql() + f""",
found AS (SELECT seq, coalesce(json_extract_string({_field_sql('source')}, '$'), '') AS source,
       coalesce(json_extract_string({_field_sql('metric_name')}, '$'), '') AS metric_name,
       coalesce(CAST({_field_sql('value')} AS DOUBLE), 0.0) AS value
  FROM last SEMI JOIN typed USING (seq) GROUP BY seq)
SELECT t.seq AS stream_seq, CASE WHEN f.metric_name <> '' THEN f.source ELSE '' END AS source, CASE WHEN f.source <> '' AND f.metric_name <> '' THEN f.value END AS value,
       CASE WHEN f.source <> '' AND f.metric_name <> '' AND t.seq // 16 % 2 = 1 THEN 'e' || t.seq ELSE '' END AS event_id,
       CASE WHEN f.source <> '' AND f.metric_name <> '' THEN 'ok'
            WHEN trim(payload) = 'null' OR f.seq IS NOT NULL THEN 'invalid envelope' ELSE 'malformed payload' END AS result
FROM t LEFT JOIN found f USING (seq)""")
def q_envelope_payload_text(spark, sf):
    """The same texts as flat envelopes and inside version-2 envelopes."""
    good, bad = decode_envelope(FX.envelope_texts(spark, sf))
    return good.select("stream_seq", "source", "value", "event_id", F.lit("ok").alias("result")).unionByName(
        bad.select("stream_seq", F.lit("").alias("source"), F.lit(None).cast("double").alias("value"),
                   F.lit("").alias("event_id"), F.col("reason").alias("result")))


_FIRST_RULE = "CASE WHEN seq % 79 = 0 OR seq % 73 = 0 OR seq % 71 = 0 OR seq % 67 = 0 THEN 0 " \
    "WHEN seq % 61 = 0 THEN 61 WHEN seq % 59 = 0 THEN 59 ELSE 0 END"


@register("ml_payload_filter", f"""SELECT seq, CASE WHEN {_FIRST_RULE} = 61 THEN '7' ELSE metric_name END AS metric_name,
  round(value, 6) AS value, CASE WHEN {_FIRST_RULE} = 59 THEN NULL ELSE timestamp END AS timestamp
FROM ({S.EVENTS_POINTS}) WHERE seq % 97 <> 0 AND seq % 89 <> 0 AND seq % 83 <> 0""")
def q_ml_payload_filter(spark, sf):
    """Model-scoring intake: payloads with a present, numeric value, whatever
    their other fields hold."""
    keep, _ = ml_payload_filter(FX.metric_payloads(spark, sf))
    return keep.select("seq", "metric_name", r6("value"), "timestamp")


# -------------------------------------------------------- anomaly pipeline --
_EV_OUT_SQL = ("seq, source, metric_name, env, region, instance_id, timestamp, round(value, 6) AS value, "
               "round(baseline, 6) AS baseline, round(mad, 6) AS mad, round(threshold, 6) AS threshold, "
               "window_size, round(threshold_k, 6) AS threshold_k, detector, event_id, event_type, "
               "event_version, producer, trace_id")


@register("anomaly_events", S.stamped_sql(SERVICE) + f"\nSELECT {_EV_OUT_SQL} FROM stamped")
def q_anomaly_events(spark, sf):
    """Detector anomalies stamped as events (deterministic SHA-256 ids,
    stored threshold = the crossed bound)."""
    ev = FX.anomaly_events_stamped(spark, sf, SERVICE)
    return ev.select("seq", "source", "metric_name", "env", "region", "instance_id", "timestamp",
                     r6("value"), r6("baseline"), r6("mad"), r6("threshold"), "window_size",
                     r6("threshold_k"), "detector", "event_id", "event_type", "event_version",
                     "producer", "trace_id")


def _decoded(spark, sf, late=False):
    ev = FX.stored_anomaly_events(spark, sf, SERVICE)
    stream = FX.anomaly_stream(spark, sf, SERVICE, ev)
    if late:
        stream = stream.unionByName(FX.late_resends(spark, sf, SERVICE, ev))
    return decode_envelope(stream)


_DTO_OUT = ("stream_seq", "subject", "source", "metric_name", "env", "region", "instance_id",
            "timestamp", "window_size", "detector", "event_id", "event_type", "producer",
            "occurred_at", "produced_at", "trace_id", "event_version")
_DTO_SQL = (", ".join(_DTO_OUT) + ", round(value, 6) AS value, round(baseline, 6) AS baseline, "
            "round(mad, 6) AS mad, round(threshold, 6) AS threshold, round(threshold_k, 6) AS threshold_k")


def _dto_select(df):
    return df.select(*_DTO_OUT, r6("value"), r6("baseline"), r6("mad"), r6("threshold"),
                     r6("threshold_k"))


@register("envelope_roundtrip", S.decoded_sql(SERVICE) + f"\nSELECT {_DTO_SQL} FROM decoded")
def q_envelope_roundtrip(spark, sf):
    """Anomaly events encoded as V2(+flat) / V1 envelopes, delivered (some
    twice) and decoded back to flat rows."""
    dec, _ = _decoded(spark, sf)
    return _dto_select(dec)


@register("envelope_v1_fallback", S.decoded_sql(SERVICE) +
          "\nSELECT stream_seq, dedup_key, source, metric_name, round(value, 6) AS value, event_id, "
          "event_type, event_version FROM decoded WHERE event_type = ''")
def q_envelope_v1(spark, sf):
    """Flat (V1) envelopes: event metadata defaults to ''/0 and the dedup key
    falls back to subject:stream_seq."""
    dec, _ = _decoded(spark, sf)
    return (with_dedup_key(dec).filter(F.col("event_type") == "")
            .select("stream_seq", "dedup_key", "source", "metric_name", r6("value"), "event_id",
                    "event_type", "event_version"))


@register("envelope_invalid", S.decoded_sql(SERVICE) + "\nSELECT stream_seq, reason FROM quarantined")
def q_envelope_invalid(spark, sf):
    """Envelopes rejected as malformed JSON or invalid (empty source)."""
    _, bad = _decoded(spark, sf)
    return bad.select("stream_seq", "reason")


@register("dedup_first", S.decoded_sql(SERVICE) +
          "\nSELECT dedup_key, MIN(stream_seq) AS stream_seq, COUNT(*) AS deliveries "
          "FROM decoded GROUP BY dedup_key")
def q_dedup_first(spark, sf):
    """First-wins de-duplication: one row per dedup key with the earliest
    delivery's stream sequence."""
    dec, _ = _decoded(spark, sf)
    return first_wins(with_dedup_key(dec), with_deliveries=True).select(
        "dedup_key", "stream_seq", "deliveries")


def _events(spark, sf, late=False):
    dec, _ = _decoded(spark, sf, late)
    return to_anomaly_events(first_wins(with_dedup_key(dec)), created_at=FX.FIXED_CLOCK)


def _state(spark, sf, late=False):
    return fold_series_state(_events(spark, sf, late), updated_at=FX.FIXED_CLOCK)


_models: dict[tuple[str, str], str] = {}


def _read_model(spark, sf):
    """Folder of the stored read model of the stand-in anomaly stream, written
    once per application and input: ``anomaly_events``, partitioned by
    ``event_date`` and sorted by time within it, and ``series_state``. The read
    queries scan these tables, as a service would."""
    from vigil.session import fresh_subdir
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        base = fresh_subdir(spark, "read-model")
        events = FX.store(_events(spark, sf), "read-events")
        (events.repartition("event_date").sortWithinPartitions("event_date", "ts", "id")
         .write.partitionBy("event_date").parquet(f"{base}/anomaly_events"))
        fold_series_state(events, updated_at=FX.FIXED_CLOCK).write.parquet(f"{base}/series_state")
        _models[key] = base
    return _models[key]


def _stored_events(spark, sf):
    return spark.read.parquet(f"{_read_model(spark, sf)}/anomaly_events")


def _stored_state(spark, sf):
    return spark.read.parquet(f"{_read_model(spark, sf)}/series_state")


_STATE_SQL = (f"{S.KEY_SQL}, last_ts, round(last_value, 6) AS last_value, round(baseline, 6) AS baseline, "
              "round(mad, 6) AS mad, round(threshold, 6) AS threshold, window_size, "
              "round(threshold_k, 6) AS threshold_k, detector, producer, trace_id, event_id, "
              "event_version, occurred_at, produced_at, last_seq")


def _state_select(st):
    return st.select("source", "metric_name", "env", "region", "last_ts", r6("last_value"),
                     r6("baseline"), r6("mad"), r6("threshold"), "window_size", r6("threshold_k"),
                     "detector", "producer", "trace_id", "event_id", "event_version", "occurred_at",
                     "produced_at", "last_seq")


@register("series_state", S.decoded_sql(SERVICE) + f"\nSELECT {_STATE_SQL} FROM state_t")
def q_series_state(spark, sf):
    """Latest state per series folded from the de-duplicated events (last
    arrival wins)."""
    return _state_select(_state(spark, sf))


@register("series_state_late_arrival", S.decoded_sql(SERVICE, late=True) +
          f"\nSELECT {_STATE_SQL} FROM state_t")
def q_series_state_late(spark, sf):
    """State when older events are re-sent last: arrival order wins over
    timestamps."""
    return _state_select(_state(spark, sf, late=True))


# ------------------------------------------------------------ read queries --
_LIST_OUT = ("id", "source", "metric_name", "env", "region", "instance_id", "ts", "window_size",
             "detector", "producer", "trace_id", "event_id")
_LIST_SQL = (", ".join(_LIST_OUT) + ", round(value, 6) AS value, round(baseline, 6) AS baseline, "
             "round(mad, 6) AS mad, round(threshold, 6) AS threshold, round(threshold_k, 6) AS threshold_k")


def _list_select(df):
    return df.select(*_LIST_OUT, r6("value"), r6("baseline"), r6("mad"), r6("threshold"),
                     r6("threshold_k"))


def _list_sql(where: str = "", limit: int = 100, offset: int = 0) -> str:
    w = f"WHERE {where}" if where else ""
    return (S.decoded_sql(SERVICE) + f"\nSELECT {_LIST_SQL} FROM events_t {w} "
            f"ORDER BY ts DESC, id DESC LIMIT {limit} OFFSET {offset}")


@register("list_anomalies", _list_sql())
def q_list_anomalies(spark, sf):
    """Newest-first anomaly page with default parameters (limit 100)."""
    return _list_select(list_anomalies(_stored_events(spark, sf)))


@register("list_anomalies_filtered", _list_sql("source = 'svc-1' AND metric_name = 'click'"))
def q_list_anomalies_filtered(spark, sf):
    """Page filtered on source and metric; empty-string parameters are
    ignored (env='' means no env filter)."""
    return _list_select(list_anomalies(_stored_events(spark, sf), source="svc-1", metric_name="click", env=""))


_FROM_TS, _TO_TS = 1704844800, 1705708800  # 2024-01-10 .. 2024-01-20 (UTC), inclusive


@register("list_anomalies_time_range", _list_sql(f"ts >= {_FROM_TS} AND ts <= {_TO_TS}", limit=1000))
def q_list_anomalies_time_range(spark, sf):
    """Inclusive time range with the maximum page size."""
    return _list_select(list_anomalies(_stored_events(spark, sf), from_ts=_FROM_TS, to_ts=_TO_TS, limit=1000))


@register("list_anomalies_text_bounds", _list_sql(f"ts >= {_FROM_TS}", limit=1000))
def q_list_anomalies_text_bounds(spark, sf):
    """Time bounds as request text: a bound that is no number is not given,
    nor is an empty or out-of-range page parameter."""
    return _list_select(list_anomalies(_stored_events(spark, sf), from_ts=f"{_FROM_TS}", to_ts="tomorrow",
                                       limit="1000", offset="x"))


@register("list_anomalies_page2", _list_sql(limit=50, offset=50))
def q_list_anomalies_page2(spark, sf):
    """Second page of 50."""
    return _list_select(list_anomalies(_stored_events(spark, sf), limit=50, offset=50))


@register("list_anomalies_clamped", _list_sql(limit=1000, offset=0))
def q_list_anomalies_clamped(spark, sf):
    """limit 5000 is clamped to 1000 and offset -5 to 0."""
    return _list_select(list_anomalies(_stored_events(spark, sf), limit=5000, offset=-5))


_SERIES_OUT_SQL = (f"{S.KEY_SQL}, last_ts, round(last_value, 6) AS last_value, "
                   "round(baseline, 6) AS baseline, round(mad, 6) AS mad, round(threshold, 6) AS threshold, "
                   "window_size, round(threshold_k, 6) AS threshold_k, detector, producer, trace_id, "
                   f"'{FX.FIXED_CLOCK}' AS updated_at")


def _series_select(df):
    return df.select("source", "metric_name", "env", "region", "last_ts", r6("last_value"),
                     r6("baseline"), r6("mad"), r6("threshold"), "window_size", r6("threshold_k"),
                     "detector", "producer", "trace_id", "updated_at")


@register("list_series", S.decoded_sql(SERVICE) +
          f"\nSELECT {_SERIES_OUT_SQL} FROM state_t ORDER BY last_seq DESC LIMIT 200")
def q_list_series(spark, sf):
    """Series state page, most recently updated first (default limit 200)."""
    return _series_select(list_series(_stored_state(spark, sf)))


@register("list_series_filtered", S.decoded_sql(SERVICE) +
          f"\nSELECT {_SERIES_OUT_SQL} FROM state_t WHERE env = 'prod' ORDER BY last_seq DESC LIMIT 5")
def q_list_series_filtered(spark, sf):
    """Series page filtered on env with limit 5."""
    return _series_select(list_series(_stored_state(spark, sf), env="prod", limit=5))


@register("get_series_state", S.decoded_sql(SERVICE) +
          f"\nSELECT {_SERIES_OUT_SQL} FROM state_t WHERE source = 'svc-1' AND metric_name = 'click' "
          "AND env = 'prod' AND region = 'us-east-1'")
def q_get_series_state(spark, sf):
    """Point lookup by the composite key ``svc-1|click|prod|us-east-1``."""
    return _series_select(get_series_state(_stored_state(spark, sf), "svc-1|click|prod|us-east-1"))


@register("get_series_state_missing", S.decoded_sql(SERVICE) +
          f"\nSELECT {_SERIES_OUT_SQL} FROM state_t WHERE source = 'svc-9' AND metric_name = 'click' "
          "AND env = 'prod' AND region = 'us-east-1'")
def q_get_series_state_missing(spark, sf):
    """Lookup of a series that has no state: zero rows."""
    return _series_select(get_series_state(_stored_state(spark, sf), "svc-9|click|prod|us-east-1"))


# --------------------------------------------------------------- streaming --
from vigil.schemas import SERIES_KEY as SERIES_KEY_COLUMNS  # noqa: E402
from vigil.session import fresh_subdir, store_table  # noqa: E402
from vigil.sources.tables import events_to_points, read_table  # noqa: E402
from vigil.streaming.detector import stream_mad_detect  # noqa: E402
from vigil.streaming.jobs import anomaly_stream as read_anomaly_stream  # noqa: E402
from vigil.streaming.jobs import project_stream, stream_to_parquet  # noqa: E402


def _file_or_folder(spark, sf, name):
    """A path glob that lists the files of a table, be it one file or a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf.rstrip('/')}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return f"{sf.rstrip('/')}/{name}.parquet" if folder else f"{sf.rstrip('/')}/{name}.parquet*"


def _event_stream(spark, sf):
    schema = read_table(spark, sf, "events").schema
    # the table may be one file or a folder of part files
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(_file_or_folder(spark, sf, "events"))
    return events_to_points(raw)


@register("stream_mad", S.mad_sql(S.EVENTS_POINTS, SERVICE) + "\n" + _STATS_SQL_SELECT)
def q_stream_mad(spark, sf):
    """Streaming detector (transformWithState, RocksDB state) over the events
    file source run to completion; equals the batch ``mad_stats``."""
    out = stream_to_parquet(stream_mad_detect(_event_stream(spark, sf), SERVICE), "stream-mad")
    return _stats_select(out)


@register("stream_mad_stale_reset", S.mad_sql(S.EVENTS_POINTS, SERVICE, STALE_GAP_TEST) +
          "\nSELECT seq, reset, n, round(baseline, 6) AS baseline, is_anomaly FROM scored")
def q_stream_mad_stale(spark, sf):
    """Streaming detector with the 6 h idle reset; equals ``mad_stale_reset``."""
    out = stream_to_parquet(stream_mad_detect(_event_stream(spark, sf), SERVICE,
                                              stale_gap_seconds=STALE_GAP_TEST), "stream-mad-stale")
    return out.select("seq", "reset", "n", r6("baseline"), "is_anomaly")


_HOT_SOURCE = "CASE WHEN seq % 10 < 9 THEN 'svc-hot' ELSE source END"
_HOT_POINTS = (f"SELECT * REPLACE ({_HOT_SOURCE} AS source, CASE WHEN seq % 10 < 9 THEN 'load' ELSE metric_name END AS metric_name, "
               "CASE WHEN seq % 10 < 9 THEN 'prod' ELSE env END AS env, "
               f"CASE WHEN seq % 10 < 9 THEN 'us-east-1' ELSE region END AS region) FROM ({S.EVENTS_POINTS})")


def _hot_points(spark, sf):
    """Events as points, nine tenths of them of one series."""
    hot = F.col("seq") % 10 < 9
    pts = metric_points_from_events(spark, sf)
    for column, value in (("source", "svc-hot"), ("metric_name", "load"), ("env", "prod"), ("region", "us-east-1")):
        pts = pts.withColumn(column, F.when(hot, F.lit(value)).otherwise(F.col(column)))
    return pts


def _detect_in_batches(spark, sf, gap=None):
    """Deliver the hot points in four micro-batches of rising time, in two runs
    of the stream; the second resumes from the first one's checkpoint."""
    from vigil.streaming.hot import detect_stream
    pts = _hot_points(spark, sf)
    total = pts.count()
    cuts = pts.approxQuantile("timestamp", [0.2, 0.5, 0.6], 0.01)
    src, base = fresh_subdir(spark, "hot-points"), fresh_subdir(spark, "windowed-detector")
    edges = [None, *cuts, None]
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = pts if a is None else pts.filter(F.col("timestamp") >= F.lit(int(a)))
        part = part if b is None else part.filter(F.col("timestamp") < F.lit(int(b)))
        part.coalesce(1).write.mode("append").parquet(src)
        if k % 2:
            stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(src)
            found = detect_stream(stream, SERVICE, base, stale_gap_seconds=gap, target_chunk_rows=max(100, total // 16),
                                  compact_every=2, buckets=8)
    return found.scored(spark)


@register("stream_mad_hot", S.mad_sql(_HOT_POINTS, SERVICE) + "\n" + _STATS_SQL_SELECT)
def q_stream_mad_hot(spark, sf):
    """Streaming detector for a series of nine tenths of all rows, cut into
    chunks over tasks: several micro-batches and a restart; equals the batch
    statistics."""
    return _stats_select(_detect_in_batches(spark, sf))


@register("stream_mad_hot_stale", S.mad_sql(_HOT_POINTS, SERVICE, STALE_GAP_TEST // 12) +
          "\nSELECT seq, reset, n, round(baseline, 6) AS baseline, is_anomaly FROM scored")
def q_stream_mad_hot_stale(spark, sf):
    """The same with an idle reset after half an hour."""
    return _detect_in_batches(spark, sf, STALE_GAP_TEST // 12).select("seq", "reset", "n", r6("baseline"), "is_anomaly")


# Points arrive in four batches by time, one in five of them a batch later.
_ARRIVAL = "least(3, CAST(floor((timestamp - 1704067200) / 648000.0) AS INT) + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END)"
_DELAY, _EXPIRE = 3600, 3600


def _arriving(spark, sf, delay, expire=None):
    """The detector in event-time order over the four batches, of which one is
    delivered twice, and flushed at the end."""
    from vigil.streaming.hot import WindowedDetector
    pts = metric_points_from_events(spark, sf)
    found = WindowedDetector(fresh_subdir(spark, "event-time"), SERVICE, delay_seconds=delay, expire_seconds=expire,
                             target_chunk_rows=200, compact_every=2, buckets=8)
    dealt = store_table(pts.withColumn("_batch", F.expr(_ARRIVAL)), "arrivals")
    for k in range(4):
        part = dealt.filter(F.col("_batch") == k).drop("_batch")
        found(part, k)
        if k == 2:
            found(part, k)  # a retry
    found.flush(spark, pts.schema, 3)
    return found


_MARKS_SQL = f"""arrivals AS (SELECT *, {_ARRIVAL} AS batch FROM ({S.EVENTS_POINTS})),
marks AS (SELECT k.batch, max(a.timestamp) - {_DELAY} AS mark, max(CASE WHEN a.batch < k.batch THEN a.timestamp END) - {_DELAY} AS past
          FROM (SELECT unnest([0, 1, 2, 3]) AS batch) k JOIN arrivals a ON a.batch <= k.batch GROUP BY k.batch)"""


@register("stream_mad_event_time", S.mad_sql(S.EVENTS_POINTS, SERVICE) + "\n" + _STATS_SQL_SELECT)
def q_stream_mad_event_time(spark, sf):
    """Points that arrive out of order, released by a watermark with a delay
    beyond their lateness; equals the batch statistics."""
    return _stats_select(_arriving(spark, sf, 40 * 86400).scored(spark))


@register("stream_mad_late_points", f"""WITH {_MARKS_SQL}
SELECT a.seq, m.past IS NOT NULL AND a.timestamp <= m.past AS late FROM arrivals a JOIN marks m USING (batch)""")
def q_stream_mad_late_points(spark, sf):
    """The same points with a delay of an hour: which are late, and which are scored."""
    found = _arriving(spark, sf, _DELAY)
    return found.scored(spark).select("seq", F.lit(False).alias("late")).unionByName(
        found.late(spark).select("seq", F.lit(True).alias("late")))


@register("stream_series_expiry", f"""WITH {_MARKS_SQL},
live AS (SELECT a.* FROM arrivals a JOIN marks m USING (batch) WHERE m.past IS NULL OR a.timestamp > m.past),
last AS (SELECT k.batch, k.mark, l.source, l.metric_name, l.env, l.region, max(l.timestamp) AS last_ts
         FROM marks k JOIN live l ON l.batch <= k.batch AND l.timestamp <= k.mark GROUP BY ALL)
SELECT source, metric_name, env, region, last_ts, CAST(min(batch) AS INTEGER) AS batch_id FROM last WHERE last_ts < mark - {_EXPIRE}
GROUP BY source, metric_name, env, region, last_ts""")
def q_stream_series_expiry(spark, sf):
    """Windows dropped because their series was idle for an hour of event
    time; such series begin anew."""
    found = _arriving(spark, sf, _DELAY, _EXPIRE)
    return found.expired(spark).select(*SERIES_KEY_COLUMNS, "last_ts", "batch_id")


def _stream_projection(spark, sf):
    """Write the stand-in anomaly stream in four steps in arrival order
    (originals with even / odd sequence, redeliveries, late re-sends) and run
    the foreachBatch projector after each, resuming from its checkpoint."""
    ev = FX.stored_anomaly_events(spark, sf, SERVICE)
    stream = FX.anomaly_stream(spark, sf, SERVICE, ev).unionByName(FX.late_resends(spark, sf, SERVICE, ev))
    src = fresh_subdir(spark, "anomaly-stream")
    s = F.col("stream_seq")
    parts = [(s < FX.REDELIVERY_OFFSET) & (s % 2 == 0), (s < FX.REDELIVERY_OFFSET) & (s % 2 == 1),
             (s >= FX.REDELIVERY_OFFSET) & (s < 2 * FX.REDELIVERY_OFFSET), s >= 2 * FX.REDELIVERY_OFFSET]
    base = fresh_subdir(spark, "projector")
    for cond in parts:
        stream.filter(cond).write.mode("append").parquet(src)
        proj = project_stream(read_anomaly_stream(spark, src), base=base, compact_every=2, buckets=8)
    return proj


@register("stream_project", S.decoded_sql(SERVICE, late=True) + f"\nSELECT {_LIST_SQL} FROM events_t")
def q_stream_project(spark, sf):
    """Streaming projector: envelopes -> idempotent per-batch append of
    de-duplicated anomaly events (dedup across micro-batches via the stored
    events)."""
    proj = _stream_projection(spark, sf)
    return _list_select(proj.events(spark))


@register("stream_project_state", S.decoded_sql(SERVICE, late=True) + f"\nSELECT {_STATE_SQL} FROM state_t")
def q_stream_project_state(spark, sf):
    """Series state after the streaming projector (changes merged when read);
    equals the batch ``series_state_late_arrival``."""
    proj = _stream_projection(spark, sf)
    return _state_select(proj.latest_state(spark))


# ----------------------------------------------------------------- scoring --
from vigil.operators import scoring as SC  # noqa: E402


@register("reconstruction_mse", f"""WITH pts AS ({S.EVENTS_POINTS}),
w AS (SELECT seq, list(value) OVER (PARTITION BY {S.KEY_SQL} ORDER BY timestamp, seq
                                    ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l FROM pts),
f AS (SELECT seq, l[1] AS x1, l[2] AS x2, l[3] AS x3, l[4] AS x4 FROM w WHERE len(l) = 4),
m AS (SELECT *, (0.0 + x1 + x2 + x3 + x4) / 4 AS mu FROM f),
r AS (SELECT seq, mu, (0.0 + (mu - x1) * (mu - x1) + (mu - x2) * (mu - x2) + (mu - x3) * (mu - x3)
                        + (mu - x4) * (mu - x4)) / 4 AS loss FROM m)
SELECT seq, round(mu, 6) AS recon_mean, round(loss, 6) AS loss, loss > 0.05 AS is_degradation FROM r""")
def q_reconstruction_mse(spark, sf):
    """Mean squared reconstruction error of the last 4 values of each series
    under a fixed linear map (every element reconstructed as the vector mean);
    degradation when the loss exceeds 0.05."""
    fr = SC.recent_values(metric_points_from_events(spark, sf), 4).filter(F.size("recent") == 4)
    mean = SC.array_mean(F.col("recent"))
    rec = fr.withColumn("_mu", mean).withColumn(
        "loss", SC.reconstruction_mse(F.col("recent"), F.array_repeat(F.col("_mu"), 4)))
    return rec.select("seq", F.round("_mu", 6).alias("recon_mean"), r6("loss"),
                      (F.col("loss") > F.lit(SC.RECONSTRUCTION_THRESHOLD)).alias("is_degradation"))


@register("isolation_forest_flags", None)
def q_isolation_forest(spark, sf):
    """Isolation forest (100 trees, 256-row subsamples) trained on the metric
    values as a Spark job and scored by a vectorised UDF; every point with
    its score and flag."""
    pts = metric_points_from_events(spark, sf)
    forest = SC.fit_isolation_forest(pts, ["value"], n_trees=100, psi=256, seed=7)
    return SC.isolation_scores(pts, ["value"], forest).select("seq", "if_score", "if_anomaly")


@register("pca_reconstruction_flags", None)
def q_pca_reconstruction(spark, sf):
    """Stand-in linear autoencoder: last 8 standardised values projected on
    the top-2 principal components and back; loss and degradation flag."""
    pts = metric_points_from_events(spark, sf)
    return SC.reconstruction_flags(pts, d=8, k=2).select("seq", "custom_loss", "is_degradation")


@register("dual_model_predictions", None)
def q_dual_model(spark, sf):
    """Prediction events where either model fires."""
    return SC.dual_model_predictions(metric_points_from_events(spark, sf), seed=7)


# Fixed models, so that scores and the dual rule can be checked: three small
# trees over the value, and a linear autoencoder of two successive values.
_FIXED_TREES = (  # (feature or -1, split, left, right, size) of each node
    ((0, 40.0, 1, 2, 256), (-1, 0.0, -1, -1, 200), (0, 90.0, 3, 4, 56), (-1, 0.0, -1, -1, 50), (-1, 0.0, -1, -1, 6)),
    ((0, 60.0, 1, 2, 256), (-1, 0.0, -1, -1, 240), (-1, 0.0, -1, -1, 16)),
    ((0, 20.0, 1, 2, 256), (-1, 0.0, -1, -1, 100), (-1, 0.0, -1, -1, 156)),
)


def _fixed_forest():
    import pandas as pd
    rows = [(t, n, *node) for t, nodes in enumerate(_FIXED_TREES) for n, node in enumerate(nodes)]
    return pd.DataFrame(rows, columns=["tree_id", "node", "feature", "split", "left", "right", "size"])


def _c_sql(n: int) -> str:
    """Mean path length of an unsuccessful search among n points."""
    return "0.0" if n <= 1 else "1.0" if n == 2 else f"(2 * (ln({n - 1}) + 0.5772156649015329) - 2 * {n - 1} / {n}.0)"


_FOREST_SQL = f"""SELECT *, pow(2, -(
    (CASE WHEN value < 40 THEN 1 + {_c_sql(200)} WHEN value < 90 THEN 2 + {_c_sql(50)} ELSE 2 + {_c_sql(6)} END)
  + (CASE WHEN value < 60 THEN 1 + {_c_sql(240)} ELSE 1 + {_c_sql(16)} END)
  + (CASE WHEN value < 20 THEN 1 + {_c_sql(100)} ELSE 1 + {_c_sql(156)} END)) / 3 / {_c_sql(256)}) AS if_score
FROM ({S.EVENTS_POINTS})"""


@register("isolation_forest_fixed", f"SELECT seq, round(if_score, 6) AS if_score, if_score > 0.5 AS if_anomaly FROM ({_FOREST_SQL})")
def q_isolation_fixed(spark, sf):
    """Scores and flags of a given forest (node table)."""
    return SC.isolation_scores(metric_points_from_events(spark, sf), ["value"], _fixed_forest()).select(
        "seq", r6("if_score"), "if_anomaly")


@register("isolation_forest_calibrated", f"""WITH s AS ({_FOREST_SQL}),
cut AS (SELECT quantile_disc(if_score, 0.9) AS c FROM s)
SELECT seq, round(if_score, 6) AS if_score, if_score > c + 1e-12 AS if_anomaly FROM s, cut""")
def q_isolation_calibrated(spark, sf):
    """Flags of a given forest at the cut that a contamination of a tenth
    gives on the scored points."""
    pts = metric_points_from_events(spark, sf)
    cut = SC.calibrated_cut(SC.isolation_scores(pts, ["value"], _fixed_forest()), 0.1)
    return SC.isolation_scores(pts, ["value"], _fixed_forest(), cut + 1e-12).select("seq", r6("if_score"), "if_anomaly")


@register("dual_model_fixed", f"""WITH scored AS ({_FOREST_SQL}),
x AS (SELECT *, (value - 30) / 40 AS b,
        (lag(value) OVER (PARTITION BY {S.KEY_SQL} ORDER BY timestamp, seq) - 30) / 40 AS a FROM scored),
loss AS (SELECT *, (pow(0.64 * a - 0.48 * b, 2) + pow(0.36 * b - 0.48 * a, 2)) / 2 AS custom_loss FROM x)
SELECT seq, if_score > 0.5 AS if_anomaly, round(custom_loss + 1e-9, 6) AS custom_loss,
       coalesce(custom_loss > 0.5, false) AS is_degradation
FROM loss WHERE if_score > 0.5 OR coalesce(custom_loss > 0.5, false)""")
def q_dual_fixed(spark, sf):
    """The dual rule with given models and threshold: it keeps the points
    where either fires and drops the others."""
    import numpy as np
    model = SC.Autoencoder(30.0, 40.0, [0.0, 0.0], np.array([[0.6], [0.8]]))
    preds = SC.dual_model_predictions(metric_points_from_events(spark, sf), forest=_fixed_forest(), model=model,
                                      threshold=0.5)
    return preds.select("seq", "results.*").withColumn(
        "custom_loss", F.round(F.col("custom_loss") + F.lit(1e-9), 6))  # decimal ties


@register("autoencoder_fixed", f"""WITH x AS (SELECT seq, (value - 30) / 40 AS b,
    (lag(value) OVER (PARTITION BY {S.KEY_SQL} ORDER BY timestamp, seq) - 30) / 40 AS a FROM ({S.EVENTS_POINTS})),
h AS (SELECT *, tanh(0.9 * a + 0.4 * b - 0.1) AS h1, tanh(0.3 * a - 0.8 * b + 0.2) AS h2 FROM x WHERE a IS NOT NULL),
z AS (SELECT *, 0.8 * h1 - 0.5 * h2 + 0.1 AS z FROM h),
g AS (SELECT *, tanh(1.2 * z) AS g1, tanh(0.5 * z - 0.3) AS g2 FROM z),
l AS (SELECT seq, (pow(0.7 * g1 + 0.2 * g2 + 0.05 - a, 2) + pow(0.5 * g1 - 0.6 * g2 - 0.05 - b, 2)) / 2 AS loss FROM g)
SELECT seq, round(loss, 6) AS custom_loss, loss > 0.05 AS is_degradation FROM l""")
def q_autoencoder_fixed(spark, sf):
    """Losses and flags of a given nonlinear autoencoder, its weights read from
    a stored table."""
    import numpy as np
    from vigil.operators.autoencoder import Network, with_reconstruction
    net = Network(tuple((np.array(w), np.array(b)) for w, b in (
        ([[0.9, 0.4], [0.3, -0.8]], [-0.1, 0.2]), ([[0.8, -0.5]], [0.1]), ([[1.2], [0.5]], [0.0, -0.3]),
        ([[0.7, 0.2], [0.5, -0.6]], [0.05, -0.05]))))
    net = Network.from_table(store_table(net.table(spark), "weights"))
    recent = SC.recent_values(metric_points_from_events(spark, sf), 2).filter(F.size("recent") == 2)
    std = recent.select("seq", F.transform("recent", lambda v: (v - F.lit(30.0)) / F.lit(40.0)).alias("_x"))
    loss = with_reconstruction(std, "_x", net).withColumn("loss", SC.reconstruction_mse(F.col("_x"), F.col("reconstruction")))
    return loss.select("seq", F.round("loss", 6).alias("custom_loss"), (F.col("loss") > 0.05).alias("is_degradation"))


# -------------------------------------------------------------- extensions --
from vigil.operators import extensions as X  # noqa: E402
from vigil.operators.envelope import decode_envelope as _decode_env  # noqa: E402

# Bound rules used by ext_bounds_check (config table; signup has no rule).
_RULES = [("click", 0.0, 60.0), ("view", 0.0, 60.0), ("error", 0.0, 80.0), ("purchase", 0.0, 100.0)]
_RULES_SQL = ", ".join(f"('{m}', {lo}, {hi})" for m, lo, hi in _RULES)


@register("ext_bounds_check", f"""SELECT p.seq, 'value out of bounds' AS bounds_reason
FROM ({S.EVENTS_POINTS}) p JOIN (VALUES {_RULES_SQL}) r(metric_name, lo, hi) USING (metric_name)
WHERE p.value < r.lo OR p.value > r.hi""")
def q_ext_bounds(spark, sf):
    """D-1 (extension): per-metric value bounds from a rule table."""
    rules = spark.createDataFrame(_RULES, "metric_name string, lo double, hi double")
    out = X.bounds_check(metric_points_from_events(spark, sf), rules)
    return out.filter(F.col("bounds_reason").isNotNull()).select("seq", "bounds_reason")


@register("ext_dlq", f"""SELECT seq, 'malformed payload' AS reason, 'metrics' AS origin
FROM ({S.EVENTS_POINTS}) WHERE NOT ({_DECODE_OK})
UNION ALL
SELECT * FROM ({S.decoded_sql(SERVICE)} SELECT stream_seq AS seq, reason, 'anomalies' AS origin FROM quarantined)""")
def q_ext_dlq(spark, sf):
    """D-2 (extension): one dead-letter table from the metric-decode and
    envelope-decode quarantines (duplicates never appear here)."""
    _, mq = decode_metric_json(FX.metric_payloads(spark, sf))
    _, eq = _decode_env(FX.anomaly_stream(spark, sf, SERVICE))
    dlq = X.dead_letters(mq.withColumn("origin", F.lit("metrics")),
                         eq.withColumnRenamed("stream_seq", "seq").withColumn("origin", F.lit("anomalies")),
                         keep=("origin",))
    return dlq.select("seq", "reason", "origin")


_NOW_TS = 1706659200  # 2024-01-31T00:00:00Z, "now" for the purge


@register("ext_dlq_oldest", f"""SELECT seq, timestamp AS received_ts, 'malformed payload' AS reason
FROM ({S.EVENTS_POINTS}) WHERE NOT ({_DECODE_OK}) ORDER BY timestamp, seq LIMIT 50""")
def q_ext_dlq_oldest(spark, sf):
    """D-4 (extension): the 50 oldest dead letters of the metric stream."""
    _, mq = decode_metric_json(FX.metric_payloads(spark, sf))
    return X.dlq_oldest(mq, "received_ts").select("seq", "received_ts", "reason")


@register("ext_dlq_purge", f"""SELECT seq, timestamp AS received_ts FROM ({S.EVENTS_POINTS})
WHERE NOT ({_DECODE_OK}) AND timestamp >= {_NOW_TS} - 7 * 86400""")
def q_ext_dlq_purge(spark, sf):
    """D-4 (extension): dead letters kept after purging those older than 7
    days (as of 2024-01-31)."""
    _, mq = decode_metric_json(FX.metric_payloads(spark, sf))
    return X.dlq_purge(mq, "received_ts", _NOW_TS).select("seq", "received_ts")


@register("ext_oversize", """SELECT doc_id, CAST(strlen(text) AS INTEGER) AS payload_bytes, strlen(text) > 2048 AS oversize,
  CAST(CASE WHEN strlen(text) <= 2048 THEN NULL ELSE (SELECT max(n) FROM (SELECT unnest(generate_series(0, 1024)) AS n)
       WHERE strlen(left(text, CAST(n AS BIGINT))) <= 1024) END AS INTEGER) AS kept_chars FROM documents""")
def q_ext_oversize(spark, sf):
    """D-3 (extension): payload size guard over whole document texts, at a
    limit that many of them exceed; how much is kept is counted in characters."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    ok, dlq = X.oversize_guard(docs, "text", limit_bytes=2048)
    return (ok.select("doc_id", F.octet_length("text").alias("payload_bytes"), F.lit(False).alias("oversize"),
                      F.lit(None).cast("int").alias("kept_chars"))
            .unionByName(dlq.select("doc_id", "payload_bytes", F.lit(True).alias("oversize"),
                                    F.char_length("text").alias("kept_chars"))))


@register("ext_red_rollup", f"""SELECT source, (timestamp // 3600) * 3600 AS bucket, COUNT(*) AS messages,
  CAST(SUM(CASE WHEN metric_name = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  round(SUM(value), 6) AS value_sum, round(MIN(value), 6) AS value_min, round(MAX(value), 6) AS value_max
FROM ({S.EVENTS_POINTS}) GROUP BY 1, 2""")
def q_ext_red(spark, sf):
    """D-7 (extension): hourly rate / errors / value roll-up per source."""
    r = X.red_rollup(metric_points_from_events(spark, sf), 3600)
    return r.select("source", "bucket", "messages", "errors", r6("value_sum"), r6("value_min"),
                    r6("value_max"))


@register("ext_slo", f"""SELECT source, (timestamp // 86400) * 86400 AS bucket,
  AVG(CASE WHEN value <= 95 THEN 1.0 ELSE 0.0 END) >= 0.99 AS p99_ok,
  round(SUM(CASE WHEN metric_name = 'error' THEN 1 ELSE 0 END) / COUNT(*), 6) AS error_rate,
  SUM(CASE WHEN metric_name = 'error' THEN 1 ELSE 0 END) / COUNT(*) < 0.001 AS error_rate_ok
FROM ({S.EVENTS_POINTS}) GROUP BY 1, 2""")
def q_ext_slo(spark, sf):
    """D-8 (extension): daily SLO per source: p99 of value <= 95 and error
    rate < 0.1 %."""
    r = X.slo_report(metric_points_from_events(spark, sf), 86400, 95.0)
    return r.select("source", "bucket", "p99_ok", r6("error_rate"), "error_rate_ok")


@register("ext_alert_hold", f"""WITH r AS (
  SELECT source, timestamp // 3600 AS b,
         SUM(CASE WHEN metric_name = 'error' THEN 1 ELSE 0 END) / COUNT(*) AS err
  FROM ({S.EVENTS_POINTS}) GROUP BY 1, 2),
h AS (SELECT *, b - row_number() OVER (PARTITION BY source ORDER BY b) AS grp FROM r WHERE err > 0.3),
runs AS (SELECT source, grp, MIN(b) AS b0, MAX(b) AS b1, COUNT(*) AS buckets FROM h GROUP BY 1, 2)
SELECT source, b0 * 3600 AS start_ts, b1 * 3600 AS end_ts, buckets FROM runs WHERE buckets >= 2""")
def q_ext_alert_hold(spark, sf):
    """D-9 (extension): alert when a source's hourly error share stays above
    30 % for at least 2 consecutive hours."""
    return X.alerts_with_hold(metric_points_from_events(spark, sf), 3600, 0.3, 2)


@register("ext_cardinality", f"""SELECT label, d > 100 AS violation FROM (
  SELECT 'source' AS label, COUNT(DISTINCT source) AS d FROM ({S.EVENTS_POINTS})
  UNION ALL SELECT 'metric_name', COUNT(DISTINCT metric_name) FROM ({S.EVENTS_POINTS})
  UNION ALL SELECT 'env', COUNT(DISTINCT env) FROM ({S.EVENTS_POINTS})
  UNION ALL SELECT 'region', COUNT(DISTINCT region) FROM ({S.EVENTS_POINTS})
  UNION ALL SELECT 'instance_id', COUNT(DISTINCT instance_id) FROM ({S.EVENTS_POINTS}))""")
def q_ext_cardinality(spark, sf):
    """D-10 (extension): label-cardinality audit (> 100 distinct values is a
    violation), HyperLogLog++ in one pass."""
    cols = ["source", "metric_name", "env", "region", "instance_id"]
    return X.cardinality_audit(metric_points_from_events(spark, sf), cols).select("label", "violation")


@register("ext_list_predictions", None)
def q_ext_list_predictions(spark, sf):
    """D-14 (extension): newest-first page of prediction events."""
    preds = SC.dual_model_predictions(metric_points_from_events(spark, sf), seed=7)
    return X.list_predictions(preds).select("seq", "timestamp", "source", "metric_name", "results")


@register("ext_ttf", f"""WITH pts AS ({S.EVENTS_POINTS}),
w AS (SELECT seq, timestamp, value,
        list(struct_pack(ts := timestamp, v := value)) OVER (PARTITION BY {S.KEY_SQL}
             ORDER BY timestamp, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM pts),
a AS (SELECT seq, value, CAST(len(l) AS DOUBLE) AS n,
        list_transform(l, lambda e: CAST(e.ts - timestamp AS DOUBLE)) AS t,
        list_transform(l, lambda e: e.v) AS vv FROM w),
b AS (SELECT seq, value, n,
        list_reduce(list_prepend(0.0, t), lambda x, y: x + y) AS st,
        list_reduce(list_prepend(0.0, vv), lambda x, y: x + y) AS sv,
        list_reduce(list_prepend(0.0, list_transform(list_zip(t, vv), lambda p: p[1] * p[2])), lambda x, y: x + y) AS stv,
        list_reduce(list_prepend(0.0, list_transform(t, lambda x: x * x)), lambda x, y: x + y) AS stt FROM a),
c AS (SELECT seq, value, CASE WHEN n >= 2 AND n * stt - st * st <> 0
        THEN (n * stv - st * sv) / (n * stt - st * st) END AS slope FROM b)
SELECT seq, round(slope * 1e6, 4) AS slope_per_1e6s,
       round(CASE WHEN slope > 0 AND value < 100.0 THEN (100.0 - value) / slope END, 1) AS ttf_seconds
FROM c""")
def q_ext_ttf(spark, sf):
    """D-13 (extension): 10-point trend slope and time-to-failure toward a
    limit of 100 (value units)."""
    out = X.trend_ttf(metric_points_from_events(spark, sf), 10, 100.0)
    return out.select("seq", F.round(F.col("slope") * F.lit(1e6), 4).alias("slope_per_1e6s"),
                      F.round("ttf_seconds", 1).alias("ttf_seconds"))


_DAILY_SQL = f"""WITH d AS (
  SELECT seq, source, timestamp, strftime(make_timestamp(timestamp * 1000000), '%Y%m%d') AS day
  FROM ({S.EVENTS_POINTS}))
SELECT seq, day || ':' || CAST(1000 + (('0x' || substr(sha256(source || '|' || day), 1, 8))::BIGINT % 10000)
        + row_number() OVER (PARTITION BY source, day ORDER BY timestamp, seq) - 1 AS VARCHAR) AS daily_id
FROM d"""


@register("ext_daily_sequence", _DAILY_SQL)
def q_ext_daily_sequence(spark, sf):
    """D-6 (extension): per-source daily message ids ``YYYYMMDD:N``."""
    return X.daily_sequence(metric_points_from_events(spark, sf), "source").select("seq", "daily_id")


@register("ext_daily_sequence_hot", _DAILY_SQL)
def q_ext_daily_sequence_hot(spark, sf):
    """D-6 with source-days cut into chunks of ~15 messages: the same ids."""
    return X.daily_sequence(metric_points_from_events(spark, sf), "source", target_chunk_rows=15).select("seq", "daily_id")


_ERR_NOW = 1705320000  # 2024-01-15T12:00:00Z


@register("ext_recent_errors", f"""SELECT seq, timestamp, instance_id FROM ({S.EVENTS_POINTS})
WHERE source = 'svc-1' AND metric_name = 'error' AND timestamp BETWEEN {_ERR_NOW - 6 * 3600} AND {_ERR_NOW}""")
def q_ext_recent_errors(spark, sf):
    """D-11 (extension): one source's error records in the 6 hours before
    2024-01-15 12:00 UTC."""
    return X.recent_errors(metric_points_from_events(spark, sf), "svc-1", _ERR_NOW, 6 * 3600) \
        .select("seq", "timestamp", "instance_id")


@register("ext_outbox_relay", S.decoded_sql(SERVICE) +
          f"\nSELECT {_LIST_SQL} FROM events_t WHERE id > 5000 ORDER BY id LIMIT 100")
def q_ext_outbox_relay(spark, sf):
    """D-12 (extension): next relay batch of stored anomaly events after the
    published cursor id 5000, in id order."""
    return _list_select(X.outbox_batch(_stored_events(spark, sf), 5000, 100))


@register("stream_predictions", None)
def q_stream_predictions(spark, sf):
    """Model-scoring intake as its own streaming query (own checkpoint): a
    forest fitted on the events history scores the metric stream; prediction
    events (either model fires) are published as JSON through the prediction
    sink and read back."""
    from vigil.streaming.jobs import run_available_now, write_prediction_stream
    history = metric_points_from_events(spark, sf)
    forest = SC.fit_isolation_forest(history, ["value"], n_trees=100, psi=256, seed=7)
    st = history.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    preds = SC.score_stream(_event_stream(spark, sf), forest, float(st["m"]), float(st["s"]))
    base = fresh_subdir(spark, "predictions")
    run_available_now(write_prediction_stream(preds, f"{base}/out", f"{base}/ckpt"))
    schema = ("metric_name string, source string, timestamp long, "
              "results struct<if_anomaly:boolean, custom_loss:double, is_degradation:boolean>")
    return spark.read.text(f"{base}/out").select(F.from_json("value", schema).alias("p")).select("p.*")


# ------------------------------------------- numpy engine (same semantics) --
@register("mad_stats_numpy", S.mad_sql(S.EVENTS_POINTS, SERVICE) + "\n" + _STATS_SQL_SELECT)
def q_mad_stats_numpy(spark, sf):
    """``mad_stats`` with ``engine="numpy"`` (numpy kernel per series group
    over Arrow batches); must equal ``mad_stats``."""
    return _stats_select(mad_detect(metric_points_from_events(spark, sf), SERVICE, engine="numpy"))


@register("mad_chunked_numpy", S.mad_sql(S.EVENTS_POINTS, SERVICE, STALE_GAP_TEST) +
          "\nSELECT seq, reset, n, round(baseline, 6) AS baseline, is_anomaly FROM scored")
def q_mad_chunked_numpy(spark, sf):
    """Idle-reset detector through the numpy engine on one-day chunks (halos
    delivered by cogroup); must equal ``mad_stale_reset``."""
    df = mad_detect(metric_points_from_events(spark, sf), SERVICE, stale_gap_seconds=STALE_GAP_TEST,
                    chunk_seconds=86400, engine="numpy")
    return df.select("seq", "reset", "n", r6("baseline"), "is_anomaly")


@register("mad_lineitem_numpy", S.mad_sql(S.LINEITEM_POINTS, SERVICE) + "\n" + _ANOM_OUT_SQL)
def q_mad_lineitem_numpy(spark, sf):
    """``mad_lineitem`` through the numpy engine."""
    return _anom_select(detect_anomalies(metric_points_from_lineitem(spark, sf), SERVICE, engine="numpy"))


@register("ext_ttl_dedup_stream", S.decoded_sql(SERVICE) + """
SELECT sha256(concat_ws('|', source, metric_name, env, region, instance_id, CAST(timestamp AS VARCHAR))) AS dedup_hash,
       MIN(stream_seq) AS stream_seq
FROM decoded GROUP BY 1""")
def q_ext_ttl_dedup(spark, sf):
    """D-5 (extension): streaming TTL de-duplication (5 min) of decoded
    anomaly envelopes on the SHA-256 of their canonical identity; the
    redelivered copies (same identity and event time) are dropped, the first
    delivery kept, and the older half of the stream, which arrives after the
    newer one, is not lost."""
    from vigil.operators.envelope import decode_envelope as dec_env
    from vigil.streaming.jobs import stream_to_parquet
    ev = FX.stored_anomaly_events(spark, sf, SERVICE)
    stream = FX.anomaly_stream(spark, sf, SERVICE, ev)
    src = fresh_subdir(spark, "ttl-src")
    s = F.col("stream_seq")
    base = fresh_subdir(spark, "ttl-dedup")
    # the newer half, the older half (late), then the redelivered copies
    half = stream.filter(s < FX.REDELIVERY_OFFSET).agg(F.percentile_approx("stream_seq", 0.5)).first()[0] or 0
    for cond in ((s < FX.REDELIVERY_OFFSET) & (s > half), s <= half, s >= FX.REDELIVERY_OFFSET):
        stream.filter(cond).write.mode("append").parquet(src)
        decoded, _ = dec_env(read_anomaly_stream(spark, src))
        keyed = (decoded.withColumn("dedup_hash", X.canonical_dedup_key(
            "source", "metric_name", "env", "region", "instance_id", "timestamp"))
            .withColumn("event_time", F.timestamp_seconds(F.col("timestamp")))
            .select("dedup_hash", "stream_seq", "event_time"))
        out = stream_to_parquet(X.ttl_dedup_stream(keyed, "dedup_hash", "event_time", seq_col="stream_seq"), "ttl-dedup",
                                base=base, drain=True)
    return out.select("dedup_hash", "stream_seq")


# ------------------------------------------------- exact TTL dedup, histograms --
from vigil.operators import histogram as H  # noqa: E402
from vigil.operators.ttl import ttl_dedup  # noqa: E402

_TTL = 900
_TTL_KEY = "CASE WHEN seq % 10 < 7 THEN 'hot' ELSE instance_id END"


@register("ext_ttl_dedup_batch", f"""WITH RECURSIVE e AS (SELECT {_TTL_KEY} AS k, timestamp AS t, min(seq) AS seq
  FROM ({S.EVENTS_POINTS}) GROUP BY 1, 2),
c AS (SELECT k, min(t) AS t FROM e GROUP BY k
      UNION ALL
      SELECT c.k, min(e.t) FROM c JOIN e ON e.k = c.k AND e.t >= c.t + {_TTL} GROUP BY c.k, c.t)
SELECT e.k AS dedup_key, e.t AS timestamp, e.seq FROM c JOIN e USING (k, t)""")
def q_ext_ttl_dedup_batch(spark, sf):
    """D-5 (extension): exact TTL dedup of stored events, seven tenths of them
    of one key; keys that return after the TTL are accepted again."""
    ev = metric_points_from_events(spark, sf).withColumn("dedup_key", F.expr(_TTL_KEY))
    return ttl_dedup(ev, "dedup_key", "timestamp", "seq", _TTL).select("dedup_key", "timestamp", "seq")


_LOG_GROWTH = "ln(1.01::DOUBLE / 0.99::DOUBLE)"


@register("ext_red_histogram", f"""WITH b AS (SELECT source, (timestamp // 3600) * 3600 AS start,
    CASE WHEN value <= 0 THEN NULL ELSE CAST(ceil(ln(value) / {_LOG_GROWTH}) AS INTEGER) END AS i FROM ({S.EVENTS_POINTS})),
r AS (SELECT *, row_number() OVER (PARTITION BY source, start ORDER BY i NULLS FIRST) AS rk,
             count(*) OVER (PARTITION BY source, start) AS n FROM b)
SELECT source, start, n AS messages, """ + ", ".join(
    f"round(max(CASE WHEN rk = greatest(1, ceil(n * {q}::DOUBLE)) THEN coalesce(2 * exp(i * {_LOG_GROWTH}) / (1.01::DOUBLE / 0.99::DOUBLE + 1), 0.0) END), 6) AS {c}"
    for c, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM r GROUP BY source, start, n")
def q_ext_red_histogram(spark, sf):
    """D-7 (extension): percentiles per service and hour from stored minute
    histograms that are added up (1 % relative error)."""
    minutes = store_table(H.histograms(metric_points_from_events(spark, sf), ["source"]), "minute-histograms")
    hours = H.merge_histograms(minutes, ["source"], 3600)
    return hours.select("source", "start", F.col("count").alias("messages"), *(
        F.round(H.percentile("histogram", "count", q), 6).alias(c) for c, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


_STAGES_SQL = "CASE seq % 3 WHEN 0 THEN 'normalise' WHEN 1 THEN 'classify' ELSE 'publish' END"


@register("ext_slo_stages", f"""WITH p AS (SELECT *, {_STAGES_SQL} AS stage, value * 2 AS ms FROM ({S.EVENTS_POINTS})),
l AS (SELECT (timestamp // 3600) * 3600 AS hour,
  coalesce(avg(CASE WHEN stage = 'normalise' THEN CAST(ms <= 200 AS INTEGER) END) >= 0.99, true) AS normalise_ok,
  coalesce(avg(CASE WHEN stage = 'classify' THEN CAST(ms <= 500 AS INTEGER) END) >= 0.99, true) AS classify_ok,
  coalesce(avg(CASE WHEN stage = 'publish' THEN CAST(ms <= 50 AS INTEGER) END) >= 0.99, true) AS publish_ok
  FROM p GROUP BY 1),
d AS (SELECT (timestamp // 3600) * 3600 AS hour, count(*) AS n FROM ({S.EVENTS_POINTS}) WHERE NOT ({_DECODE_OK}) GROUP BY 1)
SELECT l.*, coalesce(d.n, 0) AS dead_letters, coalesce(d.n, 0) < 5 AS dead_letters_ok,
       normalise_ok AND classify_ok AND publish_ok AND coalesce(d.n, 0) < 5 AS slo_ok FROM l LEFT JOIN d USING (hour)""")
def q_ext_slo_stages(spark, sf):
    """D-8 (extension): p99 targets of the three stages and dead letters per
    hour. The stages' latencies are stood in for by the events' values."""
    pts = metric_points_from_events(spark, sf).withColumn("stage", F.expr(_STAGES_SQL)).withColumn("ms", F.col("value") * 2)
    _, bad = decode_metric_json(FX.metric_payloads(spark, sf))
    return H.slo_stages(pts, bad.withColumnRenamed("received_ts", "timestamp"), X.P99_TARGET_MS, X.DLQ_PER_HOUR_TARGET, value="ms")


@register("ext_cardinality_daily", f"""SELECT (timestamp // 86400) * 86400 AS start, label, count(DISTINCT v) > 100 AS violation
FROM (SELECT timestamp, unnest(['source', 'metric_name', 'instance_id']) AS label, unnest([source, metric_name, instance_id]) AS v
      FROM ({S.EVENTS_POINTS})) GROUP BY ALL""")
def q_ext_cardinality_daily(spark, sf):
    """D-10 (extension): the day's cardinality audit from stored hourly
    sketches; it reads no points."""
    hourly = store_table(H.distinct_sketches(metric_points_from_events(spark, sf), ["source", "metric_name", "instance_id"]),
                         "label-sketches")
    return H.cardinality_from_sketches(hourly, 100).select("start", "label", "violation")


@register("ext_dlq_payloads", _texts_sql() + """
SELECT seq, 'malformed payload' AS reason, payload, CAST(strlen(payload) AS INTEGER) AS payload_bytes FROM t ANTI JOIN typed USING (seq)
WHERE trim(payload) <> 'null'""")
def q_ext_dlq_payloads(spark, sf):
    """D-2 (extension): dead letters with their whole payloads and sizes."""
    _, bad = decode_metric_json(FX.payload_texts(spark, sf))
    return X.dead_letters(bad)


@register("ext_trace_lookup", S.decoded_sql(SERVICE) + """,
traced AS (SELECT *, 'trace-' || CAST(stream_seq % 97 AS VARCHAR) AS trace FROM events_t)
SELECT id, source, metric_name, ts, trace AS trace_id FROM traced WHERE trace = 'trace-13'""")
def q_ext_trace_lookup(spark, sf):
    """D-11 (extension): the stored events of one trace; the predicate reaches
    the scan."""
    traced = store_table(_stored_events(spark, sf).withColumn("trace_id", F.concat(
        F.lit("trace-"), (F.col("stream_seq") % 97).cast("string"))), "traced-events")
    return X.trace_lookup(traced, "trace-13").select("id", "source", "metric_name", "ts", "trace_id")
