"""Anomaly events: stamping, versioned JSON envelope encode and decode.

Envelope (version 2 with a flat version-1 copy)::

    {"meta": {event_id, event_type, event_version, producer, occurred_at,
              produced_at, trace_id?},
     "data": {source, metric_name, env?, region?, instance_id?, timestamp?,
              value, baseline, mad, threshold, window_size, threshold_k, detector},
     ...the 13 data fields again at top level, each omitted when ""/0}

``?`` marks fields omitted when empty/zero. Decoding prefers ``meta`` +
``data`` when both are present, else reads the flat fields (event metadata
then defaults to ""/0). Either way an empty source or metric name makes the
record invalid. Integer fields are narrowed to 32 bits with wrap-around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.arrays import materialize
from vigil.operators.ingest import bare_null, one_json_object, wrongly_typed
from vigil.config import DEFAULT_PRODUCER, DETECTOR_NAME, EVENT_TYPE, EVENT_VERSION
from vigil.schemas import DATA_FIELD_NAMES, ENVELOPE_SCHEMA

REASON_MALFORMED = "malformed payload"
REASON_INVALID = "invalid envelope"
RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"

# Fields dropped from ``data`` when empty / zero; all flat fields are.
_DATA_OMITEMPTY = ("env", "region", "instance_id", "timestamp")


def rfc3339(ts: Column) -> Column:
    """UTC timestamp as RFC3339 text (``Z`` suffix under a UTC session)."""
    return F.date_format(ts, RFC3339)


def event_id_col() -> Column:
    """Deterministic event id: SHA-256 of the point identity, so a retried
    point produces a true duplicate that the projector removes."""
    return F.sha2(F.concat_ws("|", "source", "metric_name", "env", "region", "instance_id",
                              F.col("timestamp").cast("string"), F.col("seq").cast("string")), 256)


def stamp_anomaly_events(anomalies: DataFrame, threshold_k: float, *,
                         producer: str = DEFAULT_PRODUCER, clock: str | None = None) -> DataFrame:
    """Turn detector output (``detect_anomalies``) into anomaly events.

    ``clock`` pins occurred_at / produced_at (RFC3339 text) for reproducible
    runs; by default they are the query's current timestamp."""
    now = F.lit(clock) if clock is not None else rfc3339(F.current_timestamp())
    return anomalies.select(
        "source", "metric_name", "env", "region", "instance_id", "timestamp", "value",
        "baseline", "mad", "threshold",
        F.col("n").cast("long").alias("window_size"),
        F.lit(float(threshold_k)).alias("threshold_k"),
        F.lit(DETECTOR_NAME).alias("detector"),
        event_id_col().alias("event_id"),
        F.lit(EVENT_TYPE).alias("event_type"),
        F.lit(EVENT_VERSION).cast("long").alias("event_version"),
        F.lit(producer).alias("producer"),
        now.alias("occurred_at"), now.alias("produced_at"),
        F.lit("").alias("trace_id"),
        "seq",
    )


def _omit(c: str, dtype: str) -> Column:
    empty = F.lit("") if dtype == "string" else F.lit(0)
    return F.when(F.col(c) == empty, F.lit(None)).otherwise(F.col(c))


def encode_envelope(events: DataFrame) -> Column:
    """JSON text of the version-2 envelope with flat copies (NULL fields are
    left out by ``to_json``, which gives the omit-when-empty behaviour)."""
    types = dict(events.dtypes)
    meta = F.struct(
        F.col("event_id").alias("event_id"), F.col("event_type").alias("event_type"),
        F.col("event_version").alias("event_version"), F.col("producer").alias("producer"),
        F.col("occurred_at").alias("occurred_at"), F.col("produced_at").alias("produced_at"),
        _omit("trace_id", "string").alias("trace_id"))
    data = F.struct(*[(_omit(c, types[c]) if c in _DATA_OMITEMPTY else F.col(c)).alias(c)
                      for c in DATA_FIELD_NAMES])
    flat = [_omit(c, types[c]).alias(c) for c in DATA_FIELD_NAMES]
    return F.to_json(F.struct(meta.alias("meta"), data.alias("data"), *flat))


def encode_flat_envelope(events: DataFrame) -> Column:
    """Version-1 (flat only) envelope, as older producers send it."""
    types = dict(events.dtypes)
    return F.to_json(F.struct(*[_omit(c, types[c]).alias(c) for c in DATA_FIELD_NAMES]))


_DECODE_SCHEMA = T.StructType(ENVELOPE_SCHEMA.fields + [T.StructField("_corrupt", T.StringType())])
_JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
              "allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}


def _texts(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


def _envelope_typed(payload: Column) -> Column:
    """False where a text field of the envelope, of its ``meta`` or ``data``
    holds another JSON type."""
    parts = F.from_json(payload, "meta string, data string", _JSON_OPTS)  # their own text
    wrong = wrongly_typed(payload, _texts(ENVELOPE_SCHEMA))
    for name in ("meta", "data"):
        wrong = wrong | wrongly_typed(parts[name], _texts(ENVELOPE_SCHEMA[name].dataType))
    return ~wrong


def int32_wrap(c: Column) -> Column:
    """Narrow a 64-bit integer to 32 bits with two's-complement wrap-around."""
    return (F.pmod(c + F.lit(2 ** 31), F.lit(2 ** 32)) - F.lit(2 ** 31)).cast("int")


def decode_envelope(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Decode envelopes -> (decoded rows, quarantine).

    Decoded rows hold the flat DTO columns (see ``schemas.DTO_COLUMNS``) plus
    every non-payload input column (e.g. subject, stream_seq). Quarantine rows
    keep the input columns plus ``reason``. A payload must be one JSON object
    and nothing else; the bare word ``null`` is an envelope without a source,
    and so invalid."""
    return split_envelopes(parse_envelope(df, payload), df.columns, payload)


def parse_envelope(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``_env`` (the parsed envelope) and ``_typed`` (well-formed)."""
    text = F.col(payload)
    parsed = materialize(df, "_env", F.from_json(text, _DECODE_SCHEMA, _JSON_OPTS))
    return materialize(parsed, "_typed", F.coalesce(
        bare_null(text) | (one_json_object(text) & _envelope_typed(text) & F.col("_env").isNotNull()
                           & F.col("_env._corrupt").isNull()), F.lit(False)))


def split_envelopes(parsed: DataFrame, columns: list[str], payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Parsed envelopes -> (decoded rows, quarantine) over the input ``columns``."""
    e = F.col("_env")
    malformed = ~F.col("_typed")
    v2 = e["meta"].isNotNull() & e["data"].isNotNull()

    def pick(f: str) -> Column:
        return F.when(v2, e["data"][f]).otherwise(e[f])

    def meta(f: str, zero) -> Column:
        return F.coalesce(F.when(v2, e["meta"][f]), F.lit(zero))

    zero_of = {"string": F.lit(""), "double": F.lit(0.0), "bigint": F.lit(0).cast("long")}
    dtypes = {f.name: f.dataType.simpleString() for f in ENVELOPE_SCHEMA["data"].dataType.fields}
    cols = {f: F.coalesce(pick(f), zero_of[dtypes[f]]) for f in DATA_FIELD_NAMES}
    cols["window_size"] = int32_wrap(cols["window_size"])
    invalid = F.coalesce((cols["source"] == "") | (cols["metric_name"] == ""), F.lit(True))
    carry = [c for c in columns if c != payload]
    decoded = (parsed.filter(~malformed & ~invalid)
               .select(*carry, *[cols[f].alias(f) for f in DATA_FIELD_NAMES],
                       meta("event_id", "").alias("event_id"),
                       meta("event_type", "").alias("event_type"),
                       meta("producer", "").alias("producer"),
                       meta("occurred_at", "").alias("occurred_at"),
                       meta("produced_at", "").alias("produced_at"),
                       meta("trace_id", "").alias("trace_id"),
                       int32_wrap(F.coalesce(F.when(v2, e["meta"]["event_version"]),
                                             F.lit(0).cast("long"))).alias("event_version")))
    quarantine = (parsed.filter(malformed | invalid)
                  .select(*columns, F.when(malformed, F.lit(REASON_MALFORMED))
                          .otherwise(F.lit(REASON_INVALID)).alias("reason")))
    return decoded, quarantine
