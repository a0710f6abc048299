"""Metric ingest: validation, JSON encode/decode of metric points.

Semantics
---------
* A point is rejected as ``invalid metric`` when ``source`` or ``metric_name``
  is empty (NULL counts as empty); there is no trimming.
* NaN / +-Inf values never reach the stream (JSON cannot carry them), so they
  are rejected as ``non-finite value``.
* Decoding the stream payload: text that is not one JSON object (trailing text
  and second values included) or a wrongly typed field drops the record to
  quarantine (no retry); a missing field takes its zero value
  (``""`` / ``0``); unknown keys are ignored. Decoding does *not* re-run the
  required-field check. Keys are matched case-sensitively (the contract is
  snake_case).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.arrays import materialize
from vigil.schemas import METRIC_FIELDS, METRIC_SCHEMA

REASON_INVALID = "invalid metric"
REASON_NON_FINITE = "non-finite value"
REASON_MALFORMED = "malformed payload"
REASON_BAD_VALUE = "missing or invalid value"

_STR_FIELDS = ("source", "metric_name", "env", "region", "instance_id")


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def reject_reason(df: DataFrame) -> Column:
    """NULL for a valid point, else the first failing rule."""
    return (F.when(_empty(F.col("source")) | _empty(F.col("metric_name")), F.lit(REASON_INVALID))
            .when(~is_finite(F.coalesce(F.col("value"), F.lit(0.0))), F.lit(REASON_NON_FINITE)))


def ingest_metrics(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split metric records into (accepted points, rejected records).

    Accepted points carry the zero value for absent optional fields (a
    missing value is 0.0, missing strings are ""). Rejected records keep
    their columns plus ``reason``. Works on batch and streaming frames alike
    (a single pass of column expressions; no shuffle)."""
    tagged = df.withColumn("reason", reject_reason(df))
    zero = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in _STR_FIELDS]
    others = [c for c in df.columns if c not in _STR_FIELDS + ("value", "timestamp")]
    accepted = (tagged.filter(F.col("reason").isNull())
                .select(*zero, F.coalesce(F.col("value"), F.lit(0.0)).alias("value"),
                        F.coalesce(F.col("timestamp"), F.lit(0).cast("long")).alias("timestamp"),
                        *others))
    rejected = tagged.filter(F.col("reason").isNotNull())
    return accepted.select(*df.columns), rejected


def encode_metric_json(df: DataFrame) -> Column:
    """The 7 snake_case fields as one JSON object (numbers stay numbers)."""
    return F.to_json(F.struct(*[F.col(c) for c in METRIC_FIELDS]))


_STRICT = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}
_WHITE = " \t\r\n"


def one_json_value(payload: Column) -> Column:
    """True where the text is one JSON value other than null, and nothing else.
    ``from_json`` alone reads the first value and ignores what follows; as the
    one element of an array and as the one field of an object, text that
    follows (a second value, a bracket, a comma) breaks the one or the other."""
    alone = F.size(F.from_json(F.concat(F.lit("["), payload, F.lit("]")), "array<string>", _STRICT)) == 1
    inside = F.from_json(F.concat(F.lit('{"x":'), payload, F.lit("}")), "x string", _STRICT)["x"].isNotNull()
    return F.coalesce(alone & inside, F.lit(False))


def one_json_object(payload: Column) -> Column:
    return one_json_value(payload) & F.ltrim(F.translate(payload, _WHITE, "    ")).startswith("{")


def bare_null(payload: Column) -> Column:
    return F.trim(F.translate(payload, _WHITE, "    ")) == "null"


def _no_text(value: Column) -> Column:
    return F.coalesce(~F.schema_of_variant(value).isin("STRING", "VOID"), F.lit(False))


def wrongly_typed(payload: Column, fields: list[str]) -> Column:
    """True where a text field of the JSON object holds a number, boolean,
    object or array (``from_json`` would turn any of them into text). Null and
    absent fields are fine. Of a repeated key every value counts; if some other
    value of the object can't be held as a variant (an object that repeats
    keys), the last one does."""
    every = F.exists(F.map_entries(F.from_json(payload, "map<string,variant>", _STRICT)),
                     lambda e: e["key"].isin(fields) & _no_text(e["value"]))
    last = F.from_json(payload, ", ".join(f"`{f}` variant" for f in fields), _STRICT)
    return F.coalesce(every, reduce(or_, (_no_text(last[f]) for f in fields)), F.lit(False))


_DECODE_SCHEMA = T.StructType(METRIC_SCHEMA.fields + [T.StructField("_corrupt", T.StringType())])
_JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **_STRICT}


def decode_metric_json(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Decode metric payloads -> (points, quarantine).

    Points get zero values for missing fields; other input columns (e.g. the
    stream sequence) are carried through. Quarantine rows keep the input
    columns plus ``reason``. The payload must be one JSON object and nothing
    else; of a repeated key the last value stands, but all must have the right
    type. The bare word ``null`` is a point of zero values, as an empty object
    is."""
    text = F.col(payload)
    parsed = materialize(df, "_m", F.from_json(text, _DECODE_SCHEMA, _JSON_OPTS))
    wrong = (~one_json_object(text) | F.col("_m").isNull() | F.col("_m._corrupt").isNotNull()
             | wrongly_typed(text, list(_STR_FIELDS)))
    parsed = materialize(parsed, "_bad", text.isNull() | (wrong & ~bare_null(text)))
    bad = F.col("_bad")
    carry = [c for c in df.columns if c != payload]
    zero = {T.StringType(): F.lit(""), T.DoubleType(): F.lit(0.0), T.LongType(): F.lit(0).cast("long")}
    fields = [F.coalesce(F.col(f"_m.{f.name}"), zero[f.dataType]).alias(f.name)
              for f in METRIC_SCHEMA.fields]
    points = parsed.filter(~bad).select(*carry, *fields)
    quarantine = parsed.filter(bad).select(*df.columns, F.lit(REASON_MALFORMED).alias("reason"))
    return points, quarantine


_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|FLOAT|DOUBLE)$"


def ml_payload_filter(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Model-scoring intake: keep payloads whose ``value`` is present and
    numeric, whatever the other fields hold; payloads that are not one JSON
    object, a ``value`` of another type, and missing values are acknowledged
    and dropped (returned as the second frame with a reason). Of a repeated key
    the last value stands. JSON booleans are not numbers here, and NaN is not
    JSON. ``metric_name`` is returned as text and ``timestamp`` as an integer,
    null where it is none."""
    carry = [c for c in df.columns if c != payload]
    text = F.col(payload)
    parsed = materialize(df, "_m", F.when(one_json_object(text), F.from_json(
        text, "metric_name variant, value variant, timestamp variant", _STRICT)))
    m = F.col("_m")
    kind = F.coalesce(F.schema_of_variant(m["value"]), F.lit("VOID"))
    number = kind.rlike(_NUMBER)
    malformed = m.isNull() | (~number & (kind != "VOID"))
    parsed = materialize(parsed, "_ok", ~malformed & number)
    keep = parsed.filter("_ok").select(
        *carry, F.try_variant_get(m["metric_name"], "$", "string").alias("metric_name"),
        F.try_variant_get(m["value"], "$", "double").alias("value"),
        F.try_variant_get(m["timestamp"], "$", "bigint").alias("timestamp"))
    drop = parsed.filter("not _ok").select(
        *df.columns,
        F.when(malformed, F.lit(REASON_MALFORMED)).otherwise(F.lit(REASON_BAD_VALUE)).alias("reason"))
    return keep, drop
