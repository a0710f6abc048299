"""Read queries over the read-model tables.

* optional filters: a parameter that is ``None`` (or the empty string) adds
  no predicate, otherwise equality — only given predicates are added, so
  Catalyst pushes exactly those into the scan;
* time range ``from_ts <= ts <= to_ts``, each end optional; on a stored,
  date-partitioned table the range also prunes ``event_date`` partitions;
* ``list_anomalies``: newest first (``ts DESC``, ties by ``id DESC``),
  limit <= 0 -> 100, > 1000 -> 1000, offset < 0 -> 0; planned as a top-k
  (``TakeOrderedAndProject``), never a full sort;
* ``list_series``: ``updated_at DESC`` (ties by arrival), limit <= 0 -> 200,
  no upper cap and no offset;
* ``get_series_state``: a ``source|metric|env|region`` key (exactly four
  parts, parts may be empty) -> 0 or 1 row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.envelope import rfc3339
from vigil.schemas import LIST_ANOMALIES_COLUMNS, SERIES_KEY

ANOMALY_LIMIT_DEFAULT, ANOMALY_LIMIT_MAX = 100, 1000
SERIES_LIMIT_DEFAULT = 200
_INT32 = (-(2 ** 31), 2 ** 31 - 1)


def _opt(v):
    return None if v is None or v == "" else v


def parse_int_param(raw: str | None, default: int) -> int:
    """Query-string integer: empty or unparsable -> default; out of 32-bit
    range -> error (instead of silently wrapping)."""
    if raw is None or raw == "":
        return default
    try:
        v = int(raw)
    except ValueError:
        return default
    if not _INT32[0] <= v <= _INT32[1]:
        raise ValueError(f"integer parameter out of range: {raw}")
    return v


def parse_bound(raw: int | str | None) -> int | None:
    """A time bound of a request: a 64-bit integer or its text; anything else
    means that no bound is given."""
    try:
        v = int(raw)
    except (TypeError, ValueError):
        return None
    return v if -(1 << 63) <= v < 1 << 63 else None


def clamp_anomaly_page(limit: int | str | None, offset: int | str | None) -> tuple[int, int]:
    limit = parse_int_param(limit, 0) if isinstance(limit, str) else limit
    offset = parse_int_param(offset, 0) if isinstance(offset, str) else offset
    lim = ANOMALY_LIMIT_DEFAULT if limit is None or limit <= 0 else min(limit, ANOMALY_LIMIT_MAX)
    off = 0 if offset is None or offset < 0 else offset
    return lim, off


def _filters(df: DataFrame, **eq) -> DataFrame:
    for col, val in eq.items():
        val = _opt(val)
        if val is not None:
            df = df.filter(F.col(col) == F.lit(val))
    return df


def list_anomalies(events: DataFrame, *, from_ts: int | str | None = None, to_ts: int | str | None = None,
                   source: str | None = None, metric_name: str | None = None,
                   env: str | None = None, region: str | None = None,
                   instance_id: str | None = None, limit: int | str | None = None,
                   offset: int | str | None = None) -> DataFrame:
    from_ts, to_ts = parse_bound(from_ts), parse_bound(to_ts)
    lim, off = clamp_anomaly_page(limit, offset)
    df = _filters(events, source=source, metric_name=metric_name, env=env, region=region,
                  instance_id=instance_id)
    has_date = "event_date" in events.columns
    if from_ts is not None:
        df = df.filter(F.col("ts") >= F.lit(int(from_ts)))
        if has_date:
            df = df.filter(F.col("event_date") >= F.to_date(F.timestamp_seconds(F.lit(int(from_ts)))))
    if to_ts is not None:
        df = df.filter(F.col("ts") <= F.lit(int(to_ts)))
        if has_date:
            df = df.filter(F.col("event_date") <= F.to_date(F.timestamp_seconds(F.lit(int(to_ts)))))
    page = df.orderBy(F.col("ts").desc(), F.col("id").desc())
    if off:
        page = page.offset(off)
    return page.limit(lim).select(*LIST_ANOMALIES_COLUMNS)


def list_series(state: DataFrame, *, source: str | None = None, metric_name: str | None = None,
                env: str | None = None, region: str | None = None,
                limit: int | None = None) -> DataFrame:
    lim = SERIES_LIMIT_DEFAULT if limit is None or limit <= 0 else limit
    df = _filters(state, source=source, metric_name=metric_name, env=env, region=region)
    order = [F.col("updated_at").desc()]
    if "last_seq" in state.columns:
        order.append(F.col("last_seq").desc())
    return (df.orderBy(*order).limit(lim)
            .select(*SERIES_KEY, "last_ts", "last_value", "baseline", "mad", "threshold",
                    "window_size", "threshold_k", "detector", "producer", "trace_id",
                    rfc3339(F.col("updated_at")).alias("updated_at")))


def parse_series_key(key: str) -> tuple[str, str, str, str]:
    """``source|metric|env|region`` -> 4-tuple; anything but exactly four
    parts is an error. No escaping; parts may be empty."""
    parts = key.split("|")
    if len(parts) != 4:
        raise ValueError(f"series key must have 4 '|'-separated parts, got {len(parts)}")
    return parts[0], parts[1], parts[2], parts[3]


def get_series_state(state: DataFrame, key: str) -> DataFrame:
    """0 rows = not found, else the one state row (15 served columns)."""
    src, metric, env, region = parse_series_key(key)
    cond = ((F.col("source") == src) & (F.col("metric_name") == metric)
            & (F.col("env") == env) & (F.col("region") == region))
    return (state.filter(cond)
            .select(*SERIES_KEY, "last_ts", "last_value", "baseline", "mad", "threshold",
                    "window_size", "threshold_k", "detector", "producer", "trace_id",
                    rfc3339(F.col("updated_at")).alias("updated_at")))


def split_series_key_col(key_col: str = "series_key") -> list:
    """Column form of the key parse, for keys held in a table: the 4 parts
    and a validity flag (exactly four parts)."""
    parts = F.split(F.col(key_col), r"\|", -1)
    return [F.when(F.size(parts) == 4, parts[i]).alias(n) for i, n in enumerate(SERIES_KEY)] + \
        [(F.size(parts) == 4).alias("key_valid")]
