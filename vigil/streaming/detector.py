"""Streaming detector: keyed state with ``transformWithState``.

Each series key owns a value state holding its window (the last W values,
arrival order) and the timestamp of its last point. Rows of a key inside a
micro-batch are ordered by (timestamp, seq) before they update the window,
so on the same input the stream produces exactly the batch result
(``vigil.operators.mad.mad_detect``). State lives in the RocksDB state store
and survives restarts through the checkpoint; ``state_ttl_ms`` expires the
windows of series idle in processing time (the service drops series idle for
an hour), bounding state size.

Per-key work is a handful of float operations on at most W values; the
partitioning by series key (one exchange) and the state management are
Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigil.config import MadConfig
from vigil.functions.kernels import window_stats, window_stats_batch
from vigil.schemas import SERIES_KEY

_STATE_SCHEMA = T.StructType([
    T.StructField("vals", T.ArrayType(T.DoubleType(), False)),
    T.StructField("last_ts", T.LongType()),
])
STATS_SCHEMA = [
    T.StructField("n", T.IntegerType()),
    T.StructField("baseline", T.DoubleType()),
    T.StructField("mad", T.DoubleType()),
    T.StructField("lower", T.DoubleType()),
    T.StructField("upper", T.DoubleType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("reset", T.BooleanType()),
]
_STATS_NAMES = tuple(f.name for f in STATS_SCHEMA)


class MadStateProcessor(StatefulProcessor):
    def __init__(self, cfg: MadConfig, columns: list[str], stale_gap_seconds: int | None = None,
                 state_ttl_ms: int | None = None):
        self.cfg = cfg.normalized()
        self.columns = columns
        self.gap = stale_gap_seconds
        self.ttl = state_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", _STATE_SCHEMA, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        w = self.cfg.window_size
        if self.window.exists():
            vals, last_ts = self.window.get()
            vals = list(vals)
        else:
            vals, last_ts = [], None
        for r in sorted(rows, key=lambda r: (r["timestamp"], r["seq"])):
            reset = False
            if self.gap is not None and last_ts is not None and r["timestamp"] - last_ts > self.gap:
                vals, reset = [], True
            vals.append(float(r["value"]))
            if len(vals) > w:
                del vals[: len(vals) - w]
            stats = window_stats(vals, float(r["value"]), self.cfg)
            last_ts = r["timestamp"]
            out = {c: r[c] for c in self.columns}
            out.update(zip(_STATS_NAMES, (*stats, reset)))
            yield Row(**out)
        self.window.update((vals, last_ts))

    def close(self) -> None:
        pass


def stream_mad_detect(points: DataFrame, cfg: MadConfig | None = None, *,
                      stale_gap_seconds: int | None = None,
                      state_ttl_ms: int | None = None, vectorized: bool = True) -> DataFrame:
    """Streaming twin of ``mad_detect``: every point with its statistics
    (plus ``reset``). ``points`` is a streaming (or batch) frame of metric
    points with ``seq``. ``vectorized`` uses the numpy form over Arrow
    batches (``transformWithStateInPandas``); otherwise the row form.
    ``state_ttl_ms`` switches the query to processing-time mode (state
    expiry); run such queries on a processing-time trigger (they do not end
    under ``availableNow``)."""
    cfg = (cfg or MadConfig.library_defaults()).normalized()
    cols = points.columns
    out = T.StructType([points.schema[c] for c in cols] + STATS_SCHEMA)
    time_mode = "ProcessingTime" if state_ttl_ms else "None"
    grouped = points.groupBy(*SERIES_KEY)
    if vectorized:
        proc = MadStateProcessorPandas(cfg, cols, stale_gap_seconds, state_ttl_ms)
        return grouped.transformWithStateInPandas(proc, out, "Append", time_mode)
    proc = MadStateProcessor(cfg, cols, stale_gap_seconds, state_ttl_ms)
    return grouped.transformWithState(proc, out, "Append", time_mode)


#: Rows of a key that are scored and handed on at a time.
SLICE_ROWS = 10_000


def _packed(column):
    """A column of a pandas batch without an object per row, if it is text."""
    import pyarrow as pa
    if column.dtype == object and all(v is None or isinstance(v, str) for v in column):
        return pa.array(column.tolist(), pa.large_string())
    return column.to_numpy()


def _joined(parts: list):
    import pyarrow as pa
    if not any(isinstance(p, pa.Array) for p in parts):
        return np.concatenate(parts)
    if all(isinstance(p, pa.Array) for p in parts):
        return pa.concat_arrays(parts)
    return np.concatenate([p.to_numpy(zero_copy_only=False) if isinstance(p, pa.Array) else p for p in parts])


def _taken(column, rows: np.ndarray):
    """Rows of a joined column, as pandas takes them."""
    import pyarrow as pa
    return column.take(pa.array(rows)).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column[rows]


class MadStateProcessorPandas(StatefulProcessor):
    """The same detector over pandas batches (numpy-vectorised per key). A key's
    rows of a micro-batch are kept as packed columns, since they must be sorted;
    windows and output are made by slices of them."""

    def __init__(self, cfg: MadConfig, columns: list[str], stale_gap_seconds: int | None = None,
                 state_ttl_ms: int | None = None):
        self.cfg = cfg.normalized()
        self.columns = columns
        self.gap = stale_gap_seconds
        self.ttl = state_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", _STATE_SCHEMA, self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        same = dict(zip(SERIES_KEY, key))
        parts: dict[str, list] = {c: [] for c in self.columns if c not in same}
        for pdf in rows:
            for c, kept in parts.items():
                kept.append(_packed(pdf[c]))
        packed = {c: _joined(parts.pop(c)) for c in list(parts)}
        order = np.lexsort((packed["seq"], packed["timestamp"]))
        if self.window.exists():
            vals, last_ts = self.window.get()
            history = np.asarray(list(vals), dtype=float)
        else:
            history, last_ts = np.zeros(0), None
        for i in range(0, len(order), SLICE_ROWS):
            at = order[i:i + SLICE_ROWS]
            res = window_stats_batch(history, np.zeros(0), packed["value"][at].astype(float),
                                     packed["timestamp"][at].astype(np.int64), self.cfg, self.gap, last_ts)
            history, last_ts = res[7:]
            out = {c: [same[c]] * len(at) if c in same else _taken(packed[c], at) for c in self.columns}
            yield pd.DataFrame({**out, **dict(zip(_STATS_NAMES, res[:7]))})
        self.window.update((history.tolist(), last_ts))

    def close(self) -> None:
        pass
