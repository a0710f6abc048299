"""Rolling median / MAD for windows of any size and series of any length.

The expression engine of ``vigil.operators.mad`` builds an array of W values for
every row and sorts it twice. Here a window is a sorted structure that follows
the series: a row costs one insertion, one removal, the middle elements, and a
binary search for the median deviation, and memory is one window, whatever the
number of rows.

Series longer than ``target_chunk_rows`` are cut by rank. Their rows are dealt
by range of (series, order), so a row's rank is its place within its partition
plus the counts of the partitions before; neither gaps in time nor in ``seq``
matter, and no task sorts or counts a whole series. Chunks are equal runs of
ranks, and the W - 1 last rows of a chunk also go to the next one, to fill its
window (chunks hold at least 2 W rows).

Rows may carry a phase (``PHASE``) that precedes time in the order: rows of
phase 0 are earlier history, in order of ``seq`` alone; it fills windows and is
not returned.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.config import MAD_CONSISTENCY, MODE_BOTH, MODE_DOWN, MadConfig
from vigil.schemas import SERIES_KEY
from vigil.session import store_table

PHASE = "_phase"
_TIME = "_time"
ORDER = (PHASE, _TIME, "seq")
#: Column of a series' last row with the window it leaves behind.
TAIL = "_tail"
_TAIL_TYPE = "array<struct<ts:bigint,v:double>>"


class SortedWindow:
    """A multiset of numbers in sorted blocks, with access by rank."""

    LOAD = 512

    def __init__(self):
        self.blocks: list[list[float]] = []
        self.tops: list[float] = []
        self.starts: list[int] | None = None
        self.size = 0

    def add(self, x: float) -> None:
        self.size += 1
        self.starts = None
        if not self.blocks:
            self.blocks, self.tops = [[x]], [x]
            return
        i = min(bisect_left(self.tops, x), len(self.blocks) - 1)
        block = self.blocks[i]
        insort(block, x)
        if len(block) > 2 * self.LOAD:
            self.blocks[i:i + 1] = [block[:self.LOAD], block[self.LOAD:]]
            self.tops[i:i + 1] = [block[self.LOAD - 1], block[-1]]
        else:
            self.tops[i] = block[-1]

    def remove(self, x: float) -> None:
        self.size -= 1
        self.starts = None
        i = bisect_left(self.tops, x)
        block = self.blocks[i]
        del block[bisect_left(block, x)]
        if block:
            self.tops[i] = block[-1]
        else:
            del self.blocks[i], self.tops[i]

    def __getitem__(self, k: int) -> float:
        if len(self.blocks) == 1:
            return self.blocks[0][k]
        if self.starts is None:
            self.starts = [0, *accumulate(map(len, self.blocks))]
        i = bisect_right(self.starts, k) - 1
        return self.blocks[i][k - self.starts[i]]

    def median(self) -> float:
        n = self.size
        if n % 2:
            return self[n // 2]
        return (self[n // 2 - 1] + self[n // 2]) / 2

    def mad(self, middle: float) -> float:
        """Median of the distances from ``middle``. The k nearest values are a
        run of the sorted ones; its start is found by comparing both ends."""
        n = self.size
        k = (n + 1) // 2
        a, b = 0, n - k
        while a < b:
            at = (a + b) // 2
            if middle - self[at] > self[at + k] - middle:
                a = at + 1
            else:
                b = at
        far = max(abs(middle - self[a]), abs(self[a + k - 1] - middle))
        if n % 2:
            return far
        beyond = [abs(middle - self[a - 1])] if a else []
        if a + k < n:
            beyond.append(abs(self[a + k] - middle))
        return (far + min(beyond)) / 2


class Detector:
    """One series' window, and the statistics of each row that enters it."""

    def __init__(self, cfg: MadConfig, gap: int | None):
        self.cfg, self.gap = cfg, gap
        self.rows: deque[tuple[int, float]] = deque()
        self.window = SortedWindow()

    def enter(self, ts: int, value: float) -> bool:
        """Add a row; true if it follows a silence longer than the gap."""
        reset = self.gap is not None and bool(self.rows) and ts - self.rows[-1][0] > self.gap
        if reset:
            self.rows.clear()
            self.window = SortedWindow()
        elif len(self.rows) == self.cfg.window_size:
            self.window.remove(self.rows.popleft()[1])
        self.rows.append((ts, value))
        self.window.add(value)
        return reset

    def stats(self, value: float) -> tuple:
        """(n, baseline, mad, lower, upper, is_anomaly) of the last row."""
        cfg, n = self.cfg, self.window.size
        if n < cfg.warmup:
            return n, 0.0, 0.0, 0.0, 0.0, False
        base = self.window.median()
        mad = self.window.mad(base)
        if mad < cfg.min_mad:
            mad = cfg.min_mad
        delta = cfg.threshold_k * (MAD_CONSISTENCY * mad)
        upper, lower = base + delta, base - delta
        above, below = value > upper, value < lower
        hit = below if cfg.effective_mode == MODE_DOWN else above or below if cfg.effective_mode == MODE_BOTH else above
        if cfg.min_delta > 0 and abs(value - base) < cfg.min_delta:
            hit = False
        return n, base, mad, lower, upper, hit


def ranked_chunks(points: DataFrame, keys, window: int, target_rows: int) -> DataFrame:
    """Rows with ``_chunk``, ``_own`` (false for copies that only fill the next
    chunk's window) and ``_end`` (the series' last row). Series of up to
    ``target_rows`` rows are one chunk."""
    keys = list(keys)
    sizes = store_table(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"),
                                                  F.max(F.struct(*ORDER)).alias("_last")), "series-sizes")
    end = F.struct(*ORDER) == F.col("_last")
    hot = sizes.filter(F.col("_total") > target_rows)
    whole = (points.join(sizes.filter(F.col("_total") <= target_rows), keys)
             .withColumn("_chunk", F.lit(0).cast("long")).withColumn("_own", F.lit(True)).withColumn("_end", end)
             .select(*points.columns, "_chunk", "_own", "_end"))
    if not hot.limit(1).count():
        return whole
    step = max(int(target_rows), 2 * window)
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (points.join(hot.select(*keys), keys, "left_semi")
             .repartitionByRange(width, *keys, *ORDER).sortWithinPartitions(*keys, *ORDER))
    # within a sorted partition these ids count its rows; above them is its number
    placed = store_table(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    by_part = Window.partitionBy(*keys).orderBy("_part")
    counts = counts.withColumn("_before", F.sum("_n").over(by_part) - F.col("_n")).drop("_n")
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    chunk, place = F.floor(F.col("_rank") / step), F.col("_rank") % step
    own = F.struct(chunk.alias("_chunk"), F.lit(True).alias("_own"))
    halo = F.struct((chunk + 1).alias("_chunk"), F.lit(False).alias("_own"))
    feeds = (place >= step - (window - 1)) & (chunk < F.floor((F.col("_total") - 1) / step))
    cut = (placed.join(counts, [*keys, "_part"]).join(hot, keys).withColumn("_rank", rank)
           .withColumn("_c", F.explode(F.when(feeds, F.array(own, halo)).otherwise(F.array(own))))
           .withColumn("_end", end & F.col("_c._own"))
           .select(*points.columns, "_c._chunk", "_c._own", "_end"))
    return whole.unionByName(cut)


def _kernel(cfg: MadConfig, gap: int | None, keys: list[str], columns: list[str], tails: bool):
    keep = cfg.window_size - 1

    def run(batches):
        last, det = None, None
        for b in batches:
            head = [b.column(k).to_pylist() for k in [*keys, "_chunk"]]
            ts, values, own, phase, end = (b.column(c).to_pylist() for c in ("timestamp", "value", "_own", PHASE, "_end"))
            take, out, left = [], [], []
            for i, group in enumerate(zip(*head, strict=True)):
                if group != last:
                    last, det = group, Detector(cfg, gap)
                reset = det.enter(ts[i], values[i])
                if own[i] and phase[i]:
                    take.append(i)
                    out.append((*det.stats(values[i]), reset))
                    if tails:
                        rest = list(det.rows)
                        left.append([{"ts": t, "v": v} for t, v in rest[-keep:]] if end[i] and keep else
                                    [{"ts": t, "v": v} for t, v in rest[-1:]] if end[i] else None)
            if take:
                rows = b.take(pa.array(take))
                kinds = [pa.int32(), *[pa.float64()] * 4, pa.bool_(), pa.bool_()]
                got = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                names = [*columns, "n", "baseline", "mad", "lower", "upper", "is_anomaly", "reset"]
                if tails:
                    got.append(pa.array(left, pa.list_(pa.struct([("ts", pa.int64()), ("v", pa.float64())]))))
                    names.append(TAIL)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *got], names)

    return run


def rolling_detect(points: DataFrame, cfg: MadConfig, *, keys=SERIES_KEY, stale_gap_seconds: int | None = None,
                   target_chunk_rows: int = 2_000_000, tails: bool = False) -> DataFrame:
    """Every point (of phase 1, if there are phases) with n, baseline, mad,
    lower, upper, is_anomaly and reset, as ``mad_detect`` computes them; with
    ``tails``, a series' last row also holds the window it leaves. Values are
    never null (ingest sees to that)."""
    cfg = cfg.normalized()
    keys = list(keys)
    columns = [c for c in points.columns if c != PHASE]
    pts = points if PHASE in points.columns else points.withColumn(PHASE, F.lit(1))
    pts = pts.withColumn(_TIME, F.when(F.col(PHASE) == 0, F.lit(0).cast("long")).otherwise(F.col("timestamp")))
    rows = ranked_chunks(pts, keys, cfg.window_size, target_chunk_rows)
    rows = (rows.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", *ORDER))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name != PHASE)
    schema += ", n int, baseline double, mad double, lower double, upper double, is_anomaly boolean, reset boolean"
    if tails:
        schema += f", {TAIL} {_TAIL_TYPE}"
    return rows.mapInArrow(_kernel(cfg, stale_gap_seconds, keys, columns, tails), schema)
