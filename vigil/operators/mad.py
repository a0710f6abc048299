"""Per-series sliding-window median / MAD anomaly detector (batch form).

For each point, in (timestamp, seq) order within its series, the window is the
last ``W`` values including the current one. With ``n`` values in the window:

* ``n < warmup``: all statistics are 0 and the point is not anomalous;
* baseline = median(window), mad = median(|x - baseline|), floored at
  ``min_mad`` (the floored value is reported);
* delta = K * (1.4826 * mad); upper/lower = baseline +/- delta;
* deadband: if ``min_delta > 0`` and |v - baseline| < min_delta, not anomalous;
* UP: v > upper, DOWN: v < lower, BOTH: either (all strict).

Spark plan
----------
The window is a ``collect_list`` over a bounded row frame, and the medians
are ``sort_array`` + ``element_at`` in generated code; everything stays on
the JVM.
The only exchange of the unchunked plan is the hash partitioning on the
series key.

Skew
----
A row frame needs every point of a series in one task, so one hot series
(say a third of all rows) would become one giant task. With chunking on,
a series is cut into time chunks (``floor(timestamp / chunk_seconds)``) and
the window runs per (series, chunk). Each chunk is given an exact *halo*:
the W-1 points that precede it in its series. Those points come only from
the last W-1 rows of earlier chunks. They are found through the per-chunk
row counts (a small table), which name the later chunks that a chunk's
last rows may feed; no step groups a whole series' rows. The first W-1
rows of a chunk prepend the halo to their own frame. The result is
identical to the unchunked plan, and the points are still shuffled once
(the halo-candidate branch reuses the window's exchange).

Idle-series reset
-----------------
``stale_gap_seconds`` drops the window when a series was silent for longer
than the gap (the service forgets series idle for an hour). Because a reset
only shortens the window, the frame is cut to the trailing elements of the
row's epoch. That count comes from plain window columns (a ``lag`` gap flag
and a running max of the last reset's row number). In chunked mode,
per-chunk halo summaries carry it across chunk boundaries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.config import MAD_CONSISTENCY, MODE_BOTH, MODE_DOWN, MadConfig
from vigil.functions.arrays import materialize, since_last_gap, sorted_median, tail
from vigil.schemas import SERIES_KEY
from vigil.session import store_table

ORDER_COLS = ("timestamp", "seq")
DEFAULT_TARGET_CHUNK_ROWS = 2_000_000


#: Seconds of a first-level bucket of a hot series.
BUCKET_SECONDS = 3600


@dataclass(frozen=True)
class ChunkPlan:
    """Where the hot series are cut. ``levels`` holds one to three tables of
    (keys, level columns, _cut): the chunk of each hour of a hot series, of each
    second of its dense hours (``_dense`` marks dense ones), and of each range of a
    dense second. ``placed`` are the rows of dense seconds, with the range and the
    chunk that their rank gives them; the third table is made from them."""
    keys: tuple[str, ...]
    levels: tuple[DataFrame, ...]
    placed: DataFrame | None = None


_LEVELS = ("_hour", "_second")


def _with_level(df: DataFrame, level: int) -> DataFrame:
    """Add a level's buckets: hours, and seconds of dense hours."""
    bucket = (F.floor(F.col("timestamp") / F.lit(BUCKET_SECONDS)), F.col("timestamp"))[level]
    return df.withColumn(_LEVELS[level], F.coalesce(bucket, F.lit(0)).cast("long"))


def _placed_rows(rows: DataFrame, dense: DataFrame, keys, target_rows: int) -> DataFrame:
    """The rows of dense seconds with their ``_range`` and ``_chunk``: each second is divided at
    quantiles of ``seq``, at most half a target apart. ``dense`` has the seconds
    with their size ``_c`` and the number ``_start`` of the series' rows before.

    The rows are dealt by range of (series, order), so that a row's rank in its
    second is its place within its partition plus the counts of the partitions
    before. The quantile below a rank is then arithmetic; no row is compared with
    a list of cuts, and no task takes a whole second."""
    second = [*keys, *_LEVELS]
    most = dense.agg(F.max("_c")).first()[0]
    parts = max(2, -(-2 * most // target_rows))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.join(dense.select(*second), second, "left_semi")
             .repartitionByRange(width, *second, *ORDER_COLS).sortWithinPartitions(*second, *ORDER_COLS))
    # within a sorted partition these ids count its rows; above them is its number
    ranked = store_table(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    ranked = ranked.withColumn("_part", F.shiftright("_at", 33))
    counts = ranked.groupBy(*second, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    by_part = Window.partitionBy(*second).orderBy("_part")
    counts = (counts.withColumn("_before", F.sum("_n").over(by_part) - F.col("_n"))
              .join(dense.select(*second, "_c", "_start"), second).drop("_n"))

    def edge(k):  # rank (from 1) of the k-th quantile
        return F.ceil(k / F.lit(float(parts)) * F.col("_c"))

    near = F.floor(F.col("_rank") * F.lit(parts) / F.col("_c"))
    k = F.when(edge(near + 1) <= F.col("_rank"), near + 1).when(edge(near) <= F.col("_rank"), near).otherwise(near - 1)
    return (ranked.join(counts, [*second, "_part"])
            .withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before") + 1)
            .withColumn("_range", F.greatest(F.least(k, F.lit(parts - 1)), F.lit(0)))
            .withColumn("_from", F.when(F.col("_range") < 1, F.lit(1)).otherwise(edge(F.col("_range"))))
            .withColumn("_chunk", F.floor((F.col("_start") + F.col("_from") - 1) / F.lit(target_rows)).cast("long"))
            .drop("_at", "_part", "_first", "_before", "_c", "_start", "_rank", "_from"))


def plan_chunks(points: DataFrame, keys=SERIES_KEY,
                target_rows: int = DEFAULT_TARGET_CHUNK_ROWS) -> ChunkPlan | None:
    """Decide how to cut series into chunks of at most twice ``target_rows``
    rows, whatever their distribution in time.

    Returns ``None`` when no series has more than ``target_rows`` points.
    Otherwise the *hot* series are counted by hour; hours above the target are
    counted again by second, and seconds above it are divided at quantiles of
    ``seq`` (of about half the target, however its numbers are spread). The
    buckets' running count in (timestamp, seq) order, divided by the target,
    numbers the chunks. Bursts, one stray old timestamp, or millions of
    points in one second are cut alike. All other series stay whole (chunk 0).

    Cost: a metadata-only count on parquet input, and when that exceeds
    ``target_rows`` one map-side combined aggregation, one more for dense hours,
    and one sort of the rows of dense seconds. The tables have one row per bucket
    of a hot series."""
    keys = list(keys)
    if points.count() <= target_rows:
        return None
    cols = list(_LEVELS)
    hours = store_table(_with_level(points, 0).groupBy(*keys, "_hour").agg(F.count(F.lit(1)).alias("_c")), "hours")
    hot = hours.groupBy(*keys).agg(F.sum("_c").alias("_s")).filter(F.col("_s") > target_rows).select(*keys)
    counts = [store_table(hours.join(hot, keys, "left_semi"), "hot-hours")]
    if not counts[0].limit(1).count():
        return None
    over = counts[0].filter(F.col("_c") > target_rows).select(*keys, "_hour")
    if over.limit(1).count():
        rows = _with_level(_with_level(points, 0).join(over, [*keys, "_hour"], "left_semi"), 1)
        counts.append(store_table(rows.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("_c")), "dense"))
    leaves = None
    for n, table in enumerate(counts):
        leaf = table if n == len(counts) - 1 else table.filter(F.col("_c") <= target_rows)
        leaf = leaf.select(*keys, *cols[:n + 1], *(F.lit(None).cast("long").alias(c) for c in cols[n + 1:]), "_c",
                           F.lit(n).alias("_level"))
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
    before = Window.partitionBy(*keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    leaves = store_table(leaves.withColumn("_cut", F.floor(F.col("_start") / F.lit(target_rows)).cast("long"))
                         .withColumn("_dense", F.col("_c") > target_rows), "cuts")
    tables, placed = [], None
    for n in range(len(counts)):
        table = leaves.filter(F.col("_level") == n)
        tables.append(table.select(*keys, *cols[:n + 1], "_cut", *(["_dense"] if n else [])))
    dense = leaves.filter(F.col("_dense"))
    if len(counts) > 1 and dense.limit(1).count():
        placed = _placed_rows(rows, dense, keys, target_rows)
        tables.append(placed.select(*keys, *cols, "_range", F.col("_chunk").alias("_cut")).distinct())
    return ChunkPlan(tuple(keys), tuple(tables), placed)


def _normalize_keys(points: DataFrame, keys) -> DataFrame:
    # Text columns of the data model are never NULL (missing = ''); making that
    # explicit keeps the series key usable as a plain equi-join key.
    out = points
    types = dict(points.dtypes)
    for k in keys:
        if types.get(k) == "string":
            out = out.withColumn(k, F.coalesce(F.col(k), F.lit("")))
    return out


def _chunk_table(pts: DataFrame, keys, w: int) -> DataFrame:
    """Small table: one row per (series, chunk) with the number of points of the
    series before it, and the later chunks that its last W-1 points may feed:
    those that begin less than W-1 positions after its last one."""
    wk = Window.partitionBy(*keys).orderBy("_chunk")
    near = Window.partitionBy(*keys).orderBy("_cum_prev").rangeBetween(0, w - 2)
    return (pts.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_cnt"))
            .withColumn("_cum_prev", F.coalesce(
                F.sum("_cnt").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_near", F.collect_list(F.struct("_chunk", "_cum_prev")).over(near))
            .withColumn("_fed", F.lead("_near").over(wk))
            .drop("_cnt", "_near"))


def _with_chunk(points: DataFrame, chunks: int | ChunkPlan) -> DataFrame:
    """Add ``_chunk``: ``floor(timestamp / width)`` with one global width
    (int), or the planned chunk of the hot series and 0 for every other one.
    The plan's tables are joined on series and bucket; Spark chooses the join
    by their size and splits skewed sides. Rows of dense seconds come placed. The column is non-nullable, so joins
    on it infer no extra filter that would make the candidate branch's exchange
    differ from the main one."""
    if isinstance(chunks, ChunkPlan):
        cols = list(_LEVELS[:len(chunks.levels)])
        j, cuts = points, []
        for n, table in enumerate(chunks.levels[:len(cols)]):
            j = _with_level(j, n)
            j = j.join(table.withColumnRenamed("_cut", f"_cut{n}"), [*chunks.keys, *cols[:n + 1]], "left")
            cuts.append(F.col(f"_cut{n}"))
        if chunks.placed is not None:
            j = j.filter(~F.coalesce(F.col("_dense"), F.lit(False)))
        number = F.coalesce(*cuts, F.lit(0).cast("long"))
        j = j.select(*points.columns, number.alias("_chunk"))
        if chunks.placed is not None:
            j = j.unionByName(chunks.placed.select(*points.columns, "_chunk"))
        if len(cols) > 1:  # large joins run once; the readers below scan the result
            j = _normalize_keys(store_table(j, "chunked"), chunks.keys)
        return j.withColumn("_chunk", F.coalesce(F.col("_chunk"), F.lit(0).cast("long")))
    return points.withColumn("_chunk", F.coalesce(
        F.floor(F.col("timestamp") / F.lit(int(chunks))), F.lit(0).cast("long")))


def _halo_rows(local: DataFrame, pts: DataFrame, keys, w: int, elem, whole: bool = False) -> DataFrame:
    """Halo rows routed to the chunk that needs them: (keys, _chunk = target
    chunk, _p = position in the series, _e = element, _all = whole row, or a
    hash of it).

    ``local`` must carry ``_rn`` / ``_cn`` (row number and size within its
    chunk). Candidates are the last W-1 rows of each chunk; one feeds a later
    chunk t when its position lies within the W-1 positions before t's first
    row. The chunk table names the later chunks that begin near enough, so a row
    is copied only for chunks whose windows hold it: at most W-1 rows arrive at
    each. ``_all`` depends on *all* input columns, which column pruning cannot
    drop; that keeps this branch's exchange identical to the main branch's, so
    Spark reuses the one shuffle of the points (ReusedExchange)."""
    pkey = [*keys, "_chunk"]
    cols = [F.col(c) for c in pts.columns if c != "_chunk"]
    payload = (F.struct(*cols) if whole else F.xxhash64(*cols)).alias("_all")
    fed = F.filter("_fed", lambda t: t["_cum_prev"] < F.col("_p") + (w - 1))
    return (local.filter(F.col("_rn") > F.col("_cn") - (w - 1))
            .select(*pkey, "_rn", elem.alias("_e"), payload)
            .join(_chunk_table(pts, keys, w).filter(F.col("_fed").isNotNull()), pkey)   # the last chunk feeds nobody
            .withColumn("_p", F.col("_cum_prev") + F.col("_rn"))
            .select(*keys, "_p", "_e", "_all", F.explode(fed).alias("_t"))
            .select(*keys, F.col("_t._chunk").alias("_chunk"), "_p", "_e", "_all"))


def _window_frames(points: DataFrame, cfg: MadConfig, keys, with_ts: bool,
                   chunk_seconds, *, gap: int | None = None) -> DataFrame:
    """Adds ``_frame``: the (up to) W most recent elements ending at each row,
    in order. Elements are ``value``, or struct(ts, v) with ``with_ts``.

    With an idle ``gap`` it also adds ``reset`` (the row follows a silence
    longer than the gap) and ``_keep`` (how many trailing frame elements
    belong to the row's epoch, i.e. come after the last reset). Both come
    from plain window columns: a ``lag`` gap flag, and a running ``max`` of
    the row number of the last reset. In chunked mode the first row of a
    chunk is compared with the halo's last timestamp, and the epoch may
    reach back into the halo. No higher-order function runs per row."""
    w = cfg.window_size
    ts, val = F.col("timestamp"), F.col("value")
    elem = F.struct(ts.alias("ts"), val.alias("v")) if with_ts else val
    order = [F.col(c) for c in ORDER_COLS]
    running = (Window.unboundedPreceding, 0)

    def gap_flag(spec):
        return F.coalesce((ts - F.lag(ts).over(spec)) > F.lit(int(gap)), F.lit(False))

    if chunk_seconds is None:
        ws = Window.partitionBy(*keys).orderBy(*order)
        out = points.withColumn("_frame", F.collect_list(elem).over(ws.rowsBetween(-(w - 1), 0)))
        if gap is None:
            return out
        out = (out.withColumn("reset", gap_flag(ws)).withColumn("_rn", F.row_number().over(ws)))
        out = out.withColumn("_lr", F.max(F.when(F.col("reset"), F.col("_rn")))
                             .over(ws.rowsBetween(*running)))
        return (out.withColumn("_keep", F.col("_rn") - F.coalesce(F.col("_lr"), F.lit(1)) + 1)
                .drop("_rn", "_lr"))

    pts = _with_chunk(points, chunk_seconds)
    pkey = [*keys, "_chunk"]
    ws = Window.partitionBy(*pkey).orderBy(*order)
    wp = Window.partitionBy(*pkey)
    local = (pts
             .withColumn("_own", F.collect_list(elem).over(ws.rowsBetween(-(w - 1), 0)))
             .withColumn("_rn", F.row_number().over(ws))
             .withColumn("_cn", F.count(F.lit(1)).over(wp)))
    if gap is not None:
        local = (local.withColumn("_lg", gap_flag(ws))
                 .withColumn("_lr", F.max(F.when(F.col("_lg"), F.col("_rn"))).over(ws.rowsBetween(*running)))
                 .withColumn("_cmin", F.min(ts).over(wp)))
    # the halo must hold at least the previous row when gaps are tracked
    hw = max(w, 2) if gap is not None else w
    if hw == 1:
        return local.withColumnRenamed("_own", "_frame").drop("_chunk", "_rn", "_cn")

    helem = F.struct(ts.alias("ts"), val.alias("v")) if gap is not None else elem
    halo = (_halo_rows(local, pts, keys, hw, helem)
            .groupBy(*pkey)
            .agg(F.sort_array(F.collect_list(F.struct("_p", "_e", "_all"))).alias("_halo")))
    # per-chunk halo summaries (one row per chunk; the only higher-order
    # functions of the plan run here, on the small side)
    he = F.transform("_halo", lambda h: h["_e"])
    if gap is not None:
        halo = halo.select(*pkey, F.transform(he, lambda e: e["v"]).alias("_hvals"),
                           F.element_at(he, -1)["ts"].alias("_hlast"),
                           F.size(since_last_gap(he, int(gap))).alias("_hkeep"))
    else:
        halo = halo.select(*pkey, he.alias("_hvals"))

    joined = local.join(halo, pkey, "left")
    frame = F.when(F.col("_hvals").isNull() | (F.col("_rn") >= w), F.col("_own")).otherwise(
        tail(F.concat(F.col("_hvals"), F.col("_own")), w))
    out = joined.withColumn("_frame", frame)
    if gap is not None:
        cgap = F.coalesce(F.col("_hvals").isNotNull()
                          & ((F.col("_cmin") - F.col("_hlast")) > F.lit(int(gap))), F.lit(False))
        out = (out.withColumn("reset", F.when(F.col("_rn") == 1, cgap).otherwise(F.col("_lg")))
               .withColumn("_keep", F.when(F.col("_lr").isNotNull(), F.col("_rn") - F.col("_lr") + 1)
                           .when(cgap, F.col("_rn"))
                           .otherwise(F.col("_rn") + F.coalesce(F.col("_hkeep"), F.lit(0))))
               .drop("_lg", "_lr", "_cmin", "_hlast", "_hkeep"))
    return out.drop("_chunk", "_rn", "_cn", "_own", "_hvals")


def _numpy_kernel(cfg: MadConfig, gap: int | None, group: list[str], columns: list[str], kinds):
    """Scores sorted Arrow batches; the window of a group that goes on in the next
    batch is carried over, so that memory is a batch and a window. Rows that are
    not ``_own`` fill windows and are not returned."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from vigil.functions.kernels import window_stats_batch

    def run(batches):
        last, history, last_ts = None, np.zeros(0), None
        for b in batches:
            if not b.num_rows:
                continue
            heads = list(zip(*(b.column(c).to_pylist() for c in group), strict=True))
            starts = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1])]
            values = pc.cast(b.column("value"), pa.float64()).to_numpy(zero_copy_only=False)
            ts = pc.fill_null(pc.cast(b.column("timestamp"), pa.int64()), -2 ** 63).to_numpy(zero_copy_only=False)
            found = []
            for i, j in zip(starts, [*starts[1:], len(heads)], strict=True):
                if heads[i] != last:
                    last, history, last_ts = heads[i], np.zeros(0), None
                r = window_stats_batch(history, np.zeros(0), values[i:j], ts[i:j], cfg, gap, last_ts)
                found.append(r[:7])
                history, last_ts = r[7:]
            stats = [pa.array(np.concatenate(c), k) for c, k in zip(zip(*found, strict=True), kinds.values(), strict=True)]
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *stats], [*columns, *kinds])
            if "_own" in b.schema.names:
                out = out.filter(b.column("_own"))
            yield out

    return run


def _numpy_detect(pts: DataFrame, cfg: MadConfig, keys, gap: int | None,
                  chunk_seconds) -> DataFrame:
    """``engine="numpy"``: the same detector with the numpy kernel over Arrow
    batches of the sorted (series, chunk) groups, whatever their length. The
    rows of a chunk's halo precede its own, and fill its first windows."""
    import pyarrow as pa

    cols = pts.columns
    kinds = {"n": pa.int32(), "baseline": pa.float64(), "mad": pa.float64(), "lower": pa.float64(),
             "upper": pa.float64(), "is_anomaly": pa.bool_(), "reset": pa.bool_()}
    types = (T.IntegerType(), *[T.DoubleType()] * 4, *[T.BooleanType()] * 2)
    schema = T.StructType([pts.schema[c] for c in cols] + [T.StructField(n, t) for n, t in zip(kinds, types, strict=True)])
    order = [F.col(c).asc_nulls_last() for c in ORDER_COLS]
    if chunk_seconds is None:
        rows = pts.repartition(*keys).sortWithinPartitions(*keys, *order)
        return rows.mapInArrow(_numpy_kernel(cfg, gap, keys, cols, kinds), schema)

    w = cfg.window_size
    cp = _with_chunk(pts, chunk_seconds)
    pkey = [*keys, "_chunk"]
    rows = cp.withColumn("_own", F.lit(True)).withColumn("_p", F.lit(None).cast("long"))
    if w > 1:
        ws = Window.partitionBy(*pkey).orderBy(*[F.col(c) for c in ORDER_COLS])
        local = (cp.withColumn("_rn", F.row_number().over(ws))
                 .withColumn("_cn", F.count(F.lit(1)).over(Window.partitionBy(*pkey))))
        halo = _halo_rows(local, cp, keys, w, F.col("value"), whole=True)
        rows = rows.unionByName(halo.select(*[F.col(f"_all.{c}").alias(c) for c in cols], "_chunk",
                                            F.lit(False).alias("_own"), F.col("_p").cast("long").alias("_p")))
    rows = rows.repartition(*pkey).sortWithinPartitions(*pkey, "_own", "_p", *order)
    return rows.mapInArrow(_numpy_kernel(cfg, gap, pkey, cols, kinds), schema)


def mad_detect(points: DataFrame, cfg: MadConfig | None = None, *, keys=SERIES_KEY,
               stale_gap_seconds: int | None = None,
               chunk_seconds: int | str | None = "auto",
               target_chunk_rows: int = DEFAULT_TARGET_CHUNK_ROWS,
               engine: str = "sql") -> DataFrame:
    """Score every point; adds n, baseline, mad, lower, upper, is_anomaly
    (and ``reset`` when ``stale_gap_seconds`` is given).

    ``points`` needs the series key columns, ``timestamp`` (unix seconds),
    ``seq`` (unique tie-breaker) and ``value``. ``chunk_seconds``: ``"auto"``
    cuts only the series with more than ``target_chunk_rows`` points, by
    counts (see ``plan_chunks``); ``None`` disables chunking; an int cuts every
    series with that width.

    ``engine="sql"`` (default) keeps everything in built-in expressions;
    ``engine="numpy"`` runs the same arithmetic with the numpy kernel over
    Arrow batches of the (series, chunk) groups — identical results, similar
    speed at sf0.1 in local tests. ``engine="rolling"`` follows each series
    with a sorted window (``vigil.operators.rolling``): for windows of
    thousands of points; it cuts long series by rank, not by ``chunk_seconds``.
    """
    if points.isStreaming:
        raise ValueError("mad_detect is the batch form; use "
                         "vigil.streaming.detector.stream_mad_detect for streams")
    cfg = (cfg or MadConfig.library_defaults()).normalized()
    keys = list(keys)
    stale = stale_gap_seconds is not None
    pts = _normalize_keys(points, keys)
    if engine == "rolling":
        from vigil.operators.rolling import rolling_detect
        out = rolling_detect(pts, cfg, keys=keys, stale_gap_seconds=stale_gap_seconds, target_chunk_rows=target_chunk_rows)
        return out if stale else out.drop("reset")
    if isinstance(chunk_seconds, str) and chunk_seconds == "auto":
        chunk_seconds = plan_chunks(pts, keys, target_chunk_rows)
    if engine == "numpy":
        out = _numpy_detect(pts, cfg, keys, stale_gap_seconds, chunk_seconds)
        return out if stale else out.drop("reset")
    if engine != "sql":
        raise ValueError(f"unknown engine {engine!r}")

    framed = _window_frames(pts, cfg, keys, False, chunk_seconds, gap=stale_gap_seconds)
    if stale:
        # the row's window: the trailing elements of its epoch
        fr = F.col("_frame")
        n = F.least(F.col("_keep"), F.size(fr))
        framed = framed.withColumn("_vals", F.slice(fr, F.size(fr) - n + 1, n)).drop("_keep")
    else:
        framed = framed.withColumnRenamed("_frame", "_vals")
    return _score(framed.drop("_frame"), cfg)


def _score(df: DataFrame, cfg: MadConfig) -> DataFrame:
    """Detector outputs from the frame column ``_vals``.

    The sorted frame, baseline, sorted deviations and raw MAD are separate
    projections, so ``sort_array`` runs in generated code (a primitive sort
    of the double array) and the optimizer keeps each expensive column
    computed once (it will not inline a non-cheap column referenced several
    times). The three statistics then pass a generator
    (``explode(array(struct))``): a later ``is_anomaly`` filter cannot be
    pushed below it, so the sort chain is never substituted into the filter
    condition. Everything after the barrier is cheap arithmetic."""
    keep = [c for c in df.columns if c != "_vals"]
    stats = (df.withColumn("_n", F.size("_vals"))
             .withColumn("_sorted", F.sort_array("_vals"))
             .withColumn("_base", sorted_median(F.col("_sorted")))
             .withColumn("_devs", F.sort_array(F.transform("_vals", lambda x: F.abs(x - F.col("_base")))))
             .withColumn("_mad0", sorted_median(F.col("_devs")))
             .select(*keep, F.struct("_n", "_base", "_mad0").alias("_s")))
    stats = materialize(stats, "_bm", F.col("_s")).drop("_s")

    v = F.col("value")
    n, base, mad0 = F.col("_bm._n"), F.col("_bm._base"), F.col("_bm._mad0")
    zero = F.lit(0.0)
    warm = n < F.lit(cfg.warmup)
    mad_f = F.when(mad0 < F.lit(cfg.min_mad), F.lit(cfg.min_mad)).otherwise(mad0)
    delta = F.lit(cfg.threshold_k) * (F.lit(MAD_CONSISTENCY) * mad_f)
    upper, lower = base + delta, base - delta
    mode = cfg.effective_mode
    if mode == MODE_DOWN:
        hit = v < lower
    elif mode == MODE_BOTH:
        hit = (v > upper) | (v < lower)
    else:
        hit = v > upper
    if cfg.min_delta > 0:
        hit = hit & ~(F.abs(v - base) < F.lit(cfg.min_delta))
    return stats.select(
        *keep,
        n.cast(T.IntegerType()).alias("n"),
        F.when(warm, zero).otherwise(base).alias("baseline"),
        F.when(warm, zero).otherwise(mad_f).alias("mad"),
        F.when(warm, zero).otherwise(lower).alias("lower"),
        F.when(warm, zero).otherwise(upper).alias("upper"),
        (~warm & hit).alias("is_anomaly"))


def detect_anomalies(points: DataFrame, cfg: MadConfig | None = None, **kw) -> DataFrame:
    """Anomalous points only, with the stored threshold: the lower bound when
    the value fell below it, else the upper bound."""
    scored = mad_detect(points, cfg, **kw)
    return (scored.filter("is_anomaly")
            .withColumn("threshold", F.when(F.col("value") < F.col("lower"), F.col("lower"))
                        .otherwise(F.col("upper"))))


def stale_resets_per_series(scored: DataFrame, keys=SERIES_KEY) -> DataFrame:
    """Number of idle-gap resets per series (needs ``mad_detect`` output with
    ``stale_gap_seconds``). A plain aggregate, partially combined map-side."""
    return scored.groupBy(*keys).agg(F.sum(F.col("reset").cast("long")).alias("resets"),
                                     F.count(F.lit(1)).alias("points"))

