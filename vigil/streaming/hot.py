"""Streaming detector for series that outgrow a task.

The keyed detector (``vigil.streaming.detector``) gives all of a series' rows of
a micro-batch to one task. ``WindowedDetector`` is a ``foreachBatch`` handler
that keeps each series' window - its last W - 1 rows - in a stored, keyed table
and scores a micro-batch with the rolling detector: the stored window precedes
the batch's rows, and a series of more than ``target_chunk_rows`` rows is cut
into chunks that several tasks take, each with the rows its window needs. The
results of a series that holds most of the stream are those of one window that
followed it row by row.

Rows are ordered by (timestamp, seq) within a micro-batch and by micro-batch
beyond, as in the keyed detector. Results and windows are written per batch id,
so a batch that runs again after a failure overwrites its own and changes
nothing else.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.config import MadConfig
from vigil.operators.rolling import PHASE, TAIL, rolling_detect
from vigil.schemas import SERIES_KEY
from vigil.session import fresh_subdir
from vigil.streaming.jobs import run_available_now
from vigil.streaming.store import BUCKETS, KeyedStore, drop_path


class WindowedDetector:
    """``delay_seconds`` puts points in event-time order: the watermark is the
    newest timestamp so far less the delay; points above it wait in a stored
    buffer, those that arrive at or below an earlier watermark go to ``late``,
    and the others are scored in (timestamp, seq) order. ``flush`` releases what
    still waits when the input ends.

    ``expire_seconds`` drops the windows of series whose last point is older
    than the watermark (without a delay: the newest timestamp) by more than
    that, and lists them in ``expired``; their next point begins a new window.
    """

    def __init__(self, root: str, cfg: MadConfig, *, stale_gap_seconds: int | None = None,
                 target_chunk_rows: int = 2_000_000, compact_every: int = 20, buckets: int = BUCKETS,
                 delay_seconds: int | None = None, expire_seconds: int | None = None, keys=SERIES_KEY):
        self.root, self.cfg, self.keys = root.rstrip("/"), cfg.normalized(), list(keys)
        self.gap, self.target, self.compact_every = stale_gap_seconds, target_chunk_rows, compact_every
        self.delay, self.expire = delay_seconds, expire_seconds
        self.windows = KeyedStore(f"{self.root}/windows", self.keys,
                                  f"last_ts long, {TAIL} array<struct<ts:bigint,v:double>>", buckets=buckets,
                                  live=f"size({TAIL}) > 0")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.compact_every and batch_id and batch_id % self.compact_every == 0:
            self.windows.compact(spark, batch_id - 1)
        points = batch
        for k in self.keys:
            points = points.withColumn(k, F.coalesce(F.col(k), F.lit("")))
        points = points.select(*batch.columns).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            mark = self._advance(points, batch_id)
            ready = self._in_order(points, batch_id, mark) if self.delay is not None else points
            self._score(ready, batch_id)
        finally:
            points.unpersist()
        if self.expire is not None and mark is not None:
            self._sweep(spark, batch_id, mark)

    # -- event time
    def _mark(self, spark: SparkSession, batch_id: int) -> int | None:
        """The watermark after a batch; none before the first point."""
        if batch_id < 0:
            return None
        row = spark.read.schema("mark long").parquet(f"{self.root}/marks/batch_id={batch_id}").first()
        return row.mark

    def _advance(self, points: DataFrame, batch_id: int) -> int | None:
        spark = points.sparkSession
        marks = [self._mark(spark, batch_id - 1)]
        newest = points.agg(F.max("timestamp")).first()[0]
        marks.append(None if newest is None else newest - (self.delay or 0))
        mark = max((m for m in marks if m is not None), default=None)
        (spark.createDataFrame([(mark,)], "mark long").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/marks/batch_id={batch_id}"))
        return mark

    def _in_order(self, points: DataFrame, batch_id: int, mark: int | None) -> DataFrame:
        """The points that the watermark releases; late and waiting ones are
        written for the batch."""
        spark = points.sparkSession
        past = self._mark(spark, batch_id - 1)
        late = F.lit(False) if past is None else F.col("timestamp") <= F.lit(past)
        points.filter(late).write.mode("overwrite").parquet(f"{self.root}/late/batch_id={batch_id}")
        waiting = points.filter(~late)
        if batch_id:
            waiting = waiting.unionByName(self._buffer(spark, batch_id - 1, points.schema))
        free = F.lit(False) if mark is None else F.col("timestamp") <= F.lit(mark)
        waiting.filter(~free).write.mode("overwrite").parquet(f"{self.root}/buffer/batch_id={batch_id}")
        if batch_id > 2:  # batch N - 1 may run again, and reads N - 2
            drop_path(spark, f"{self.root}/buffer/batch_id={batch_id - 3}")
        return waiting.filter(free)

    def _buffer(self, spark: SparkSession, batch_id: int, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.root}/buffer/batch_id={batch_id}")

    def flush(self, spark: SparkSession, schema, batch_id: int) -> None:
        """Score what still waits after batch ``batch_id``, the last one."""
        rest = self._buffer(spark, batch_id, schema)
        spark.createDataFrame([(2 ** 62,)], "mark long").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/marks/batch_id={batch_id + 1}")
        rest.limit(0).write.mode("overwrite").parquet(f"{self.root}/buffer/batch_id={batch_id + 1}")
        self._score(rest, batch_id + 1)

    def _sweep(self, spark: SparkSession, batch_id: int, mark: int) -> None:
        """Drop idle windows: an empty one takes their place in the same batch's
        changes, and a row in ``expired`` tells of it."""
        idle = (self.windows.latest(spark, batch_id + 1).filter(F.size(TAIL) > 0)
                .filter(F.col("last_ts") < F.lit(mark - self.expire)).select(*self.keys, "last_ts"))
        (idle.withColumn("watermark", F.lit(mark).cast("long")).write.mode("overwrite")
         .parquet(f"{self.root}/expired/batch_id={batch_id}"))
        gone = spark.read.schema(f"{', '.join(f'`{k}` string' for k in self.keys)}, last_ts long").parquet(
            f"{self.root}/expired/batch_id={batch_id}").withColumn(TAIL, F.expr("cast(array() as array<struct<ts:bigint,v:double>>)"))
        kept = self._changed(spark, batch_id).join(gone, self.keys, "left_anti")
        self.windows.write(kept.unionByName(gone), batch_id)

    def late(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/late")

    def expired(self, spark: SparkSession) -> DataFrame:
        """(*keys, last_ts, watermark, batch_id) of every dropped window."""
        return spark.read.parquet(f"{self.root}/expired")

    # -- windows
    def _score(self, points: DataFrame, batch_id: int) -> None:
        spark = points.sparkSession
        kept = self.windows.lookup(points.select(*self.keys).distinct(), before=batch_id)
        past = kept.select(*self.keys, F.posexplode(TAIL).alias("seq", "e")).select(
            *self.keys, F.col("seq").cast("long").alias("seq"), F.col("e.ts").alias("timestamp"),
            F.col("e.v").alias("value"), F.lit(0).alias(PHASE))
        # within a window the stored order counts, whatever the timestamps
        rows = points.withColumn(PHASE, F.lit(1)).unionByName(past, allowMissingColumns=True)
        scored = rolling_detect(rows, self.cfg, keys=self.keys, stale_gap_seconds=self.gap,
                                target_chunk_rows=self.target, tails=True)
        scored.write.mode("overwrite").parquet(f"{self.root}/scored/batch_id={batch_id}")
        self._scored_schema = scored.schema
        self.windows.write(self._changed(spark, batch_id), batch_id)

    def _changed(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The windows of the batch's series, from its stored results."""
        written = spark.read.schema(self._scored_schema).parquet(f"{self.root}/scored/batch_id={batch_id}")
        return (written.filter(F.col(TAIL).isNotNull())
                .select(*self.keys, F.element_at(TAIL, -1)["ts"].alias("last_ts"), TAIL))

    def scored(self, spark: SparkSession) -> DataFrame:
        """Every point with its statistics, and its batch."""
        return spark.read.parquet(f"{self.root}/scored").drop(TAIL)


def detect_stream(points: DataFrame, cfg: MadConfig, base: str | None = None, **options) -> WindowedDetector:
    """Run the detector over a streaming frame to completion, from the
    checkpoint of an earlier run where ``base`` names one."""
    base = base or fresh_subdir(points.sparkSession, "windowed-detector")
    detector = WindowedDetector(f"{base}/tables", cfg, **options)
    run_available_now(points.writeStream.foreachBatch(detector).option("checkpointLocation", f"{base}/ckpt"))
    return detector
