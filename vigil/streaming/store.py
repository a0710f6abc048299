"""Tables that micro-batches change, merged when read.

``BatchTable`` holds the rows of each batch in a folder of its own, partitioned
by one column. A batch that runs again overwrites its folder only, so a retry
changes nothing. ``compact`` writes all batches up to one into a new base, and
then a commit row; a base without its commit row doesn't exist for readers, so
a crash in between loses and repeats nothing. Folders that a committed base
stands for are dropped at the next compaction but one (readers that began
before it still find them).

``KeyedStore`` is the newest row of every key. Rows lie in hash buckets of the
key; a batch writes the rows that it changed, and readers take the newest
version of a key over the base and the later batches. Lookups read the buckets
of the wanted keys only.

``KeyLedger`` is a set of keys. Beside each bucket file lies a Bloom filter of
its keys. A lookup first asks the filters, and then reads the buckets in which
a wanted key may be: a batch of new keys reads hardly any.

Everything is written below the given root, which all executors must share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKETS = 64


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class BatchTable:
    def __init__(self, root: str, schema: str, partition: str):
        """``schema``: DDL of the rows, the partition column included."""
        self.root, self.schema, self.partition = root.rstrip("/"), schema, partition

    # -- layout
    def changes(self, batch_id: int | None = None) -> str:
        return f"{self.root}/changes" + ("" if batch_id is None else f"/batch_id={batch_id}")

    def base(self, upto: int) -> str:
        return f"{self.root}/base/upto={upto}"

    def committed(self, spark: SparkSession, before: int | None = None) -> list[int]:
        """Committed bases (the last batch each holds), newest first."""
        try:
            got = [r.upto for r in spark.read.schema("upto long").json(f"{self.root}/commits").collect()]  # one row a base
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            got = []
        return sorted({u for u in got if before is None or u < before}, reverse=True)

    # -- write
    def write(self, rows: DataFrame, batch_id: int) -> None:
        (rows.repartition(self.partition).write.mode("overwrite").partitionBy(self.partition)
         .parquet(self.changes(batch_id)))

    # -- read
    def _folder(self, spark: SparkSession, path: str) -> DataFrame | None:
        if not path_exists(spark, path):
            return None
        return spark.read.schema(f"{self.schema}, batch_id long").option("basePath", path).parquet(path)

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All rows of batches below ``before``, with ``batch_id`` (of rows in
        a base: its last batch)."""
        bases = self.committed(spark, before)
        later = self._folder(spark, self.changes())
        parts = []
        if bases:
            parts.append(self._folder(spark, self.base(bases[0])).withColumn("batch_id", F.lit(bases[0]).cast("long")))
        if later is not None:
            if bases:
                later = later.filter(F.col("batch_id") > bases[0])
            parts.append(later if before is None else later.filter(F.col("batch_id") < before))
        if not parts:
            return spark.createDataFrame([], f"{self.schema}, batch_id long")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    # -- compaction
    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.drop("batch_id")

    def compacted(self, rows: DataFrame) -> DataFrame:
        return rows

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Write the batches up to ``upto`` into one base. Only batches that
        can't run again may be compacted."""
        bases = self.committed(spark)
        if bases and bases[0] >= upto:
            return
        rows = self.compacted(self.merged(self.read(spark, upto + 1)))
        (rows.repartition(self.partition).write.mode("overwrite").partitionBy(self.partition).parquet(self.base(upto)))
        self.commit(spark, upto)
        for old in bases[:1]:  # what the base before this one stands for
            for batch_id in self._batches(spark, old):
                drop_path(spark, self.changes(batch_id))
        for old in bases[1:]:
            drop_path(spark, self.base(old))

    def commit(self, spark: SparkSession, upto: int) -> None:
        spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").json(f"{self.root}/commits")

    def _batches(self, spark: SparkSession, upto: int) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.changes())
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        found = [int(n.split("=")[1]) for n in names if n.startswith("batch_id=")]
        return [b for b in found if b <= upto]


class KeyedStore(BatchTable):
    def __init__(self, root: str, keys, values: str, *, version: str = "batch_id", buckets: int = BUCKETS,
                 key_type: str = "string", live: str | None = None):
        """``values``: DDL of the other columns; the newest row of a key is the
        one of the highest ``version``, the batch if no column is named. Rows
        that fail the predicate ``live`` mark dropped keys; compaction removes
        them."""
        self.keys, self.buckets, self.version, self.live = list(keys), buckets, version, live
        own = ", ".join(f"`{k}` {key_type}" for k in self.keys)
        extra = ", _version long" if version == "batch_id" else ""
        super().__init__(root, f"{own}, {values}{extra}, bucket int", "bucket")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        if self.version == "batch_id":
            rows = rows.withColumn("_version", F.lit(batch_id).cast("long"))
        super().write(rows.withColumn("bucket", self.bucket()), batch_id)

    def merged(self, rows: DataFrame) -> DataFrame:
        version = "_version" if self.version == "batch_id" else self.version
        values = [c for c in rows.columns if c not in (*self.keys, "bucket", "batch_id")]
        return (rows.groupBy(*self.keys, "bucket").agg(F.max_by(F.struct(*values), version).alias("_r"))
                .select(*self.keys, "_r.*", "bucket"))

    def compacted(self, rows: DataFrame) -> DataFrame:
        return rows.filter(self.live) if self.live else rows

    def latest(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The newest row of every key."""
        return self.merged(self.read(spark, before)).drop("bucket", "_version")

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """The newest rows of the wanted keys (distinct), from their buckets only."""
        spark = wanted.sparkSession
        wanted = wanted.select(*self.keys)
        touched = sorted(r[0] for r in wanted.select(self.bucket()).distinct().collect())  # at most ``buckets``
        rows = self.read(spark, before).filter(F.col("bucket").isin(touched))
        return self.merged(rows.join(wanted, self.keys, "left_semi")).drop("bucket", "_version")


# ---------------------------------------------------------------- Bloom filters
_PROBES = 7


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits (rows: probes) of 64-bit hashes in a filter of ``size`` bits."""
    h = hashes.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(size) for i in range(_PROBES)])


def bloom_filter(hashes: np.ndarray) -> bytes:
    size = max(64, 1 << int(10 * max(1, len(hashes)) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[_bits(hashes, size).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_contain(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    data = np.frombuffer(filter_, np.uint8)
    at = _bits(hashes, len(data) * 8)
    return ((data[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(0)


def _summaries(batches):
    """(bucket, bits) of rows (bucket, hash) in order of their bucket."""
    last, held = None, []

    def done():
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()),
                                           pa.array([bloom_filter(np.concatenate(held))], pa.binary())], ["bucket", "bits"])

    for b in batches:
        bucket, hashes = b.column("bucket").to_numpy(), b.column("hash").to_numpy()
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for at, part in zip([0, *cuts], np.split(hashes, cuts), strict=True):
            if not len(part):
                continue
            if bucket[at] != last and last is not None:
                yield done()
                held = []
            last = int(bucket[at])
            held.append(part)
    if last is not None:
        yield done()


def _suspects(batches):
    """Keys that some filter of their bucket may hold; a bucket's filters (key
    null) come before its keys."""
    bucket, filters = None, []
    for b in batches:
        at, hashes = b.column("bucket").to_pylist(), b.column("hash")
        bits = b.column("bits").to_pylist()
        keys, h = [], hashes.fill_null(0).to_numpy(zero_copy_only=False)
        runs: list[tuple[list[bytes], list[int]]] = []
        for i, (k, f) in enumerate(zip(at, bits, strict=True)):
            if k != bucket:
                bucket, filters = k, []
            if f is not None:
                filters = [*filters, f]
                continue
            if not runs or runs[-1][0] is not filters:
                runs.append((filters, []))
            runs[-1][1].append(i)
        for held, rows in runs:
            hit = np.zeros(len(rows), bool)
            for f in held:
                hit |= may_contain(f, h[rows])
            keys += np.asarray(rows)[hit].tolist()
        if keys:
            yield b.select(["key", "bucket"]).take(pa.array(keys))


class KeyLedger(BatchTable):
    """A set of text keys with a Bloom filter per batch (or base) and bucket."""

    def __init__(self, root: str, key: str = "dedup_key", more: str = "", buckets: int = BUCKETS):
        self.key, self.buckets = key, buckets
        super().__init__(root, f"`{key}` string{', ' + more if more else ''}, bucket int", "bucket")
        self.blooms = BatchTable(f"{self.root}/blooms", "bits binary, bucket int", "bucket")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _filters(self, rows: DataFrame) -> DataFrame:
        hashed = rows.select("bucket", F.xxhash64(F.col(self.key), F.lit(1)).alias("hash"))
        return (hashed.repartition("bucket").sortWithinPartitions("bucket")
                .mapInArrow(_summaries, "bucket int, bits binary"))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Add a batch's keys (distinct)."""
        super().write(rows.withColumn("bucket", self.bucket()), batch_id)
        spark = rows.sparkSession
        written = spark.read.schema(self.schema).parquet(self.changes(batch_id))
        self.blooms.write(self._filters(written), batch_id)

    def compact(self, spark: SparkSession, upto: int) -> None:
        if self.committed(spark)[:1] and self.committed(spark)[0] >= upto:
            return
        # filters first: they may say more than the keys, never less
        if not (self.blooms.committed(spark)[:1] and self.blooms.committed(spark)[0] >= upto):
            keys = self.merged(self.read(spark, upto + 1))
            self._filters(keys).write.mode("overwrite").partitionBy("bucket").parquet(self.blooms.base(upto))
            self.blooms.commit(spark, upto)
        super().compact(spark, upto)
        kept = self.committed(spark)
        for old in kept[1:2]:
            for batch_id in self.blooms._batches(spark, old):
                drop_path(spark, self.blooms.changes(batch_id))

    def suspects(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """(key, bucket) of the wanted keys that the filters don't rule out."""
        spark = wanted.sparkSession
        keys = (wanted.select(F.col(self.key).alias("key")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
                .withColumn("hash", F.xxhash64("key", F.lit(1))).withColumn("bits", F.lit(None).cast("binary")))
        filters = self.blooms.read(spark, before).select(
            F.lit(None).cast("string").alias("key"), "bucket", F.lit(0).cast("long").alias("hash"), "bits")
        both = filters.unionByName(keys)
        return (both.repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull())
                .mapInArrow(_suspects, "key string, bucket int"))

    def known(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """The wanted keys that the set holds, read from the buckets in which
        the filters suspect one."""
        spark = wanted.sparkSession
        found = self.suspects(wanted, before).persist()
        try:
            touched = sorted(r[0] for r in found.select("bucket").distinct().collect())  # at most ``buckets``
            if not touched:
                return spark.createDataFrame([], f"`{self.key}` string")
            rows = self.read(spark, before).filter(F.col("bucket").isin(touched)).select(self.key)
            return rows.join(found.select(F.col("key").alias(self.key)), self.key, "left_semi").distinct()
        finally:
            found.unpersist()
