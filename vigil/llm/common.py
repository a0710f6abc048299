"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Text bytes that one numpy pass handles at a time (whole documents, so a
#: longer document is a pass of its own).
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local
    session without the setting gets a scratch folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or \
                spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vigil-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends
    there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; whatever else the
    input carries stays out of the way."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def int_conf(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def shuffle_width(spark: SparkSession) -> int:
    return int_conf(spark, "spark.sql.shuffle.partitions", 200)


def text_slices(batch: pa.RecordBatch, column: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``limit`` text bytes."""
    sizes = batch.column(column)
    lengths = pa.compute.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_map(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text",
              limit: int = CHUNK_BYTES):
    """A ``mapInArrow`` function that calls ``fn`` on bounded slices."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
    return run


def crc_mod4(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, mod 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


