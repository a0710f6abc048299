"""Session helpers.

``get_spark`` is for local runs and tests only; on a cluster the caller owns
the session. ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session
(the shared folder a cluster names) and only invents a scratch folder when the
setting is absent, as in local tests.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Session settings every vigil job relies on (UTC keeps unix seconds and
# RFC3339 strings identical to the DuckDB oracle).
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The detector's window stage is CPU-bound per row, not per byte: keep
    # small shuffles from being coalesced into a single task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "vigil") -> SparkSession:
    """Build (or reuse) a local session with vigil's settings."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(parts))
               .config("spark.driver.memory", "16g"))
    for k, v in _BASE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Set the runtime-modifiable settings vigil needs on an existing session."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled",
              "spark.sql.execution.arrow.pyspark.enabled",
              "spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set(k, _BASE_CONF[k])


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, so that functions
    that run there can import it wherever the driver was started. Local masters
    share the driver's path."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root in map(os.path.abspath, filter(None, paths)) or getattr(context, "_vigil_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="vigil-package-")
    # the driver serves the archive to the workers for as long as it runs
    context.addPyFile(shutil.make_archive(os.path.join(folder, "vigil"), "zip", root, "vigil"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context._vigil_shipped = True


def checkpoint_dir(spark: SparkSession, sub: str = "") -> str:
    """Shared checkpoint folder: ``spark.checkpoint.dir`` if the cluster set it,
    else a fresh scratch folder (local runs and tests only)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vigil-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    if sub:
        return base.rstrip("/") + "/" + sub
    return base


def fresh_subdir(spark: SparkSession, name: str) -> str:
    """A unique folder below the checkpoint dir (for streaming checkpoints and
    materialised intermediate tables)."""
    import uuid
    return checkpoint_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def store_table(df, name: str):
    """Write a frame as a parquet table below the checkpoint dir and read it
    back: the job runs once and later readers do not recompute its lineage."""
    spark = df.sparkSession
    path = fresh_subdir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
