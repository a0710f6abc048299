"""Mergeable summaries: latency histograms and distinct counts.

A histogram is a map from log bucket to count. Bucket i holds the values in
(g^(i-1), g^i] with g = (1 + e) / (1 - e), so the middle it stands for is within
a share e of any of them; values of 0 and below share one bucket. Histograms
add by adding counts, so minutes make hours and days without the points, and
any percentile of any of them has the same error bound. Buckets are counted by
a plain group-by (combined map-side): a hot label costs no more than its
buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = 0.01
#: The bucket of values of 0 and below.
ZERO = -(1 << 31)


def _log_growth(error: float) -> float:
    return math.log((1 + error) / (1 - error))


def log_bucket(value: Column, error: float = ERROR) -> Column:
    return F.when(value <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(value) / F.lit(_log_growth(error))).cast("int"))


def bucket_middle(bucket: Column, error: float = ERROR) -> Column:
    growth = (1 + error) / (1 - error)
    return F.when(bucket == ZERO, F.lit(0.0)).otherwise(
        F.lit(2.0) * F.exp(bucket * F.lit(_log_growth(error))) / F.lit(growth + 1))


def _as_maps(counted: DataFrame, keys: list[str]) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct("bucket", "n")))
    return counted.groupBy(*keys).agg(F.map_from_entries(entries).alias("histogram"), F.sum("n").alias("count"))


def histograms(points: DataFrame, keys: list[str], value: str = "value", time: str = "timestamp", seconds: int = 60,
               error: float = ERROR) -> DataFrame:
    """(*keys, start, histogram, count) per label and time bucket; rows without
    a value count nowhere."""
    start = (F.floor(F.col(time) / seconds) * seconds).alias("start")
    counted = (points.filter(F.col(value).isNotNull()).groupBy(*keys, start, log_bucket(F.col(value), error).alias("bucket"))
               .agg(F.count(F.lit(1)).alias("n")))
    return _as_maps(counted, [*keys, "start"])


def merge_histograms(parts: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Histograms added up into longer time buckets, from histograms alone."""
    start = (F.floor(F.col("start") / seconds) * seconds).cast("long").alias("start")
    counted = (parts.select(*keys, start, F.explode("histogram").alias("bucket", "n"))
               .groupBy(*keys, "start", "bucket").agg(F.sum("n").alias("n")))
    return _as_maps(counted, [*keys, "start"])


def percentile(histogram: str, count: str, q: float, error: float = ERROR) -> Column:
    """The q-quantile (nearest rank) within a share ``error``."""
    rank = F.greatest(F.lit(1), F.ceil(F.col(count) * F.lit(q)))
    entries = F.array_sort(F.map_entries(histogram))
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bucket"))
    found = F.aggregate(entries, zero, lambda a, e: F.when(a["seen"] >= rank, a).otherwise(
        F.struct((a["seen"] + e["value"]).alias("seen"), e["key"].alias("bucket"))))
    return bucket_middle(found["bucket"], error)


def slo_stages(latencies: DataFrame, dead: DataFrame, targets_ms: dict[str, int], dead_per_hour: int,
               stage: str = "stage", value: str = "value", time: str = "timestamp") -> DataFrame:
    """D-8: per hour, whether the p99 of each stage (exact: at least 99 % of its
    values are within the target; true without any) and the number of dead
    letters meet their targets. ``dead`` has a ``timestamp`` per dead letter."""
    hour = lambda c: (F.floor(F.col(c) / 3600) * 3600).cast("long").alias("hour")
    target = F.lit(None).cast("double")
    for name, ms in targets_ms.items():
        target = F.when(F.col(stage) == name, F.lit(float(ms))).otherwise(target)
    counted = latencies.withColumn("_in", (F.col(value) <= target).cast("long")).groupBy(hour(time)).agg(
        *(F.coalesce(F.avg(F.when(F.col(stage) == name, F.col("_in"))) >= 0.99, F.lit(True)).alias(f"{name}_ok")
          for name in targets_ms))
    letters = dead.groupBy(hour("timestamp")).agg(F.count(F.lit(1)).alias("dead_letters"))
    out = counted.join(letters, "hour", "full").withColumn("dead_letters", F.coalesce("dead_letters", F.lit(0)).cast("long"))
    for name in targets_ms:
        out = out.withColumn(f"{name}_ok", F.coalesce(f"{name}_ok", F.lit(True)))
    out = out.withColumn("dead_letters_ok", F.col("dead_letters") < dead_per_hour)
    ok = F.col("dead_letters_ok")
    for name in targets_ms:
        ok = ok & F.col(f"{name}_ok")
    return out.withColumn("slo_ok", ok)


def distinct_sketches(points: DataFrame, labels: list[str], time: str = "timestamp", seconds: int = 3600) -> DataFrame:
    """D-10: (start, label, sketch): HyperLogLog sketches of each label's values
    per time bucket, to be stored and united later."""
    start = (F.floor(F.col(time) / seconds) * seconds).cast("long").alias("start")
    row = points.groupBy(start).agg(*(F.hll_sketch_agg(F.col(c).cast("string")).alias(c) for c in labels))
    return row.select("start", F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("sketch"))
                                                   for c in labels))).alias("s")).select("start", "s.*")


def cardinality_from_sketches(sketches: DataFrame, limit: int, seconds: int = 86400) -> DataFrame:
    """(start, label, approx_distinct, violation) per longer time bucket, from
    stored sketches alone."""
    start = (F.floor(F.col("start") / seconds) * seconds).cast("long").alias("start")
    return (sketches.groupBy(start, "label").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct"))
            .withColumn("violation", F.col("approx_distinct") > limit))
