"""Exact batch TTL de-duplication ("set if absent, expiring after a TTL").

A key's first event is accepted; after that, the first event at or after the
last accepted one's time plus the TTL, and so on. Which event is accepted next
depends only on the accepted one, so each time of a key points at a next time,
and the accepted times are those reached from the first. Pointer doubling finds
them by joins in rounds: after round k all times within 2^k steps are known,
and the pointers span 2^(k+1) steps. No task walks a chain, however long, and a
key that holds most of the events is spread over tasks like any other.

The next time comes from TTL-wide buckets: time + TTL lies in the next bucket,
so it is either a later time of that bucket (a window over two buckets of one
key, at most 2 TTL distinct seconds) or the head of the next filled bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import store_table


def _next_times(times: DataFrame, ttl: int) -> DataFrame:
    """(k, t, nxt): each distinct time of a key and the first one at or after
    t + ttl (null: none)."""
    bucket = F.floor(F.col("t") / ttl)
    data = times.withColumn("b", bucket)
    # in the next bucket, the first time at or after t + ttl
    asked = data.select("k", (F.col("b") + 1).alias("b"), (F.col("t") + ttl).alias("at"), F.lit(0).alias("is_time"), "t")
    there = data.select("k", "b", F.col("t").alias("at"), F.lit(1).alias("is_time"), F.lit(None).cast("long").alias("t"))
    ahead = Window.partitionBy("k", "b").orderBy("at", "is_time").rowsBetween(1, Window.unboundedFollowing)
    near = (asked.unionByName(there).withColumn("near", F.min(F.when(F.col("is_time") == 1, F.col("at"))).over(ahead))
            .filter("is_time = 0").select("k", "t", "near"))
    # else the head of the next filled bucket beyond it (one row per key and bucket)
    by_bucket = Window.partitionBy("k").orderBy("b")
    heads = (data.groupBy("k", "b").agg(F.min("t").alias("head"))
             .withColumn("b1", F.lead("b", 1).over(by_bucket)).withColumn("h1", F.lead("head", 1).over(by_bucket))
             .withColumn("h2", F.lead("head", 2).over(by_bucket)))
    far = heads.select("k", "b", F.when(F.col("b1") > F.col("b") + 1, F.col("h1")).otherwise(F.col("h2")).alias("far"))
    return (near.withColumn("b", bucket).join(far, ["k", "b"], "left")
            .select("k", "t", F.coalesce("near", "far").alias("nxt")))


def ttl_dedup(events: DataFrame, key: str, time: str, seq: str, ttl_seconds: int) -> DataFrame:
    """The accepted events, all columns as they are. ``time`` is in whole
    seconds; of events of one key and second the one of least ``seq`` (unique)
    stands. Events without a key or a time are never duplicates, and stay."""
    if ttl_seconds <= 0:
        raise ValueError("the TTL must be positive")
    known = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    first = store_table(known.groupBy(F.col(key).alias("k"), F.col(time).cast("long").alias("t"))
                        .agg(F.min(seq).alias("s")), "ttl-times")
    step = store_table(_next_times(first.select("k", "t"), int(ttl_seconds)).filter("nxt is not null"), "ttl-next")
    reached = first.groupBy("k").agg(F.min("t").alias("t"))
    while step.limit(1).count():
        on = reached.join(step, ["k", "t"]).select("k", F.col("nxt").alias("t"))
        reached = store_table(reached.unionByName(on), "ttl-reached")  # 2^k steps, then twice as many
        again = step.select("k", F.col("t").alias("nxt"), F.col("nxt").alias("after"))
        step = store_table(step.join(again, ["k", "nxt"]).select("k", "t", F.col("after").alias("nxt")), "ttl-next")
    kept = reached.distinct().join(first, ["k", "t"]).select(F.col("k").alias("_k"), F.col("s").alias("_s"))
    accepted = known.join(kept, (F.col(key) == F.col("_k")) & (F.col(seq) == F.col("_s")), "left_semi")
    return accepted.unionByName(events.filter(F.col(key).isNull() | F.col(time).isNull()))
