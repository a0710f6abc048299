"""Exact TTL dedup, histograms, stage targets and distinct sketches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import histogram as H
from vigil.operators.extensions import ttl_dedup_stream
from vigil.operators.ttl import ttl_dedup

EVENTS = "k string, t long, seq long, key int"


def brute(rows, ttl):
    last, out = {}, []
    for k, t, seq, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        if k not in last or t >= last[k] + ttl:
            last[k] = t
            out.append(seq)
    return sorted(out + [r[2] for r in rows if r[0] is None or r[1] is None])


@pytest.mark.parametrize("ttl", [1, 7, 300])
def test_ttl_dedup_against_a_plain_scan(spark, ttl):
    rng = random.Random(ttl)
    rows, t = [], 0
    for seq in range(700):
        t += rng.choice([0, 0, 0, 1, 2, ttl - 1, ttl, ttl + 1]) if rng.random() < .97 else 40 * ttl
        rows.append((rng.choice(["hot"] * 8 + ["a", "b"]), t, seq, 1))
    rows += [(None, 5, 9001, 1), ("a", None, 9002, 1), ("neg", -ttl, 9003, 1), ("neg", -1, 9004, 1), ("neg", 0, 9005, 1)]
    rng.shuffle(rows)
    got = ttl_dedup(spark.createDataFrame(rows, EVENTS), "k", "t", "seq", ttl)
    assert got.columns == ["k", "t", "seq", "key"]
    assert sorted(r.seq for r in got.collect()) == brute(rows, ttl)


def test_ttl_dedup_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([("a", 3, 1, 0)], EVENTS)
    assert ttl_dedup(df.limit(0), "k", "t", "seq", 5).count() == 0
    assert ttl_dedup(df, "k", "t", "seq", 5).count() == 1
    with pytest.raises(ValueError):
        ttl_dedup(df, "k", "t", "seq", 0)


def test_ttl_stream_ties_go_by_sequence(spark, tmp_path):
    from vigil.streaming.jobs import stream_to_parquet
    rows = [("a", 10, 5), ("a", 10, 2), ("a", 10, 9), ("a", 11, 1), ("b", 7, 4)]
    df = spark.createDataFrame(rows, "k string, s long, n int").select("k", F.timestamp_seconds("s").alias("at"), "n")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = stream_to_parquet(ttl_dedup_stream(stream, "k", "at", seq_col="n"), "t", base=str(tmp_path / "run"), drain=True)
    assert sorted((r.k, r.n) for r in out.collect()) == [("a", 2), ("b", 4)]


def test_histograms_add_up_within_their_error(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, -1.0, rng.expovariate(.01), 10 ** rng.uniform(-6, 9)]) for _ in range(3000)]
    rows = [("s", i % 7200, v) for i, v in enumerate(values)] + [("s", 1, None), ("t", 5, 1.0)]
    minutes = H.histograms(spark.createDataFrame(rows, "source string, timestamp long, value double"), ["source"])
    hours = H.merge_histograms(minutes, ["source"], 3600)
    day = H.merge_histograms(hours, ["source"], 86400)
    assert {r.source: r["count"] for r in day.collect()} == {"s": 3000, "t": 1}
    shape = lambda df: sorted((r.source, r.start, r["count"], sorted(r.histogram.items())) for r in df.collect())
    assert shape(day) == shape(H.merge_histograms(minutes, ["source"], 86400))
    whole = sorted(max(0.0, v) for v in values)
    for q in (0.0, 0.01, 0.5, 0.9, 0.99, 1.0):
        got = day.filter("source = 's'").select(H.percentile("histogram", "count", q).alias("p")).first().p
        want = whole[max(1, math.ceil(q * len(whole))) - 1]
        assert abs(got - want) <= H.ERROR * 1.000001 * want


def test_stage_targets(spark):
    rows = [("fast", 10, 1.0)] * 99 + [("fast", 10, 9.0)] + [("slow", 10, 9.0)] * 2 + [("fast", 4000, 1.0)]
    dead = spark.createDataFrame([(5,)] * 3 + [(4000,), (9000,)], "timestamp long")
    got = H.slo_stages(spark.createDataFrame(rows, "stage string, timestamp long, value double"), dead, {"fast": 2, "slow": 8}, 3)
    rows = [tuple(r) for r in got.select("hour", "fast_ok", "slow_ok", "dead_letters", "slo_ok").orderBy("hour").collect()]
    assert rows == [(0, True, False, 3, False), (3600, True, True, 1, True), (7200, True, True, 1, True)]


def test_hourly_sketches_unite_to_the_day(spark):
    rows = [(i * 37 % 86400, f"v{i % 900}", f"w{i % 3}") for i in range(4000)]
    pts = spark.createDataFrame(rows, "timestamp long, a string, b string")
    hourly = H.distinct_sketches(pts, ["a", "b"])
    assert hourly.count() == 48
    got = {r.label: r.approx_distinct for r in H.cardinality_from_sketches(hourly, 100).collect()}
    whole = H.distinct_sketches(pts, ["a", "b"], seconds=86400)
    one = {r.label: r.approx_distinct for r in H.cardinality_from_sketches(whole, 100).collect()}
    assert got.keys() == one.keys() and all(abs(got[k] - one[k]) <= .01 * one[k] for k in one)  # estimators differ slightly
    assert got["b"] == 3 and abs(got["a"] - 900) < 45
