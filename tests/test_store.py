"""Stored tables of micro-batches: buckets, filters, retries and compaction."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.streaming.jobs import Projector
from vigil.streaming.store import BatchTable, KeyedStore, KeyLedger, bloom_filter, may_contain, path_exists


def keys_df(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "dedup_key string")


def test_bloom_filters_never_miss_and_seldom_err():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        held = rng.integers(-2 ** 63, 2 ** 63 - 1, n)
        f = bloom_filter(held)
        assert may_contain(f, held).all()
        assert may_contain(f, rng.integers(-2 ** 63, 2 ** 63 - 1, 5000)).mean() < 0.03


def test_ledger_finds_keys_over_batches_and_compactions(spark, tmp_path):
    ledger = KeyLedger(str(tmp_path / "l"), buckets=4)
    rng = random.Random(2)
    seen: set[str] = set()
    assert ledger.known(keys_df(spark, ["a"]), before=0).count() == 0
    for batch in range(5):
        if batch in (2, 4):
            ledger.compact(spark, batch - 1)
        mine = {f"k{rng.randrange(400)}" for _ in range(60)} | {None if batch == 9 else f"own{batch}"}
        known = {r[0] for r in ledger.known(keys_df(spark, mine), before=batch).collect()}
        assert known == mine & seen
        ledger.write(keys_df(spark, mine - known), batch)
        ledger.write(keys_df(spark, mine - known), batch)  # a retry
        assert {r[0] for r in ledger.known(keys_df(spark, mine), before=batch).collect()} == known
        seen |= mine
    assert sorted(r[0] for r in ledger.read(spark).select("dedup_key").collect()) == sorted(seen)


def test_a_batch_reads_only_the_buckets_it_may_touch(spark, tmp_path):
    ledger = KeyLedger(str(tmp_path / "l"), buckets=64)
    ledger.write(keys_df(spark, [f"k{i}" for i in range(3000)]), 0)
    few = ledger.suspects(keys_df(spark, [f"new{i}" for i in range(300)]), before=1)
    assert few.count() < 30  # new keys are ruled out by the filters
    found = ledger.known(keys_df(spark, ["k7", *(f"new{i}" for i in range(5))]), before=1)
    plan = found._jdf.queryExecution().toString()
    wanted = {r[0] for r in keys_df(spark, ["k7"]).select(ledger.bucket()).collect()}
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line and "bucket" in line]
    assert any(f"bucket#" in s and str(next(iter(wanted))) in s for s in scans)
    assert [r[0] for r in found.collect()] == ["k7"]
    none = ledger.known(keys_df(spark, ["absent"]), before=1)
    assert none.count() == 0 and "Scan parquet" not in none._jdf.queryExecution().executedPlan().toString()


def test_keyed_store_writes_changes_and_merges_when_read(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "s"), ["a", "b"], "v long", buckets=4)
    df = lambda rows: spark.createDataFrame(rows, "a string, b string, v long")
    store.write(df([("x", "1", 1), ("y", "1", 2)]), 0)
    store.write(df([("x", "1", 3)]), 1)
    assert spark.read.parquet(store.changes(1)).count() == 1  # the changed key only
    assert sorted(map(tuple, store.latest(spark).collect())) == [("x", "1", 3), ("y", "1", 2)]
    assert sorted(map(tuple, store.latest(spark, before=1).collect())) == [("x", "1", 1), ("y", "1", 2)]
    store.compact(spark, 1)
    store.write(df([("z", "2", 9), ("y", "1", 7)]), 2)
    want = [("x", "1", 3), ("y", "1", 7), ("z", "2", 9)]
    assert sorted(map(tuple, store.latest(spark).collect())) == want
    assert sorted(map(tuple, store.lookup(df([("y", "1", 0), ("q", "q", 0)])).collect())) == [("y", "1", 7)]
    store.compact(spark, 2)
    store.write(df([("x", "1", 4)]), 3)
    store.compact(spark, 3)
    assert not path_exists(spark, store.changes(0)) and not path_exists(spark, store.base(1))
    assert sorted(map(tuple, store.latest(spark).collect())) == [("x", "1", 4), *want[1:]]


def test_a_crash_between_base_and_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = KeyedStore(str(tmp_path / "s"), ["a"], "v long", buckets=2)
    df = lambda rows: spark.createDataFrame(rows, "a string, v long")
    store.write(df([("x", 1)]), 0)
    store.write(df([("x", 2), ("y", 5)]), 1)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "commit", crash)
        with pytest.raises(OSError):
            store.compact(spark, 1)
    assert path_exists(spark, store.base(1)) and store.committed(spark) == []
    assert sorted(map(tuple, store.latest(spark).collect())) == [("x", 2), ("y", 5)]
    store.compact(spark, 1)
    assert store.committed(spark) == [1]
    assert sorted(map(tuple, store.latest(spark).collect())) == [("x", 2), ("y", 5)]


def test_events_are_pruned_by_date_before_and_after_compaction(spark, tmp_path):
    table = BatchTable(str(tmp_path / "t"), "id long, d date", "d")
    for k in range(3):
        table.write(spark.range(10).select((F.col("id") + 10 * k).alias("id"), F.date_add(F.lit("2024-01-01").cast("date"),
                    (F.col("id") % 3).cast("int")).alias("d")), k)
    for step in range(2):
        day = table.read(spark).filter(F.col("d") == F.lit("2024-01-02").cast("date"))
        assert day.count() == 9
        assert "PartitionFilters: [" in day._jdf.queryExecution().toString()
        table.compact(spark, 1)
    assert table.read(spark).count() == 30


def _envelope(i, source="s", event=None):
    flat = {"source": source, "metric_name": "m", "timestamp": 86400 * (i % 3), "value": float(i), "baseline": 1.0, "mad": 1.0,
            "threshold": 2.0}
    return ("t", i, json.dumps({"meta": {"event_id": event or f"e{i}"}, "data": flat}))


def test_projector_over_batches_retries_and_compaction(spark, tmp_path):
    p = Projector(str(tmp_path / "p"), compact_every=2, buckets=4)
    batch = lambda rows: spark.createDataFrame(rows, "subject string, stream_seq long, payload string")
    steps = [[_envelope(1), _envelope(2, "b"), ("t", 3, "{bad")],
             [_envelope(4, event="e1"), _envelope(5)],          # e1 again
             [_envelope(6, "b"), _envelope(7, event="e5")],
             [_envelope(8, "c"), _envelope(9, "c", event="e8")]]
    for k, rows in enumerate(steps):
        p(batch(rows), k)
        if k % 2:
            p(batch(rows), k)
    assert sorted(r.id for r in p.events(spark).collect()) == [1, 2, 5, 6, 8]
    assert sorted((r.source, r.last_seq) for r in p.latest_state(spark).collect()) == [("b", 6), ("c", 8), ("s", 5)]
    assert spark.read.parquet(p.quarantine_path).count() == 1
    assert spark.read.parquet(p.state.changes(3)).count() == 1  # one changed series
