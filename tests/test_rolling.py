"""The incremental detector: its sorted window, chunks by rank, and micro-batches."""

import random
import statistics

import pytest

from conftest import points_df
from vigil.config import MadConfig
from vigil.operators.mad import mad_detect, plan_chunks
from vigil.operators.rolling import Detector, SortedWindow, ranked_chunks, rolling_detect
from vigil.schemas import SERIES_KEY
from vigil.streaming.hot import WindowedDetector

CFG = MadConfig.service_defaults().with_(window_size=7, warmup=3, min_delta=0.0)
COLS = ("seq", "n", "baseline", "mad", "lower", "upper", "is_anomaly")


@pytest.mark.parametrize("load", [2, 8, 512])
def test_sorted_window_against_sorting(load, monkeypatch):
    monkeypatch.setattr(SortedWindow, "LOAD", load)
    rng, window, held = random.Random(load), SortedWindow(), []
    for step in range(1500):
        x = float(rng.choice([rng.randint(-5, 5), rng.gauss(0, 1), 1e15, -0.1]))
        window.add(x)
        held.append(x)
        if len(held) > 90 or (step % 3 == 0 and len(held) > 1):
            window.remove(held.pop(rng.randrange(len(held)) if step % 2 else 0))
        assert window.size == len(held) and window[0] == min(held) and window[window.size - 1] == max(held)
        base = statistics.median(held)
        assert window.median() == base
        assert window.mad(base) == statistics.median(abs(v - base) for v in held)


def _rows(n, series=("svc", "cpu", "prod", "eu"), seed=1):
    rng = random.Random(seed)
    t = 0
    out = []
    for i in range(n):
        t += rng.choice([0, 0, 1, 5, 900])
        out.append((series, i * 1_000_003, t, rng.choice([rng.gauss(10, 2), 500.0])))
    return out


@pytest.mark.parametrize("gap", [None, 600])
@pytest.mark.parametrize("target", [10, 33, 10_000])
def test_equals_the_expression_engine(spark, gap, target):
    pts = points_df(spark, _rows(400) + _rows(30, ("b", "cpu", "", "eu"), 2) + _rows(1, ("c", "cpu", "", ""), 3))
    names = COLS + (("reset",) if gap else ())
    want = sorted(map(tuple, mad_detect(pts, CFG, stale_gap_seconds=gap).select(*names).collect()))
    got = mad_detect(pts, CFG, stale_gap_seconds=gap, engine="rolling", target_chunk_rows=target)
    assert sorted(map(tuple, got.select(*names).collect())) == want


def test_chunks_are_bounded_and_halos_exact(spark):
    from pyspark.sql import functions as F
    pts = points_df(spark, _rows(500) + _rows(20, ("b", "m", "", ""))).withColumn("_phase", F.lit(1)).withColumn("_time", F.col("timestamp"))
    rows = ranked_chunks(pts, SERIES_KEY, 7, 20).groupBy("source", "_chunk").agg(
        F.sum(F.col("_own").cast("int")).alias("own"), F.sum((~F.col("_own")).cast("int")).alias("halo"),
        F.sum(F.col("_end").cast("int")).alias("ends")).collect()
    hot = [r for r in rows if r.source == "svc"]
    assert len(hot) == 25 and max(r.own for r in hot) == 20
    assert sorted(r.halo for r in hot) == [0] + [6] * 24 and sum(r.ends for r in rows) == 2
    assert [(r.own, r.halo) for r in rows if r.source == "b"] == [(20, 0)]


def test_dense_second_with_far_sequences_is_cut_by_quantiles(spark):
    rows = [(("s", "m", "", ""), i * 1_000_003, 1000, float(i % 9)) for i in range(3000)]
    plan = plan_chunks(points_df(spark, rows), target_rows=200)
    assert plan.levels[2].count() <= 40  # ranges, not one per point
    got = mad_detect(points_df(spark, rows), CFG, target_chunk_rows=200)
    want = mad_detect(points_df(spark, rows), CFG, chunk_seconds=None)
    assert sorted(map(tuple, got.select(*COLS).collect())) == sorted(map(tuple, want.select(*COLS).collect()))


def test_window_of_one_and_equal_values(spark):
    cfg = CFG.with_(window_size=1, warmup=1)
    pts = points_df(spark, [(i, i, 5.0) for i in range(6)])
    got = rolling_detect(pts, cfg, target_chunk_rows=2, stale_gap_seconds=10).orderBy("seq").collect()
    assert [(r.n, r.baseline, r.reset) for r in got] == [(1, 5.0, False)] * 6


def test_micro_batches_retries_late_points_and_compaction(spark, tmp_path):
    """Each batch continues the stored windows; a repeated batch changes
    nothing; a late point counts when it arrives."""
    rows = _rows(120) + _rows(15, ("b", "m", "", ""), 4)
    rng = random.Random(9)
    steps = [rows[k::4] for k in range(4)]  # so that batches go back in time
    det = WindowedDetector(str(tmp_path / "d"), CFG, stale_gap_seconds=600, target_chunk_rows=15, compact_every=2, buckets=4)
    plain: dict[tuple, Detector] = {}
    want = []
    for k, step in enumerate(steps):
        rng.shuffle(step)
        det(points_df(spark, step), k)
        if k in (1, 2):
            det(points_df(spark, step), k)
        for key, seq, ts, v in sorted(step, key=lambda r: (r[2], r[1])):
            d = plain.setdefault(key, Detector(CFG, 600))
            reset = d.enter(ts, v)
            want.append((key[0], seq, *d.stats(v), reset))
    got = det.scored(spark).select("source", *COLS, "reset").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_input(spark):
    assert rolling_detect(points_df(spark, [(1, 1, 1.0)]).limit(0), CFG).count() == 0


def test_event_time_order_late_points_and_retries(spark, tmp_path):
    """Released points equal one sorted pass; late ones are exactly those at or
    below an earlier watermark."""
    rng = random.Random(12)
    rows = [(("s", "m", "", ""), i, i * 10 + rng.randint(-40, 40), rng.gauss(0, 1)) for i in range(200)]
    rows += [(("s", "m", "", ""), 900, 5, 1.0), (("t", "m", "", ""), 901, 700, 1.0)]  # far too late, and a new series
    steps = [rows[:60], rows[60:61], rows[61:150], rows[150:]]
    det = WindowedDetector(str(tmp_path / "d"), CFG, delay_seconds=100, target_chunk_rows=15, compact_every=2, buckets=2)
    newest, late = None, []
    for k, step in enumerate(steps):
        late += [r[1] for r in step if newest is not None and r[2] <= newest - 100]
        newest = max([r[2] for r in step] + ([newest] if newest is not None else []))
        rng.shuffle(step)
        det(points_df(spark, step), k)
        det(points_df(spark, step), k)
    det.flush(spark, points_df(spark, rows).schema, 3)
    det.flush(spark, points_df(spark, rows).schema, 3)
    assert sorted(r.seq for r in det.late(spark).collect()) == sorted(late) and 900 in late
    plain: dict[tuple, Detector] = {}
    want = []
    for key, seq, ts, v in sorted((r for r in rows if r[1] not in late), key=lambda r: (r[2], r[1])):
        d = plain.setdefault(key, Detector(CFG, None))
        d.enter(ts, v)
        want.append((key[0], seq, *d.stats(v)))
    assert sorted(map(tuple, det.scored(spark).select("source", *COLS).collect())) == sorted(want)


def test_idle_series_expire_and_warm_up_again(spark, tmp_path):
    det = WindowedDetector(str(tmp_path / "d"), CFG, expire_seconds=100, compact_every=2, buckets=2)
    a, b = ("a", "m", "", ""), ("b", "m", "", "")
    steps = [[(a, 1, 0, 1.0), (a, 2, 10, 2.0), (b, 3, 10, 5.0)], [(b, 4, 60, 5.0)], [(b, 5, 150, 5.0)],
             [(a, 6, 160, 3.0), (b, 7, 161, 5.0)], [(b, 8, 500, 5.0)]]
    for k, step in enumerate(steps):
        det(points_df(spark, step), k)
        if k in (2, 4):
            det(points_df(spark, step), k)
    assert sorted((r.source, r.last_ts, r.batch_id) for r in det.expired(spark).collect()) == [("a", 10, 2), ("a", 160, 4)]
    assert {r.seq: r.n for r in det.scored(spark).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 3, 6: 1, 7: 4, 8: 5}
    assert [r.source for r in det.windows.latest(spark).filter("size(_tail) > 0").collect()] == ["b"]


def test_batches_without_points(spark, tmp_path):
    det = WindowedDetector(str(tmp_path / "d"), CFG, delay_seconds=5, expire_seconds=5, buckets=2)
    none = points_df(spark, [(1, 1, 1.0)]).limit(0)
    det(none, 0)
    det(points_df(spark, [(1, 1, 1.0)]), 1)
    det(none, 2)
    det.flush(spark, none.schema, 2)
    assert det.scored(spark).count() == 1 and det.late(spark).count() == 0
