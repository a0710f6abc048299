"""Work and memory that must not grow faster than the rows: dense seconds, halos
of small chunks, long series in Python."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from conftest import points_df
from vigil.config import MadConfig
from vigil.functions import kernels
from vigil.operators import mad
from vigil.schemas import SERIES_KEY

CFG = MadConfig.service_defaults()
COLUMNS = [*SERIES_KEY, "instance_id", "timestamp", "value", "seq"]


def _second_rows(n, apart=1):
    return [(i * apart, 1_704_067_200, float(i * 37 % 101)) for i in range(n)]


def _planned(spark, rows, target):
    pts = mad._normalize_keys(points_df(spark, rows), list(SERIES_KEY))
    plan = mad.plan_chunks(pts, target_rows=target)
    return pts, plan, [(r.seq, r["_chunk"]) for r in mad._with_chunk(pts, plan).orderBy("seq").collect()]


@pytest.mark.parametrize("n,target", [(1000, 40), (997, 50), (130, 50)])
def test_dense_second_is_cut_by_rank_at_its_quantiles(spark, n, target):
    pts, plan, got = _planned(spark, _second_rows(n), target)
    tables = [*plan.levels, plan.placed]
    assert not [c for t in tables for c, kind in t.dtypes if kind.startswith("array")]  # no list of cuts for each row
    parts = max(2, -(-2 * n // target))
    cuts = pts.selectExpr(f"percentile_approx(seq, array({', '.join(f'{k / parts!r}D' for k in range(1, parts))}), 10000) AS c").first().c
    first = [max([c for c in cuts if c <= seq], default=0) for seq, _ in got]
    assert [chunk for _, chunk in got] == [f // target for f in first]


def test_sparse_sequence_numbers_are_cut_alike(spark):
    _, plan, near = _planned(spark, _second_rows(600), 50)
    _, _, far = _planned(spark, _second_rows(600, 1_000_003), 50)
    assert plan.placed is not None and [c for _, c in near] == [c for _, c in far]


def test_dense_seconds_beside_others_and_repeated_rows(spark):
    rows = _second_rows(300) + [(1000 + i, 1_704_067_200 + i % 90, float(i % 13)) for i in range(400)]
    rows += rows[:150]
    cfg = CFG.with_(window_size=30)
    a = mad.mad_detect(points_df(spark, rows), cfg, chunk_seconds=None)
    b = mad.mad_detect(points_df(spark, rows), cfg, target_chunk_rows=20)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_halo_rows_are_copied_only_for_windows_that_hold_them(spark):
    pts = mad._with_chunk(mad._normalize_keys(points_df(spark, [(i, i, 1.0) for i in range(400)]), list(SERIES_KEY)), 20)
    fed = mad._chunk_table(pts, list(SERIES_KEY), 50).orderBy("_chunk").collect()
    # 49 positions reach over three chunks of 20; each row names its few, not the next 49 chunks
    assert [len(r["_fed"] or []) for r in fed] == [3] * 17 + [2, 1, 0]
    local = pts.selectExpr("*", "CAST(timestamp % 20 + 1 AS INT) AS _rn", "20L AS _cn")
    halo = mad._halo_rows(local, pts, list(SERIES_KEY), 50, pts["value"])
    assert halo.count() == 20 + 40 + 49 * 17 and dict(halo.dtypes)["_all"] == "bigint"


def test_numpy_engine_holds_a_batch_and_not_a_series(spark, monkeypatch):
    pts = points_df(spark, [(i, i * 7, float(i % 31)) for i in range(500)])
    for target in (2_000_000, 60):
        df = mad.mad_detect(pts, CFG, engine="numpy", target_chunk_rows=target)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "GroupsInPandas" not in plan
        assert df.count() == 500
    seen, whole = [], kernels._median_and_mad
    monkeypatch.setattr(kernels, "_median_and_mad", lambda v, s, n, w: seen.append(len(s)) or whole(v, s, n, w))
    kernels.window_stats_batch(np.zeros(0), np.zeros(0), np.arange(50_000.0), np.arange(50_000), CFG, None, None)
    assert sum(seen) == 50_000 and max(seen) * CFG.window_size <= kernels.BLOCK_CELLS


def test_numpy_kernel_carries_windows_over_batches():
    import pyarrow as pa
    kinds = {"n": pa.int32(), "baseline": pa.float64(), "mad": pa.float64(), "lower": pa.float64(),
             "upper": pa.float64(), "is_anomaly": pa.bool_(), "reset": pa.bool_()}
    rng = np.random.default_rng(1)
    ts = np.cumsum(rng.choice([1, 5, 5000], size=400, p=[.5, .48, .02]))
    t = pa.table({"k": ["a"] * 250 + ["b"] * 150, "timestamp": ts, "seq": range(400), "value": rng.normal(100, 30, 400)})
    kernel = mad._numpy_kernel(CFG, 3000, ["k"], t.column_names, kinds)
    whole = pa.Table.from_batches(kernel(t.combine_chunks().to_batches()))
    cut = pa.Table.from_batches(kernel(t.to_batches(max_chunksize=7)))
    assert whole.to_pylist() == cut.to_pylist() and whole["n"][250].as_py() == 1


def _processed(rows, gap):
    from vigil.streaming.detector import MadStateProcessorPandas
    state = {}
    proc = MadStateProcessorPandas(CFG, COLUMNS, gap)
    proc.window = SimpleNamespace(exists=lambda: "v" in state, get=lambda: state["v"], update=lambda v: state.update(v=v))
    tracemalloc.start()
    try:
        count, longest = 0, 0
        for out in proc.handleInputRows(("svc", "cpu", "prod", "eu"), rows, None):
            count, longest = count + len(out), max(longest, len(out))
        return count, longest, tracemalloc.get_traced_memory()[1], state["v"]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("gap", [None, 6 * 3600])
def test_stream_state_scores_a_long_series_in_slices(gap):
    def batches(n, size=10_000):
        for a in range(0, n, size):
            i = np.arange(a, a + size) * 7 % n  # out of order
            yield pd.DataFrame({"source": "svc", "metric_name": "cpu", "env": "prod", "region": "eu",
                                "instance_id": [f"user-{k}" for k in i], "timestamp": i * 11, "value": i % 97 * 1.0, "seq": i})

    count, longest, most, (window, last_ts) = _processed(batches(100_000), gap)
    assert count == 100_000 and longest <= 10_000 and last_ts == 99_999 * 11
    assert window == [float(i % 97) for i in range(99_950, 100_000)]
    assert most < 60e6  # windows of all rows at once take 40 MB for each copy of the matrix
