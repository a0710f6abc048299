import numpy as np
from pyspark.sql import functions as F

from conftest import points_df
from vigil.operators import extensions as X
from vigil.operators import scoring as SC


def _normal_with_outliers(spark, n=2000, seed=1):
    rng = np.random.default_rng(seed)
    vals = rng.normal(50, 2, n)
    out_idx = set(range(0, n, 200))
    rows = [(i, i * 10, 500.0 if i in out_idx else float(v)) for i, v in enumerate(vals)]
    return points_df(spark, rows), out_idx


def test_isolation_forest_ranks_outliers_high(spark):
    pts, outliers = _normal_with_outliers(spark)
    forest = SC.fit_isolation_forest(pts, ["value"], n_trees=50, psi=128, seed=3)
    assert len(forest) <= 50 * (2 * 128 - 1)           # bounded broadcast
    got = {r.seq: (r.if_score, r.if_anomaly) for r in
           SC.isolation_scores(pts, ["value"], forest).collect()}
    out_scores = [got[i][0] for i in outliers]
    in_scores = [s for k, (s, _) in got.items() if k not in outliers]
    assert min(out_scores) > np.percentile(in_scores, 99)
    assert all(got[i][1] for i in outliers)


def test_reconstruction_mse_and_pca(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 2.0, 2.0])], "x array<double>, y array<double>")
    assert df.select(SC.reconstruction_mse(F.col("x"), F.col("y")).alias("m")).first().m == 2.0 / 3
    pts, _ = _normal_with_outliers(spark, 600)
    out = SC.reconstruction_flags(pts, d=4, k=2).collect()
    losses = [r.custom_loss for r in out if r.custom_loss is not None]
    assert len(losses) == 600 - 3 and all(x >= 0 for x in losses)


def test_c_factor():
    assert SC.c_factor(1) == 0.0 and SC.c_factor(2) == 1.0
    assert abs(SC.c_factor(256) - 10.24) < 0.01


def test_bounds_and_oversize(spark):
    pts = points_df(spark, [(1, 1, 5.0), (2, 2, 500.0)])
    rules = spark.createDataFrame([("cpu", 0.0, 100.0)], "metric_name string, lo double, hi double")
    got = {r.seq: r.bounds_reason for r in X.bounds_check(pts, rules).collect()}
    assert got == {1: None, 2: "value out of bounds"}
    docs = spark.createDataFrame([(1, "a" * 10), (2, "b" * 2000)], "doc_id long, text string")
    ok, dlq = X.oversize_guard(docs, "text", limit_bytes=1500)
    assert [r.doc_id for r in ok.collect()] == [1]
    r = dlq.first()
    assert r.doc_id == 2 and len(r.text) == 1024 and r.payload_bytes == 2000


def test_daily_sequence_chunked_equals_plain(spark):
    rows = [(i, 86400 * 3 + i * 137, 1.0) for i in range(1500)]
    pts = points_df(spark, rows)
    a = {r.seq: r.daily_id for r in X.daily_sequence(pts, "source", target_chunk_rows=20).collect()}
    b = {r.seq: r.daily_id for r in X.daily_sequence(pts, "source").collect()}
    assert a == b
    day_ids = [a[i] for i in range(1500)]
    days = {d.split(":")[0] for d in day_ids}
    assert days == {"19700104", "19700105", "19700106"}
    first = int(day_ids[0].split(":")[1])
    assert 1000 <= first <= 10999 and int(day_ids[1].split(":")[1]) == first + 1


def test_alert_hold_runs(spark):
    # hour 0..4: errors in hours 1,2,3 only -> one run of 3
    rows = []
    seq = 0
    for h in range(5):
        for j in range(10):
            seq += 1
            metric = "error" if h in (1, 2, 3) and j < 5 else "cpu"
            rows.append((("svc", metric, "e", "r"), seq, h * 3600 + j, 1.0))
    out = X.alerts_with_hold(points_df(spark, rows), 3600, 0.3, 3).collect()
    assert [(r.start_ts, r.end_ts, r.buckets) for r in out] == [(3600, 10800, 3)]


def test_calibrated_cut_flags_the_wanted_share(spark):
    from vigil.operators.scoring import calibrated_cut
    scored = spark.range(40_000).select(F.rand(3).alias("if_score")).repartition(7)
    for share in (0.01, 0.05, 0.3):
        cut = calibrated_cut(scored, share, error=1e-3)
        got = scored.filter(F.col("if_score") > cut).count() / 40_000
        assert abs(got - share) <= 1.5e-3
    assert calibrated_cut(scored.limit(0), 0.1) == float("inf")


def test_network_gradients_match_differences():
    import numpy as np
    from vigil.operators.autoencoder import Network, _gradient
    rng = np.random.default_rng(1)
    net, x = Network.start(4, 2, 3, 3), rng.normal(size=(9, 4))
    flat, (grad, _) = net.flat(), _gradient(net, x)
    assert np.array_equal(net.like(flat).flat(), flat)
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (_gradient(net.like(up), x)[1] - _gradient(net.like(down), x)[1]) / 2e-6
        assert abs(slope - grad[i]) < 1e-5 * max(1, abs(slope))


def test_network_beats_the_linear_model_on_curved_data(spark):
    """Points on a parabola: one number through bent layers follows it, one
    principal direction can't."""
    import numpy as np
    from vigil.operators.autoencoder import Network, fit_network, with_reconstruction
    from vigil.operators.scoring import fit_pca_autoencoder, pca_reconstruction, reconstruction_mse
    t = np.random.default_rng(5).uniform(-1.5, 1.5, 400)
    rows = [([float(a), float(a * a - 0.75), float(-0.5 * a)],) for a in t]
    df = spark.createDataFrame(rows, "x array<double>").repartition(2).cache()
    linear = df.select(F.avg(reconstruction_mse(F.col("x"), pca_reconstruction("x", *fit_pca_autoencoder(df, "x", 3, 1))))).first()[0]
    net, loss = fit_network(df, "x", 3, 1, steps=120)
    assert loss < 0.7 * linear
    same = Network.from_table(net.table(spark))
    assert np.array_equal(same.flat(), net.flat())
    scored = with_reconstruction(df, "x", same).select(F.avg(reconstruction_mse(F.col("x"), F.col("reconstruction")))).first()[0]
    assert abs(scored - loss) < 1e-9
    assert fit_network(df.limit(0), "x", 3, 1)[1] == 0.0
