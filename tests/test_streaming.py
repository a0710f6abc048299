import json
import tempfile

from pyspark.sql import functions as F

from conftest import points_df
from test_mad import _rand_rows
from vigil.config import MadConfig
from vigil.operators.envelope import decode_envelope, stamp_anomaly_events
from vigil.operators.ingest import decode_metric_json
from vigil.operators.mad import detect_anomalies, mad_detect
from vigil.streaming.detector import stream_mad_detect
from vigil.streaming.jobs import (run_available_now, stream_to_parquet, write_anomaly_stream,
                                      write_metric_stream, write_prediction_stream)


def _as_stream(spark, df, name):
    path = tempfile.mkdtemp(prefix=f"vigil-test-{name}-")
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_stream_equals_batch_with_reset(spark):
    pts = points_df(spark, _rand_rows(11))
    cfg = MadConfig.service_defaults().with_(window_size=20, warmup=5)
    cols = ["seq", "n", "baseline", "mad", "lower", "upper", "is_anomaly", "reset"]
    batch = mad_detect(pts, cfg, chunk_seconds=None, stale_gap_seconds=3000).select(*cols)
    stream = stream_to_parquet(stream_mad_detect(_as_stream(spark, pts, "pts"), cfg,
                                                 stale_gap_seconds=3000), "t-stream").select(*cols)
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_sinks_publish_decodable_json(spark):
    pts = points_df(spark, _rand_rows(12))
    cfg = MadConfig.service_defaults().with_(window_size=20, warmup=5)
    out = tempfile.mkdtemp(prefix="vigil-test-sinks-")
    run_available_now(write_metric_stream(_as_stream(spark, pts, "m"), f"{out}/metrics", f"{out}/c1"))
    got = spark.read.text(f"{out}/metrics").select(F.col("value").alias("payload"), F.lit(0).alias("seq"))
    dec, bad = decode_metric_json(got)
    assert bad.count() == 0 and dec.count() == pts.count()

    ev = stamp_anomaly_events(detect_anomalies(pts, cfg, chunk_seconds=None), cfg.threshold_k)
    stored = tempfile.mkdtemp(prefix="vigil-test-ev-")
    ev.write.mode("overwrite").parquet(stored)
    run_available_now(write_anomaly_stream(spark.readStream.schema(ev.schema).parquet(stored),
                                           f"{out}/anoms", f"{out}/c2"))
    env = spark.read.text(f"{out}/anoms").select(F.lit("anomaly.detected").alias("subject"),
                                                 F.lit(1).alias("stream_seq"),
                                                 F.col("value").alias("payload"))
    dec2, bad2 = decode_envelope(env)
    assert bad2.count() == 0 and dec2.count() == ev.count() > 0

    preds = ev.select("metric_name", F.lit("vigil-ml").alias("producer"), "timestamp",
                      F.struct(F.lit(True).alias("if_anomaly"), F.lit(0.1).alias("custom_loss"),
                               F.lit(True).alias("is_degradation")).alias("results"))
    pstore = tempfile.mkdtemp(prefix="vigil-test-pred-")
    preds.write.mode("overwrite").parquet(pstore)
    run_available_now(write_prediction_stream(spark.readStream.schema(preds.schema).parquet(pstore),
                                              f"{out}/preds", f"{out}/c3"))
    first = json.loads(spark.read.text(f"{out}/preds").first().value)
    assert set(first) == {"metric_name", "source", "results", "timestamp"}
    assert first["results"]["custom_loss"] == 0.1


def test_vectorized_state_equals_row_form():
    import numpy as np
    from vigil.streaming.detector import window_stats, window_stats_batch
    rng = np.random.default_rng(0)
    cfg = MadConfig.service_defaults().with_(window_size=12, warmup=4)
    ts = np.cumsum(rng.choice([1, 5, 60, 5000], size=300))
    vals = rng.normal(100, 5, size=300)
    vals[rng.random(300) < 0.05] = 400.0
    # row-by-row reference
    exp, win, last = [], [], None
    for t, v in zip(ts, vals):
        reset = last is not None and t - last > 3000
        if reset:
            win = []
        win = (win + [float(v)])[-12:]
        exp.append((*window_stats(win, float(v), cfg), bool(reset)))
        last = t
    # vectorised, fed in uneven micro-batches
    got, hist, last = [], np.zeros(0), None
    for a, b in ((0, 7), (7, 8), (8, 150), (150, 300)):
        r = window_stats_batch(hist, np.zeros(0), vals[a:b], ts[a:b], cfg, 3000, last)
        got += list(zip(*[c.tolist() for c in r[:7]]))
        hist, last = r[7], r[8]
    assert [tuple(g) for g in got] == exp


def test_stream_state_ttl_mode_runs(spark):
    # processing-time TTL on the window state (idle series expire); run as a
    # service would (processing-time trigger, drained, stopped). Nothing
    # expires within the run, so results equal the batch form.
    from vigil.streaming.jobs import run_until_drained
    pts = points_df(spark, _rand_rows(13))
    cfg = MadConfig.service_defaults().with_(window_size=20, warmup=5)
    cols = ["seq", "n", "baseline", "mad", "is_anomaly"]
    batch = mad_detect(pts, cfg, chunk_seconds=None).select(*cols)
    out = tempfile.mkdtemp(prefix="vigil-test-ttl-")
    scored = stream_mad_detect(_as_stream(spark, pts, "ttl"), cfg, state_ttl_ms=3_600_000)
    run_until_drained(scored.writeStream.format("parquet").option("path", f"{out}/o")
                      .option("checkpointLocation", f"{out}/c"))
    stream = spark.read.parquet(f"{out}/o").select(*cols)
    assert batch.exceptAll(stream).count() == 0 and stream.count() == batch.count()


def test_batch_detector_rejects_streams(spark):
    import pytest
    pts = points_df(spark, _rand_rows(14))
    with pytest.raises(ValueError):
        mad_detect(_as_stream(spark, pts, "rej"), MadConfig())
