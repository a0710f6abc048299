"""Dead letters, byte-exact cuts, strict types, projector state, sequences."""

import json

import pytest
from pyspark.sql import functions as F

from vigil.operators import extensions as X
from vigil.operators.envelope import decode_envelope
from vigil.operators.ingest import decode_metric_json, ml_payload_filter
from vigil.streaming.jobs import Projector, kafka_sequence


def test_dead_letters_keep_whole_payloads(spark):
    q = spark.createDataFrame([(1, "r", "é" * 3000)], "seq long, reason string, payload string")
    row = X.dead_letters(q).first()
    assert row.payload == "é" * 3000 and row.payload_bytes == 6000


@pytest.mark.parametrize("text", ["a" * 2000, "é" * 1024, "x" + "é" * 1024, "€" * 700, "ab" + "🙂" * 400, "short"])
def test_oversize_guard_cuts_bytes_between_code_points(spark, text):
    df = spark.createDataFrame([(text,)], "payload string")
    got = df.select(X.first_bytes(F.col("payload"), 1024).alias("p")).first().p
    want = text.encode()[:1024].decode(errors="ignore")
    assert got == want and len(got.encode()) <= 1024


def test_text_fields_of_other_types_are_malformed(spark):
    good = {"source": "s", "metric_name": "m", "value": 1.5, "env": "e", "region": "r", "instance_id": "i", "timestamp": 3}
    rows = [good, {**good, "env": None}, {"source": "s", "metric_name": "m"}]
    rows += [{**good, f: v} for f in ("source", "metric_name", "env", "region", "instance_id") for v in (5, True, {"a": 1}, ["x"])]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "seq long, payload string")
    points, bad = decode_metric_json(df)
    assert sorted(r.seq for r in points.collect()) == [0, 1, 2]
    assert bad.count() == len(rows) - 3
    env = spark.createDataFrame([(i, json.dumps({"meta": {"event_id": "e"}, "data": {**good, "detector": v}}))
                                 for i, v in enumerate(["d", 5, {"a": 1}])], "stream_seq long, payload string")
    decoded, quarantine = decode_envelope(env)
    assert [r.stream_seq for r in decoded.collect()] == [0] and quarantine.count() == 2


def test_model_intake_looks_at_the_value_only(spark):
    rows = ['{"metric_name":"m","value":1.0,"timestamp":1.5}', '{"metric_name":7,"value":2,"timestamp":"x"}',
            '{"value":null}', '{"value":[1]}', '[1]']
    keep, drop = ml_payload_filter(spark.createDataFrame(list(enumerate(rows)), "seq long, payload string"))
    assert [(r.seq, r.metric_name, r.value) for r in keep.orderBy("seq").collect()] == [(0, "m", 1.0), (1, "7", 2.0)]
    assert sorted(r.seq for r in drop.collect()) == [2, 3, 4]


def test_projector_refuses_a_missing_state(spark, tmp_path):
    flat = {"source": "s", "metric_name": "m", "value": 1.0, "baseline": 1.0, "mad": 1.0, "threshold": 2.0}
    batch = spark.createDataFrame([("t", 1, json.dumps(flat))], "subject string, stream_seq long, payload string")
    p = Projector(str(tmp_path))
    p(batch, 0)
    p(batch, 0)  # a retried batch gives the same tables
    assert p.events(spark).count() == 1 and p.latest_state(spark).count() == 1
    with pytest.raises(RuntimeError):
        p(batch, 5)


def test_kafka_sequences_differ_between_partitions(spark):
    df = spark.createDataFrame([(0, 7), (1, 7), (1, 8)], "partition int, offset long")
    got = [r[0] for r in df.select(kafka_sequence()).collect()]
    assert len(set(got)) == 3 and got == sorted(got)


def test_late_distinct_messages_pass_ttl_dedup(spark, tmp_path):
    from vigil.streaming.jobs import stream_to_parquet
    src, base = str(tmp_path / "in"), str(tmp_path / "run")
    schema = "k string, at timestamp, n int"
    steps = [[("a", 1000, 1), ("b", 1000, 2)], [("c", 5, 3), ("a", 1000, 4)], [("d", 1, 5), ("c", 5, 6)]]
    for rows in steps:
        df = spark.createDataFrame(rows, "k string, s long, n int").select("k", F.timestamp_seconds("s").alias("at"), "n")
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        out = stream_to_parquet(X.ttl_dedup_stream(stream, "k", "at"), "t", base=base, drain=True)
    assert sorted((r.k, r.n) for r in out.collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 5)]
