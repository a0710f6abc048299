import json

import pytest

from vigil.operators.envelope import decode_envelope, encode_envelope, int32_wrap
from vigil.operators.ingest import (decode_metric_json, encode_metric_json, ingest_metrics,
                                    ml_payload_filter)
from pyspark.sql import functions as F

F1 = ("orders-service", "latency_p95", 350.5, "prod", "eu-central-1", "pod-123", 1736448000)
METRIC_DDL = ("source string, metric_name string, value double, env string, region string, "
              "instance_id string, timestamp long")


def test_metric_json_contract(spark):
    df = spark.createDataFrame([F1], METRIC_DDL)
    js = json.loads(df.select(encode_metric_json(df).alias("j")).first().j)
    assert set(js) == {"source", "metric_name", "value", "env", "region", "instance_id", "timestamp"}
    assert js["value"] == 350.5 and js["timestamp"] == 1736448000
    src = spark.createDataFrame([(1, json.dumps(js))], "seq long, payload string")
    pts, bad = decode_metric_json(src)
    assert bad.count() == 0
    assert tuple(pts.select(*df.columns).first()) == F1


def test_metric_decode_defects(spark):
    src = spark.createDataFrame([(1, "{bad"), (2, '{"source":"a","metric_name":"m","value":"x"}'),
                                 (3, '{"source":"a","metric_name":"m"}'),
                                 (4, '{"source":"a","metric_name":"m","value":NaN}'),
                                 (5, '{"source":"a","metric_name":"m","value":3,"extra":1}')],
                                "seq long, payload string")
    pts, bad = decode_metric_json(src)
    assert sorted(r.seq for r in bad.collect()) == [1, 2, 4]
    got = {r.seq: r for r in pts.collect()}
    assert got[3].value == 0.0 and got[3].env == "" and got[3].timestamp == 0
    assert got[5].value == 3.0


def test_ingest_validation(spark):
    rows = [F1, ("", "m", 1.0, "", "", "", 1), ("s", None, 1.0, "", "", "", 1),
            ("s", "m", float("nan"), "", "", "", 1), ("s", "m", float("-inf"), "", "", "", 1),
            ("s", "m", None, None, None, None, None)]
    acc, rej = ingest_metrics(spark.createDataFrame(rows, METRIC_DDL))
    assert sorted(r.reason for r in rej.collect()) == ["invalid metric", "invalid metric",
                                                      "non-finite value", "non-finite value"]
    last = acc.filter("source = 's'").first()
    assert last.value == 0.0 and last.env == "" and last.timestamp == 0


def test_ml_payload_filter(spark):
    src = spark.createDataFrame([(1, '{"metric_name":"m","value":2}'), (2, '{"metric_name":"m"}'),
                                 (3, '{"value":"high"}'), (4, "nope")], "seq long, payload string")
    keep, drop = ml_payload_filter(src)
    assert [r.seq for r in keep.collect()] == [1]
    assert sorted((r.seq, r.reason) for r in drop.collect()) == [
        (2, "missing or invalid value"), (3, "malformed payload"), (4, "malformed payload")]


EV_DDL = ("source string, metric_name string, env string, region string, instance_id string, "
          "timestamp long, value double, baseline double, mad double, threshold double, "
          "window_size long, threshold_k double, detector string, event_id string, event_type string, "
          "event_version long, producer string, occurred_at string, produced_at string, trace_id string")
EV = ("integration_test", "cpu_usage", "test", "", "i-1234567890abcdef0", 0, 95.5, 50.0, 10.0, 3.0,
      60, 3.0, "mad", "e-1", "anomaly.detected", 1, "p", "2024-01-01T00:00:00Z",
      "2024-01-01T00:00:00Z", "")


def test_envelope_omits_empty_and_roundtrips(spark):
    ev = spark.createDataFrame([EV], EV_DDL)
    payload = ev.select(encode_envelope(ev).alias("p")).first().p
    js = json.loads(payload)
    assert "region" not in js and "timestamp" not in js and "region" not in js["data"]
    assert "trace_id" not in js["meta"] and js["data"]["value"] == 95.5
    stream = spark.createDataFrame([("anomaly.detected", 7, payload)], "subject string, stream_seq long, payload string")
    dec, bad = decode_envelope(stream)
    assert bad.count() == 0
    r = dec.first()
    assert (r.source, r.region, r.timestamp, r.window_size, r.event_version, r.event_id) == \
        ("integration_test", "", 0, 60, 1, "e-1")


def test_envelope_v1_and_invalid(spark):
    v2_bad = json.dumps({"meta": {"event_id": "x"}, "data": {"source": "", "metric_name": "m"},
                         "source": "good", "metric_name": "m"})
    v1 = json.dumps({"source": "s", "metric_name": "m", "value": 1.5, "window_size": 2 ** 32 + 5})
    rows = [("a", 1, v2_bad), ("a", 2, v1), ("a", 3, "{bad"), ("a", 4, json.dumps({"metric_name": "m"})),
            ("a", 5, json.dumps({"meta": None, "data": None, "source": "s", "metric_name": "m"}))]
    dec, bad = decode_envelope(spark.createDataFrame(rows, "subject string, stream_seq long, payload string"))
    assert sorted((r.stream_seq, r.reason) for r in bad.collect()) == [
        (1, "invalid envelope"), (3, "malformed payload"), (4, "invalid envelope")]
    got = {r.stream_seq: r for r in dec.collect()}
    assert got[2].event_id == "" and got[2].event_version == 0 and got[2].window_size == 5
    assert got[5].source == "s"


def test_int32_wrap(spark):
    df = spark.createDataFrame([(2 ** 31,), (-(2 ** 31) - 1,), (7,)], "x long")
    assert [r.y for r in df.select(int32_wrap(F.col("x")).alias("y")).collect()] == \
        [-(2 ** 31), 2 ** 31 - 1, 7]


@pytest.mark.parametrize("tail", [" x", "{}", "}", "]", ",", ',{"a":1}', '],[{"b":1}', " // c", "null", " 1"])
def test_text_after_the_object_is_malformed(spark, tail):
    from vigil.operators.envelope import decode_envelope
    from vigil.operators.ingest import decode_metric_json, ml_payload_filter
    text = '{"source":"a","metric_name":"m","value":1}' + tail
    df = spark.createDataFrame([(1, text)], "seq long, payload string")
    for decode in (decode_metric_json, decode_envelope, ml_payload_filter):
        good, bad = decode(df)
        assert good.count() == 0 and bad.first().payload == text


def test_odd_but_whole_payloads(spark):
    from vigil.operators.ingest import decode_metric_json
    rows = ["null", " \n null\t", "", None, "5", '"x"', "[]", "{}", '{"value":1,}', "{'value':1}", '{"value":NaN}', '{"more":NaN}',
            '{"source":null,"more":{"a":1,"a":2},"value":2}', '{"source":5,"more":{"a":1,"a":2}}', "nul"]
    good, bad = decode_metric_json(spark.createDataFrame(list(enumerate(rows)), "seq long, payload string"))
    assert sorted((r.seq, r.source, r.value) for r in good.collect()) == [(0, "", 0.0), (1, "", 0.0), (7, "", 0.0), (12, "", 2.0)]
    assert bad.count() == len(rows) - 4
