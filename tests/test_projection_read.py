import pytest
from pyspark.sql import functions as F

from vigil.operators.projection import first_wins, fold_series_state, project, with_dedup_key
from vigil.operators.read_api import (clamp_anomaly_page, get_series_state, list_anomalies,
                                      list_series, parse_int_param, parse_series_key)

DDL = ("subject string, stream_seq long, source string, metric_name string, env string, region string, "
       "instance_id string, timestamp long, value double, baseline double, mad double, threshold double, "
       "window_size int, threshold_k double, detector string, event_id string, event_type string, "
       "producer string, occurred_at string, produced_at string, trace_id string, event_version int")


def row(seq, ts, v, event_id, source="s"):
    return ("anomaly.detected", seq, source, "m", "prod", "eu", "i", ts, v, 1.0, 1.0, 2.0, 50, 3.0,
            "MAD", event_id, "anomaly.detected", "p", "", "", "", 2)


def test_first_wins_and_fallback_key(spark):
    rows = [row(1, 10, 1.0, "a"), row(5, 10, 1.0, "a"), row(2, 11, 2.0, ""), row(3, 11, 2.0, "")]
    firsts = first_wins(with_dedup_key(spark.createDataFrame(rows, DDL)))
    got = sorted((r.dedup_key, r.stream_seq) for r in firsts.collect())
    assert got == [("a", 1), ("anomaly.detected:2", 2), ("anomaly.detected:3", 3)]


def test_ledger_skips_processed(spark):
    dec = with_dedup_key(spark.createDataFrame([row(1, 10, 1.0, "a"), row(2, 11, 1.0, "b")], DDL))
    ledger = spark.createDataFrame([("a",)], "dedup_key string")
    assert [r.dedup_key for r in first_wins(dec, ledger).collect()] == ["b"]


def test_projecting_twice_equals_once(spark):
    dec = with_dedup_key(spark.createDataFrame([row(1, 10, 1.0, "a"), row(2, 11, 5.0, "b")], DDL))
    ev1, ledger, st1 = project(dec, updated_at="2024-01-01 00:00:00")
    ev2, _, st2 = project(dec, ledger=ledger, previous_state=st1, updated_at="2024-01-01 00:00:00")
    assert ev1.count() == 2 and ev2.count() == 0
    assert st1.exceptAll(st2).count() == 0


def test_late_old_event_overwrites_state(spark):
    rows = [row(1, 100, 1.0, "a"), row(2, 200, 2.0, "b"), row(3, 50, 3.0, "c")]
    ev, _, st = project(with_dedup_key(spark.createDataFrame(rows, DDL)))
    r = st.first()
    assert (r.last_ts, r.last_value) == (50, 3.0)
    # incremental merge gives the same as folding everything at once
    part1, _, s1 = project(with_dedup_key(spark.createDataFrame(rows[:2], DDL)))
    part2, _, s2 = project(with_dedup_key(spark.createDataFrame(rows[2:], DDL)), previous_state=s1)
    assert s2.first().last_value == 3.0


def test_page_clamps():
    assert clamp_anomaly_page(-1, -5) == (100, 0)
    assert clamp_anomaly_page(0, 3) == (100, 3)
    assert clamp_anomaly_page(1001, 0) == (1000, 0)
    assert parse_int_param("", 100) == 100 and parse_int_param("abc", 7) == 7
    with pytest.raises(ValueError):
        parse_int_param(str(2 ** 31), 0)


def test_series_key_parse():
    assert parse_series_key("source|metric|test|us-east-1") == ("source", "metric", "test", "us-east-1")
    assert parse_series_key("s|m||") == ("s", "m", "", "")
    for bad in ("a|b|c", "a|b|c|d|e"):
        with pytest.raises(ValueError):
            parse_series_key(bad)


def test_list_and_get(spark):
    rows = [row(i, 1000 + i, float(i), f"e{i}", source="s" if i % 2 else "t") for i in range(30)]
    ev, _, st = project(with_dedup_key(spark.createDataFrame(rows, DDL)))
    page = list_anomalies(ev, source="s", limit=5)
    assert [r.ts for r in page.collect()] == [1029, 1027, 1025, 1023, 1021]
    assert [r.ts for r in list_anomalies(ev, from_ts=1010, to_ts=1012, env="").collect()] == [1012, 1011, 1010]
    assert [r.ts for r in list_anomalies(ev, limit=2, offset=1).collect()] == [1028, 1027]
    assert list_series(st).count() == 2 and list_series(st, source="t").first().last_ts == 1028
    assert get_series_state(st, "s|m|prod|eu").count() == 1
    assert get_series_state(st, "x|m|prod|eu").count() == 0


def test_list_anomalies_is_top_k_with_pushed_filters(spark, tmp_path):
    rows = [row(i, 1000 + i, float(i), f"e{i}") for i in range(20)]
    ev, _, _ = project(with_dedup_key(spark.createDataFrame(rows, DDL)))
    path = str(tmp_path / "events")
    ev.write.partitionBy("event_date").parquet(path)
    q = list_anomalies(spark.read.parquet(path), source="s", from_ts=1005, limit=3)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "PushedFilters" in plan and "EqualTo(source,s)" in plan
    assert "PartitionFilters" in plan and "event_date" in plan
    assert F is not None


def test_series_key_column_parse(spark):
    from vigil.operators.read_api import split_series_key_col
    df = spark.createDataFrame([("a|b|c|d",), ("a|b||",), ("a|b|c",)], "series_key string")
    got = [tuple(r) for r in df.select(*split_series_key_col()).collect()]
    assert got == [("a", "b", "c", "d", True), ("a", "b", "", "", True), (None, None, None, None, False)]


def test_read_queries_scan_the_stored_model(spark, capsys):
    """Filters of the registered read queries reach the stored tables."""
    from vigil.plans.catalog import REGISTRY
    sf = "/root/testdata/sf0.001"
    REGISTRY["list_anomalies_time_range"].build(spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(ts," in plan
    assert "Window" not in plan and "HashAggregate" not in plan
    REGISTRY["get_series_state"].build(spark, sf).explain("formatted")
    assert "EqualTo(source,svc-1)" in capsys.readouterr().out


def test_text_bounds():
    from vigil.operators.read_api import parse_bound
    assert [parse_bound(x) for x in ("5", 7, "", None, "soon", "1.5", str(1 << 70))] == [5, 7, None, None, None, None, None]
