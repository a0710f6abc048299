"""Registered queries against their DuckDB oracle SQL on the smallest
driver tables (the same comparison tools/oracle_check.py runs at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from vigil.sources.tables import TABLES, table_path

QUERIES = ["mad_stats", "mad_chunked", "mad_both", "mad_stale_reset_chunked", "ingest_rejected",
           "envelope_roundtrip", "dedup_first", "series_state_late_arrival", "list_anomalies_page2",
           "get_series_state", "ext_daily_sequence", "mad_stats_numpy", "mad_window_5000_chunked", "mad_sparse_seq",
           "decode_payload_text", "decode_payload_rejected", "ml_payload_text", "envelope_payload_text",
           "ext_ttl_dedup_batch", "ext_red_histogram", "ext_slo_stages", "ext_cardinality_daily", "ext_dlq_payloads",
           "autoencoder_fixed", "isolation_forest_calibrated", "stream_mad_hot"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(SF_SMALL, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _rows(rows, cols, order):
    idx = [cols.index(c) for c in order]
    out = []
    for r in rows:
        out.append(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in idx))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = sorted(sdf.columns)
    got = _rows([tuple(r) for r in sdf.collect()], sdf.columns, order)
    exp = _rows(rel.fetchall(), rel.columns, order)
    assert got == exp
