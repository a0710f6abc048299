import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vigil.session import get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8, app_name="vigil-tests")
    yield s
    s.stop()


def points_df(spark, rows, series=("svc", "cpu", "prod", "eu")):
    """Tiny metric-point frame: rows are (seq, timestamp, value) or
    (series_tuple, seq, timestamp, value)."""
    out = []
    for r in rows:
        if len(r) == 4:
            key, seq, ts, v = r
        else:
            key, (seq, ts, v) = series, r
        out.append((*key, "i-1", int(ts), float(v), int(seq)))
    return spark.createDataFrame(
        out, "source string, metric_name string, env string, region string, instance_id string, "
             "timestamp long, value double, seq long")
