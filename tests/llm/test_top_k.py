"""Exact top-k search against a full sort."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import top_k


def brute(rows, k, every):
    whole = []
    for i, (vec_id, v) in enumerate(rows):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, vec_id, [math.floor(256 * x) for x in v]))
    out = []
    for i, q, a in whole:
        if q is None or q % every:
            continue
        found = [(-max(-top_k._LIMIT, min(top_k._LIMIT, sum(x * y for x, y in zip(a, b, strict=True)))),
                  c is None, c or 0, c) for j, c, b in whole if j != i and len(a) == len(b)]
        out += [(q, r + 1, c, -s) for r, (s, _, _, c) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, rows, k=5, every=7, **more):
    df = spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows],
                               "vec_id long, embedding array<float>, id int, q string, rank int")
    got = top_k.search(df, "vec_id", "embedding", F.col("id") % every == 0, k, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def vectors(rng, n, width):
    return [[float(np.float32(rng.gauss(0, 1))) for _ in range(width)] for _ in range(n)]


def test_plain_ties_and_odd_rows(spark):
    rng = random.Random(3)
    rows = list(enumerate(vectors(rng, 90, 6)))
    rows += [(200 + i, rows[4][1]) for i in range(40)]          # a hot group that ties
    rows += [(14, rows[3][1]), (14, rows[14][1]), (21, None), (28, [None] * 6), (35, [math.inf] + [0.0] * 5),
             (42, [math.nan] * 6), (None, rows[0][1]), (None, rows[4][1]), (-7, rows[5][1]), (49, [1.0, 2.0]), (3, [0.5, 0.5]),
             (56, []), (63, [-0.001] * 6), (70, [0.0] * 6)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows, 5, 7)


def test_blocks_of_queries(spark):
    rng = random.Random(4)
    rows = list(enumerate(vectors(rng, 60, 3)))
    assert run(spark, rows, k=3, every=2, block_rows=7) == brute(rows, 3, 2)


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(
        [[1e6, 3.0, 1e-3], [1e6, 3.0, 2.0], [2e6, -1e6, 0.5], [1e12, 1.0, 1.0], [1e25, 1.0, -1.0], [-1e30, 0.0, 0.0], [3e38] * 3])]
    assert run(spark, rows, k=3, every=1) == brute(rows, 3, 1)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_than_k(spark, n):
    rows = [(i * 7, [1.0, float(i)]) for i in range(n)]
    assert run(spark, rows) == brute(rows, 5, 7)


def test_equal_everything(spark):
    rows = [(i, [0.25] * 4) for i in range(60)]
    assert run(spark, rows, k=4) == brute(rows, 4, 7)
