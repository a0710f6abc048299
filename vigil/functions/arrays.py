"""Array expressions used by the sliding-window detector.

All of these are built-in higher-order/array functions, so they run inside
whole-stage codegen on the JVM; no Python is involved per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def materialize(df, name: str, expr: Column):
    """Add ``expr`` as column ``name`` behind a generator, so later filters
    on it cannot be pushed below (and re-evaluate) the expression. Used for
    expensive parses that several predicates and outputs read."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def sorted_median(sorted_arr: Column) -> Column:
    """Median of an ascending array: the middle element for odd sizes, the mean
    of the two middle elements for even sizes, 0.0 for an empty array."""
    n = F.size(sorted_arr)
    lo = F.try_element_at(sorted_arr, ((n + 1) / 2).cast("int"))
    hi = F.try_element_at(sorted_arr, ((n + 2) / 2).cast("int"))
    return (F.when(n <= 0, F.lit(0.0))
            .when(n % 2 == 1, lo)
            .otherwise((lo + hi) / 2))


def tail(arr: Column, k: int) -> Column:
    """The last ``k`` elements of an array (all of it when shorter)."""
    n = F.size(arr)
    return F.slice(arr, F.greatest(n - k + 1, F.lit(1)), F.lit(k))


def since_last_gap(points: Column, gap_seconds: int) -> Column:
    """Given an array of struct(ts, v) in time order, keep the elements from the
    last idle gap (consecutive ts differing by more than ``gap_seconds``)
    onwards. Returns the kept sub-array."""
    n = F.size(points)
    # gaps[k] (1-based) tells whether a gap precedes points[k + 1]
    gaps = F.zip_with(F.slice(points, 2, F.greatest(n - 1, F.lit(0))),
                      F.slice(points, 1, F.greatest(n - 1, F.lit(0))),
                      lambda a, b: (a["ts"] - b["ts"]) > F.lit(gap_seconds))
    rev_pos = F.array_position(F.reverse(gaps), True)
    start = F.when(rev_pos == 0, F.lit(1)).otherwise(n - rev_pos + 1).cast("int")
    return F.slice(points, start, n - start + 1)
