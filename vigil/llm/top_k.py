"""Exact top-k search by inner product, through refined score histograms.

Vectors become integers floor(256 x). Queries travel in blocks of a fixed size
(``BLOCK_ROWS`` rows and ``BLOCK_BYTES`` bytes); for each block

1. every candidate is scored against every query of the block, tile by tile,
   and counted in a histogram per query, of 2^``BITS`` bins. The first covers
   the range the norms allow. A task reports its bins from the top until they
   hold more than the k rows still wanted, since what is below them can't hold
   the kth value;
2. the histograms are summed over all tasks, and the bin that holds the kth
   value becomes the next histogram's range, until a bin is one score wide;
3. a last pass keeps the rows above the kth value and, at it, each task's
   first by id; ties go to the smaller id.

No task holds more than a tile of scores and a block's histograms. Scores are
summed in float64 where that is exact, else as whole numbers of any size.

Defined cases: vectors that are null or hold a null, NaN or infinite component
take no part; a query meets the vectors of its own length only; a query's own
row is not its candidate, but other rows of the same id are; repeated rows are
queries and candidates of their own; rows without an id are no queries, and
come last among ties; scores beyond 2^62 - 1 either way count as that; an
empty table has no answers; other columns stay out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import only, read, stored
from vigil.llm.registry import register

K = 5
SCALE = 256
QUERY_EVERY = 50
#: Bins of a histogram, as a power of two.
BITS = 9
BLOCK_ROWS = 8192
BLOCK_BYTES = 16 << 20
TILE = 1 << 20
_LIMIT = (1 << 62) - 1
_LAST = np.iinfo(np.int64).max


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the vectors that take part."""
    src = only(vectors, id=key, vec=vector).withColumn("vec", F.col("vec").cast("array<double>"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return src.filter(F.col("vec").isNotNull() & ~bad)


def _matrices(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, has_id, whole-number matrix) of a batch's vectors, by length."""
    lists = batch.column("vec")
    width = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * float(scale))
    first = np.cumsum(width) - width
    id_column = batch.column("id")
    known = id_column.is_valid().to_numpy(zero_copy_only=False)
    ids = id_column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for n in np.unique(width):
        rows = np.flatnonzero(width == n)
        yield ids[rows], known[rows], flat[first[rows][:, None] + np.arange(n)]


def _whole(m: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact, cut to 62 bits."""
    if not rows.shape[1]:
        return np.zeros((len(queries), len(rows)), np.int64)
    with np.errstate(over="ignore"):
        largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if largest < 2.0 ** 52:
        return (queries @ rows.T).astype(np.int64)
    return np.clip(_whole(queries) @ _whole(rows).T, -_LIMIT, _LIMIT).astype(np.int64)


class Block:
    """A block of queries and how far each kth value is known: it is in one
    of the ``size`` ranges of 2^shift scores from ``low``, the ``need``-th highest
    of them."""

    def __init__(self, batch: pa.Table, scale: int, k: int, longest: float):
        self.parts, ids = [], []
        for piece in batch.combine_chunks().to_batches():
            for got, _, matrix in _matrices(piece, scale):
                at = sum(map(len, ids))
                self.parts.append((matrix.shape[1], np.arange(at, at + len(got)), matrix))
                ids.append(got)
        self.ids = np.concatenate(ids)
        n = len(self.ids)
        self.low, self.shift = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.size = np.full(n, 1 << BITS)  # bins
        self.own = np.zeros(n, np.int64)
        self.need = np.full(n, k, np.int64)
        self.open = np.ones(n, bool)
        for _, at, matrix in self.parts:
            for i, q in zip(at, matrix, strict=True):
                self.own[i] = scores(q[None], q[None])[0, 0]
                bound = min(_LIMIT, math.ceil(math.hypot(*q) * longest * (1 + 1e-9)) + 1) \
                    if math.isfinite(longest) and math.isfinite(math.hypot(*q) * longest) else _LIMIT
                self.low[i] = -bound
                self.shift[i] = max(0, (2 * bound).bit_length() - BITS)

    def tiles(self, batch: pa.RecordBatch, scale: int, every: bool):
        """(queries, ids, has_id, scores) of the block's open queries, or all."""
        for ids, known, rows in _matrices(batch, scale):
            for width, at, matrix in self.parts:
                if width != rows.shape[1]:
                    continue
                take = np.flatnonzero(self.open[at]) if not every else np.arange(len(at))
                if not len(take):
                    continue
                step = max(1, TILE // max(len(take), width))
                for a in range(0, len(rows), step):
                    yield at[take], ids[a:a + step], known[a:a + step], scores(matrix[take], rows[a:a + step])

    def bins(self, q: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins of scores (a row per query), and which scores are in range."""
        b = (s - self.low[q][:, None]) >> self.shift[q][:, None]
        return b, (b >= 0) & (b < self.size[q][:, None])

    def narrow(self, q: int, found: int | None, above: int) -> None:
        """Go on in the bin ``found``, which ``above`` rows surpass; without
        one there are fewer than k rows, and all of them are wanted."""
        if found is None:
            self.low[q], self.open[q] = -_LIMIT - 1, False
            return
        self.low[q] += found << int(self.shift[q])
        self.need[q] -= above
        self.open[q] = self.shift[q] > 0
        finer = max(0, int(self.shift[q]) - BITS)
        self.size[q], self.shift[q] = 1 << (int(self.shift[q]) - finer), finer


def _histograms(sent, scale: int):
    def run(batches):
        block = sent.value
        total = np.zeros((len(block.ids), 1 << BITS), np.int64)
        for batch in batches:
            for q, _, _, s in block.tiles(batch, scale, every=False):
                b, inside = block.bins(q, s)
                flat = (b + (np.arange(len(q)) << BITS)[:, None])[inside]
                total[q] += np.bincount(flat, minlength=len(q) << BITS).reshape(len(q), -1)
        above = total[:, ::-1].cumsum(1)[:, ::-1] - total
        q, b = np.nonzero((total > 0) & (above <= block.need[:, None]))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()),
                                              pa.array(total[q, b])], ["q", "bin", "n"])
    return run


def _kept(sent, scale: int):
    """Rows above the kth value, and a task's first by id of those at it."""
    def first(rows, room):
        q, ids, known, s = rows
        order = np.lexsort((ids, ~known, q))
        q, ids, known, s = q[order], ids[order], known[order], s[order]
        start = np.searchsorted(q, q)
        keep = np.arange(len(q)) - start < room[q]
        return q[keep], ids[keep], known[keep], s[keep]

    def run(batches):
        block = sent.value
        room = block.need + 1  # the query's own row may be among them
        bound = np.full(len(block.ids), _LAST)
        tied, held = [], 0

        def out(q, ids, known, s):
            return pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int32()), pa.array(block.ids[q]), pa.array(ids, pa.int64(), mask=~known),
                 pa.array(s), pa.array(block.own[q])], ["q", "query_id", "vec_id", "score", "own"])

        def settle():
            rows = first([np.concatenate(c) for c in zip(*tied, strict=True)], room)
            tied[:] = [rows]
            q, ids, known = rows[0], rows[1], rows[2]
            at, many = np.unique(q, return_counts=True)
            full = at[many == room[at]]
            last = np.searchsorted(q, full, side="right") - 1
            bound[full] = np.where(known[last], ids[last], _LAST)
            return len(q)

        for batch in batches:
            for q, ids, known, s in block.tiles(batch, scale, every=True):
                least = block.low[q][:, None]
                a, b = np.nonzero(s > least)
                if len(a):
                    yield out(q[a], ids[b], known[b], s[a, b])
                a, b = np.nonzero((s == least) & (ids <= bound[q][:, None]))
                if len(a):
                    tied.append((q[a], ids[b], known[b], s[a, b]))
                    held += len(a)
                    if held > TILE:
                        held = settle()
        if tied:
            settle()
            yield out(*tied[0])
    return run


def _search_block(src: DataFrame, block: Block, scale: int) -> DataFrame:
    spark = src.sparkSession
    by_bin = Window.partitionBy("q").orderBy(F.desc("bin"))
    while block.open.any():
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_ROWS queries
        counted = src.mapInArrow(_histograms(sent, scale), "q int, bin int, n long")
        live = np.flatnonzero(block.open)
        own, there = (x[:, 0] for x in block.bins(live, block.own[live][:, None]))
        mine = spark.createDataFrame([(int(q), int(b), -1) for q, b in zip(live[there], own[there], strict=True)],
                                     "q int, bin int, n long")
        wanted = spark.createDataFrame([(int(q), int(block.need[q])) for q in live], "q int, need long")
        summed = (counted.unionByName(mine).groupBy("q", "bin").agg(F.sum("n").alias("n"))
                  .withColumn("reached", F.sum("n").over(by_bin)).join(wanted, "q"))
        place = {r.q: (r.p.bin, r.p.above) for r in
                 summed.filter("reached >= need").groupBy("q")
                 .agg(F.max(F.struct("bin", (F.col("reached") - F.col("n")).alias("above"))).alias("p"))
                 .collect()}  # one row per query of the block
        for q in live.tolist():
            block.narrow(q, *place.get(q, (None, 0)))
        sent.unpersist()
    sent = spark.sparkContext.broadcast(block)
    kept = src.mapInArrow(_kept(sent, scale), "q int, query_id long, vec_id long, score long, own long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    own = F.coalesce((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.lit(False))
    ranked = (kept.withColumn("own_row", own)
              .withColumn("owns", F.sum(F.col("own_row").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("place", F.row_number().over(order))
              .filter("not (own_row and owns = 1)")
              .withColumn("rank", (F.col("place") - F.when(F.col("owns") > 0, 1).otherwise(0)).cast("int")))
    return ranked.select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, key: str, vector: str, is_query: F.Column, k: int = K, scale: int = SCALE,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest whole-number inner
    products of each query, a row for which ``is_query`` (over ``id``) holds."""
    src = usable(vectors, key, vector)
    queries = stored(src.filter(is_query).withColumn("row", F.monotonically_increasing_id()), "queries")
    longest = F.max(F.sqrt(F.aggregate(F.transform("vec", lambda x: F.pow(F.abs(x) * float(scale) + 1, 2.0)),
                                       F.lit(0.0), lambda a, x: a + x)))
    many, width = queries.agg(F.count("*"), F.max(F.size("vec"))).first()
    found = None
    if many:
        norm = src.agg(longest).first()[0]
        room = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, width))))
        blocks = -(-many // room)
        for b in range(blocks):
            mine = queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").select("id", "vec")
            table = mine.toArrow()  # one block: about ``room`` queries
            if not table.num_rows:
                continue
            got = _search_block(src, Block(table, scale, k, norm), scale).filter(F.col("rank") <= k)
            got = stored(got, "top-k")
            found = got if found is None else found.unionByName(got)
    if found is None:
        return src.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found


_SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
e AS (SELECT rid, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM t),
bad AS (SELECT DISTINCT rid FROM e WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT rid, vec_id, len(embedding) AS width FROM t WHERE rid NOT IN (SELECT rid FROM bad)),
c AS (SELECT rid, pos, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS y FROM e SEMI JOIN v USING (rid)),
dots AS (SELECT a.rid AS qrid, b.rid AS crid, sum(a.y * b.y) AS score
         FROM c a JOIN v q ON q.rid = a.rid AND q.vec_id % 50 = 0 JOIN c b ON a.pos = b.pos AND a.rid <> b.rid
         GROUP BY a.rid, b.rid),
s AS (SELECT q.rid AS qrid, q.vec_id AS query_id, k.vec_id, CAST(coalesce(d.score, 0) AS BIGINT) AS score
      FROM v q JOIN v k ON q.rid <> k.rid AND q.width = k.width
      LEFT JOIN dots d ON d.qrid = q.rid AND d.crid = k.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@register("op13_top_k_search", _SQL)
def op13_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every fiftieth embedding among all others."""
    return search(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % QUERY_EVERY == 0)
