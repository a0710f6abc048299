"""Merkle dataset manifest in a van Emde Boas layout.

Every row is a leaf: the SHA-256 of its length-prefixed fields. The leaves of a
group (here a source), in order of their key, make a tree of fan-out
``FANOUT``; the groups' roots, in order of the group, make the tree above.

A tree is stored as aligned subtrees of ``HEIGHT`` levels of edges, one row
each: a byte array of 32-byte digests in van Emde Boas order. That order splits
a tree at half its height, stores the top part, then each bottom part, all in
the same way; ``address`` gives a node's place by arithmetic alone, both when a
subtree is built and when siblings are read. The roots of subtrees are the
leaves of the next tier of subtrees, until one is left.

Spark deals the leaves by range of (group, key), so a rank is a position within
a partition plus the counts of those before it, and then by subtree. However
large a group is, a task holds one subtree of at most FANOUT^HEIGHT leaves at a
time. From the top tier down, each subtree hands the siblings above to the
subtrees below it; the lowest tier recomputes the root from every leaf.

Defined cases: a null field is ``-``; null and empty groups and values differ;
null groups and null keys come first; rows of one group and key are ordered by
their leaf; repeated rows are leaves of their own; a lone leaf is its tree's
root; an empty table has no tree and no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import read, shuffle_width, stored
from vigil.llm.registry import register

FANOUT = 16
#: Levels of edges in a stored subtree.
HEIGHT = 3
CAP = FANOUT ** HEIGHT
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOP = "^"  # the tree over the groups' roots


# ---------------------------------------------------------------- layout
def size(levels: int) -> int:
    """Nodes of a complete tree of so many levels of nodes."""
    return (FANOUT ** levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes ``index`` at ``depth`` (0 is the root) of a complete
    tree of ``levels`` levels of nodes in van Emde Boas order."""
    base = np.zeros(len(index), np.int64)
    while levels > 1:
        top = levels // 2
        bottom = levels - top
        if depth < top:
            levels = top
            continue
        depth -= top
        width = FANOUT ** depth
        base += size(top) + index // width * size(bottom)
        index, levels = index % width, bottom
    return base


@lru_cache(maxsize=None)
def _places(height: int) -> list[np.ndarray]:
    """Addresses of a subtree's nodes by level, leaves first."""
    return [address(height + 1, height - up, np.arange(FANOUT ** (height - up))) for up in range(height + 1)]


def digest_of(hexes) -> bytes:
    return hashlib.sha256("".join(hexes).encode()).digest()


def height_of(total: int) -> int:
    """Levels of edges of the subtrees of a tree of ``total`` leaves."""
    up, room = 0, 1
    while room < total and up < HEIGHT:
        up, room = up + 1, room * FANOUT
    return up


def lay_out(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """(nodes in van Emde Boas order, root) of a subtree; absent nodes are
    zero, and those after the last present one are cut off."""
    nodes = bytearray(32 * size(height + 1))
    last, level = 0, leaves
    for up, places in enumerate(_places(height)):
        for p, d in zip(places.tolist(), level, strict=False):
            nodes[32 * p:32 * p + 32] = d
        last = max(last, int(places[:len(level)].max()))
        if up < height:
            hexes = [d.hex() for d in level]
            level = [digest_of(hexes[i:i + FANOUT]) for i in range(0, len(hexes), FANOUT)]
    return bytes(nodes[:32 * (last + 1)]), level[0]


class Subtree:
    """Siblings of a stored subtree, read by address."""

    def __init__(self, nodes: bytes, count: int, height: int):
        self.height = height
        self.levels = []
        for up in range(height + 1):
            places = _places(height)[up][:-(-count // FANOUT ** up)]
            self.levels.append([nodes[32 * p:32 * p + 32].hex() for p in places.tolist()])
        self.paths: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def path(self, index: int, up: int = 0) -> list[tuple[str, str]]:
        """(left, right) siblings, joined, from node ``index`` of level ``up``
        to the subtree's root."""
        if up == self.height:
            return []
        level, first = self.levels[up], index // FANOUT * FANOUT
        here = ("".join(level[first:index]), "".join(level[index + 1:first + FANOUT]))
        key = (up + 1, index // FANOUT)
        if key not in self.paths:
            self.paths[key] = self.path(index // FANOUT, up + 1)
        return [here, *self.paths[key]]


def _write(path: list[tuple[str, str]]) -> str:
    return "\n".join(f"{a}|{b}" for a, b in path)


def _read(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split("|")) for line in text.split("\n")] if text else []


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """Root recomputed from a leaf and its siblings."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


# ---------------------------------------------------------------- ranks and tiers
def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def ranked(items: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0) within ``tree`` by ``order`` and the tree's
    ``total``. Rows are dealt by range; no task takes a whole tree."""
    spark = items.sparkSession
    keys = ["tree", *order, "row"]
    dealt = (items.withColumn("row", F.monotonically_increasing_id())
             .repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys).drop("row"))

    def number(batches):
        part, last, at = TaskContext.get().partitionId(), None, 0
        for b in batches:
            out = []
            for tree in b.column("tree").to_pylist():
                at = at + 1 if tree == last else 0
                last = tree
                out.append(at)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(out, pa.int64())],
                [*b.schema.names, "part", "at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    placed = stored(dealt.mapInArrow(number, f"{schema}, part int, at long"), "ranked")
    counts = placed.groupBy("tree", "part").agg((F.max("at") + 1).alias("n"))
    by_part = Window.partitionBy("tree").orderBy("part")
    before = counts.select("tree", "part", F.sum("n").over(Window.partitionBy("tree")).alias("total"),
                           (F.sum("n").over(by_part) - F.col("n")).alias("before"))
    return (placed.join(before, ["tree", "part"]).withColumn("rank", F.col("before") + F.col("at"))
            .drop("part", "at", "before"))


def _blocked(items: DataFrame) -> DataFrame:
    """Items (tree, rank, ...) by subtree, each subtree's rows in order."""
    return (items.withColumn("block", F.floor(F.col("rank") / CAP)).withColumn("pos", (F.col("rank") % CAP).cast("int"))
            .drop("rank"))


def _together(rows: DataFrame) -> DataFrame:
    return (rows.repartition(shuffle_width(rows.sparkSession), "tree", "block")
            .sortWithinPartitions("tree", "block", "pos"))


def _build(batches):
    """Subtrees of leaves (tree, block, pos, total, digest) in order."""
    last, leaves, total = None, [], 0

    def done():
        height = height_of(total)
        nodes, root = lay_out(leaves, height)
        return [[last[0]], [last[1]], [len(leaves)], [height], [total], [nodes], [root]]

    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = ["tree", "block", "n", "height", "total", "nodes", "root"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    for b in batches:
        for tree, block, t, digest in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "total", "digest")),
                                          strict=True):
            if (tree, block) != last:
                if last is not None:
                    yield batch(done())
                last, leaves, total = (tree, block), [], t
            leaves.append(digest)
    if last is not None:
        yield batch(done())


def tiers(items: DataFrame) -> list[DataFrame]:
    """Stored subtrees (tree, block, n, height, total, nodes, root) of the
    items (tree, rank, total, digest), lowest tier first."""
    out = []
    while True:
        rows = _together(_blocked(items).select("tree", "block", "pos", "total", "digest"))
        built = stored(rows.mapInArrow(
            _build, "tree string, block long, n int, height int, total long, nodes binary, root binary"), "subtrees")
        out.append(built)
        more = built.filter(F.col("total") > CAP)
        if not more.limit(1).count():
            return out
        items = more.select("tree", F.col("block").alias("rank"), F.ceil(F.col("total") / CAP).alias("total"),
                            F.col("root").alias("digest"))


def roots(built: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree, from the tier where it is one subtree."""
    found = None
    for t in built:
        one = t.filter(F.col("total") <= CAP).select("tree", F.col("root").alias("digest"))
        found = one if found is None else found.unionByName(one)
    return found


def _descend(batches):
    """(tree, block, above) of the subtrees below a tier's subtrees."""
    for b in batches:
        for tree, block, n, height, nodes, above in zip(
                *(b.column(c).to_pylist() for c in ("tree", "block", "n", "height", "nodes", "above")), strict=True):
            sub, rest = Subtree(nodes, n, height), _read(above)
            for a in range(0, n, 256):
                many = range(a, min(n, a + 256))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(many), pa.string()), pa.array([block * CAP + i for i in many], pa.int64()),
                     pa.array([_write([*sub.path(i), *rest]) for i in many], pa.string())], ["tree", "block", "above"])


def siblings_above(built: list[DataFrame], entry: DataFrame) -> DataFrame:
    """(tree, block, above) of the lowest tier's subtrees; ``entry`` gives
    (tree, above) of whole trees."""
    entry = entry.withColumn("block", F.lit(0).cast("long"))
    above = None
    for t in reversed(built):
        whole = t.filter(F.col("total") <= CAP).select("tree", "block").join(entry, ["tree", "block"])
        above = whole if above is None else whole.unionByName(above)
        if t is not built[0]:
            above = stored(t.join(above, ["tree", "block"]).mapInArrow(
                _descend, "tree string, block long, above string"), "siblings")
    return above


class Manifest:
    """The stored trees over items (tree, digest, *order, *carried)."""

    def __init__(self, items: DataFrame, order: list[str]):
        self.items = stored(ranked(items, [*order, "digest"]), "leaves")
        self.built = tiers(self.items)
        self.subroots = stored(roots(self.built), "subroots")
        top = self.subroots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("name"), "digest")
        self.top_items = stored(ranked(top, ["name"]), "top-leaves")
        self.top = tiers(self.top_items)

    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return roots(self.top).select(F.hex("digest").alias("root")).select(F.lower("root").alias("root"))

    def verify(self, checked: str, carried: dict[str, str]) -> DataFrame:
        """Rows (*carried, leaf, subroot, root, proof_sha256, folded_root,
        verified): the siblings of every leaf, and the root that the digest in
        column ``checked`` (where null the leaf itself) folds to with them."""
        start = self.top_items.select("tree").distinct().withColumn("above", F.lit(""))
        crest = siblings_above(self.top, start)
        upper = _prove(self.top, self.top_items.withColumn("checked", F.lit(None).cast("binary")),
                       crest, {"name": "string"}, full=True)
        upper = stored(upper.select(F.col("name").alias("tree"), "path", F.col("leaf").alias("subroot"),
                                    F.col("folded_root").alias("root")), "upper-siblings")
        above = siblings_above(self.built, upper.select("tree", F.col("path").alias("above")))
        ends = upper.select("tree", "subroot", "root")
        return _prove(self.built, self.items.withColumn("checked", F.col(checked)),
                      above.join(ends, "tree"), carried, full=False)


def _prove(built: list[DataFrame], items: DataFrame, above: DataFrame, carried: dict[str, str], full: bool) -> DataFrame:
    """Siblings and folded root of every item; ``full`` also returns ``path``.
    Each subtree's row comes before its leaves' rows, in one sorted stream."""
    names = list(carried)
    marks = built[0].drop("root").join(above, ["tree", "block"]).withColumn("pos", F.lit(-1))
    if full:
        marks = marks.withColumn("subroot", F.lit("")).withColumn("root", F.lit(""))
    marks = marks.select("tree", "block", "pos", "n", "height", "nodes", "above", "subroot", "root")
    leaves = _blocked(items).select("tree", "block", "pos", "digest", "checked", *names)
    rows = _together(marks.unionByName(leaves, allowMissingColumns=True))

    def run(batches):
        sub, rest, tail, ends = None, [], "", ("", "")
        for b in batches:
            out = [[] for _ in range(7)]
            take = []
            cols = (b.column(c).to_pylist() for c in ("pos", "n", "height", "nodes", "above", "subroot", "root",
                                                      "digest", "checked"))
            for i, (pos, n, height, nodes, higher, subroot, root, digest, checked) in enumerate(zip(*cols, strict=True)):
                if pos < 0:
                    sub, rest = Subtree(nodes, n, height), _read(higher)
                    tail, ends = "".join(a + z for a, z in rest), (subroot, root)
                    continue
                path = sub.path(pos)
                proof = "".join(a + z for a, z in path) + tail
                folded = fold((checked or digest).hex(), [*path, *rest])
                take.append(i)
                for c, v in zip(out, (digest.hex(), *ends, hashlib.sha256(proof.encode()).hexdigest(), folded,
                                      folded == ends[1], _write([*path, *rest]) if full else None), strict=True):
                    c.append(v)
            if take:
                kept = [b.column(c).take(pa.array(take)) for c in names]
                kinds = [pa.string()] * 5 + [pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                    [*names, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path"])

    own = "".join(f"`{c}` {k}, " for c, k in carried.items())
    got = rows.mapInArrow(run, own + "leaf string, subroot string, root string, proof_sha256 string, "
                                     "folded_root string, verified boolean, path string")
    return got if full else got.drop("path")


# ---------------------------------------------------------------- documents
def group_key(c: Column) -> Column:
    """A text that orders like the group, null first, and is never null."""
    return F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c))


def document_items(documents: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered) of documents: ``tampered`` is the leaf
    with the text's A-Z lower-cased where 5 divides the id's crc32, else null."""
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = leaf_digest(*rest, F.translate("text", _UPPER, _UPPER.lower()))
    return documents.select(group_key(F.col("source")).alias("tree"), "doc_id",
                            leaf_digest(*rest, F.col("text")).alias("digest"), F.when(touched, changed).alias("tampered"))


_SQL = """
WITH RECURSIVE
d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, text,
             concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END,
                    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head
      FROM documents),
crc AS (SELECT doc_id, 1 AS pos, CAST(4294967295 AS BIGINT) AS c, 0 AS bit FROM (SELECT DISTINCT doc_id FROM d WHERE doc_id IS NOT NULL)
        UNION ALL
        SELECT doc_id, CASE WHEN bit = 8 THEN pos + 1 ELSE pos END,
               CASE WHEN bit = 0 THEN xor(c, CAST(ascii(substr(CAST(doc_id AS VARCHAR), pos, 1)) AS BIGINT))
                    ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) END,
               (bit + 1) % 9
        FROM crc WHERE pos <= strlen(CAST(doc_id AS VARCHAR))),
touched AS (SELECT doc_id FROM crc WHERE bit = 0 AND pos > strlen(CAST(doc_id AS VARCHAR))
            AND xor(c, CAST(4294967295 AS BIGINT)) % 5 = 0),
h AS (SELECT doc_id, tree, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
             CASE WHEN doc_id IN (SELECT doc_id FROM touched) AND text IS NOT NULL THEN
               sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
             END AS tampered FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                  row_number() OVER () AS rid FROM h),
nodes AS (SELECT tree, 0 AS lvl, i, leaf AS h FROM leaves
          UNION ALL
          SELECT tree, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i))
          FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS many FROM nodes) WHERE many > 1 GROUP BY tree, lvl, i // 16),
ends AS (SELECT tree, max(lvl) AS top, arg_max(h, lvl) AS subroot FROM nodes GROUP BY tree),
crown AS (SELECT 0 AS lvl, row_number() OVER (ORDER BY tree) - 1 AS i, subroot AS h FROM ends
          UNION ALL
          SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i))
          FROM (SELECT *, count(*) OVER () AS many FROM crown) WHERE many > 1 GROUP BY lvl, i // 16),
peak AS (SELECT max(lvl) AS high, arg_max(h, lvl) AS root FROM crown),
place AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS pos FROM ends),
sides AS (SELECT l.rid, n.lvl, string_agg(CASE WHEN n.i < l.i // (16 ** n.lvl)::BIGINT THEN n.h ELSE '' END, '' ORDER BY n.i) AS lft,
                 string_agg(CASE WHEN n.i > l.i // (16 ** n.lvl)::BIGINT THEN n.h ELSE '' END, '' ORDER BY n.i) AS rgt
          FROM leaves l JOIN ends e USING (tree)
          JOIN nodes n ON n.tree = l.tree AND n.lvl < e.top AND n.i // 16 = l.i // (16 ** (n.lvl + 1))::BIGINT
          GROUP BY l.rid, n.lvl
          UNION ALL
          SELECT l.rid, e.top + c.lvl, string_agg(CASE WHEN c.i < p.pos // (16 ** c.lvl)::BIGINT THEN c.h ELSE '' END, '' ORDER BY c.i),
                 string_agg(CASE WHEN c.i > p.pos // (16 ** c.lvl)::BIGINT THEN c.h ELSE '' END, '' ORDER BY c.i)
          FROM leaves l JOIN ends e USING (tree) JOIN place p USING (tree) CROSS JOIN peak
          JOIN crown c ON c.lvl < peak.high AND c.i // 16 = p.pos // (16 ** (c.lvl + 1))::BIGINT
          GROUP BY l.rid, e.top, c.lvl),
proofs AS (SELECT rid, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof FROM sides GROUP BY rid),
folds AS (SELECT rid, 0 AS lvl, coalesce(tampered, leaf) AS h FROM leaves
          UNION ALL
          SELECT f.rid, f.lvl + 1, sha256(s.lft || f.h || s.rgt) FROM folds f JOIN sides s ON s.rid = f.rid AND s.lvl = f.lvl),
folded AS (SELECT rid, arg_max(h, lvl) AS h FROM folds GROUP BY rid)
SELECT l.doc_id, l.leaf, e.subroot, peak.root, coalesce(p.proof, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = peak.root AS verified
FROM leaves l JOIN ends e USING (tree) CROSS JOIN peak JOIN folded f USING (rid) LEFT JOIN proofs p USING (rid)
"""


@register("op11_merkle_manifest", _SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots, proof and the root that its possibly
    tampered leaf folds to."""
    found = Manifest(document_items(read(spark, sf_dir, "documents")), ["doc_id"])
    return found.verify("tampered", {"doc_id": "bigint"})
