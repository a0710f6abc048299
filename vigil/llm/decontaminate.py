"""Benchmark decontamination: rare seeds, then Smith-Waterman.

Seeds are word pairs of the items (a word, if an item has but one). Their
document frequencies are counted over the whole corpus; an item's seeds are the
rarer half of its pairs and all pairs of at most ``RARE`` of the documents (or
``RARE_LEAST`` documents). A
copy with a word put in after every second one, or with a fifth of its words
edited, keeps many pairs, so a document and an item are aligned where several
seeds (1 to 3, by the item's length) meet on neighbouring diagonals. Each such
place opens a window of the document, a batch of windows is aligned at once,
and the best alignment per document and item is kept.

An alignment is a finding if it matches at least ``share`` of the item's words,
or a run of ``run`` words and more - a verbatim or lightly edited part of a
longer item - in which gaps and mismatches are at most two thirds of the
matches.

Items are handled in blocks of ``block`` rows against all documents; a block's
seeds are the only thing broadcast, so the broadcast is bounded whatever the
benchmark's size. No pairs are formed but by seeds.

Words are compared without ASCII case and punctuation. Defined cases: null or
empty documents and items match nothing; null ids are kept as they are;
repeated rows give repeated findings; very long items are aligned whole; other
input columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import arrow_map, only, read
from vigil.llm.registry import register
from vigil.llm.words import words_of

SEED_WORDS = 2
SHARE = 0.8
#: Words of a part of an item that count as copied.
RUN = 25
#: Share of the documents, or their number, up to which every pair is a seed.
RARE, RARE_LEAST = 0.002, 20
BLOCK = 10_000
_MATCH, _MISS, _GAP = 4, -3, -3
_UNIT = 1 << 20  # score and matched words share one integer


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    w = words_of(pa.array(texts, pa.large_string()), loose=True)
    return [w.hash[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]


def _gram(h: np.ndarray, n: int) -> np.ndarray:
    from vigil.llm.words import Words
    none = np.zeros(0, np.int64)
    return Words(none, none, none, none, h).grams(n)


def edits(m: int, share: float) -> int:
    return int(m * (1 - share) + 1e-9)


def choose_seeds(df: np.ndarray, limit: float) -> np.ndarray:
    """Positions of the seeds among an item's word pairs, by their frequency."""
    rank = np.argsort(np.argsort(df, kind="stable"), kind="stable")
    return np.flatnonzero((df <= limit) | (rank < (len(df) + 1) // 2))


def seeds_needed(m: int) -> int:
    """Seeds that must meet before a window of an item of m words is aligned."""
    return 1 if m < 12 else 2 if m < RUN + 5 else 3


class _Lookup:
    """Sorted keys behind a bitmap."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys >> np.uint64(44)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are keys, and the first key equal to each."""
        some = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        where = np.searchsorted(self.keys, h[some])
        where[where == len(self.keys)] = 0
        same = self.keys[where] == h[some] if len(self.keys) else np.zeros(0, bool)
        return some[same], where[same]


def _frequencies(docs: DataFrame, grams: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """Document frequency of the items' n-grams over all documents, by n."""
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def count(part):
        w = words_of(part.column("text"), loose=True)
        n, key, many = [], [], []
        for size, keys in sent.value.items():
            h = w.grams(size)
            at, which = _Lookup(keys).hits(h)
            ok = w.after(size)[at]
            seen = np.unique(np.stack([which[ok], w.doc[at[ok]]]), axis=1)[0]
            ids, c = np.unique(seen, return_counts=True)
            n += [size] * len(ids)
            key += ids.tolist()
            many += c.tolist()
        return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(key, pa.int64()),
                                           pa.array(many, pa.int64())], ["n", "gram", "df"])

    rows = (docs.select("text").mapInArrow(arrow_map(count), "n int, gram long, df long")
            .groupBy("n", "gram").agg(F.sum("df").alias("df")).collect())  # at most the block's n-grams
    out: dict[int, dict[int, int]] = {n: {} for n in grams}
    for r in rows:
        out[r.n][r.gram] = r.df
    return out


def align(item: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of each row of ``item`` (0 pads) with the same row of
    ``window``: best score, its matched words, and the window word it ends at."""
    rows, width = window.shape
    prev = np.zeros((rows, width + 1), np.int64)
    best = np.zeros(rows, np.int64)
    end = np.zeros(rows, np.int64)
    slope = -_GAP * _UNIT * np.arange(width + 1)
    for i in range(item.shape[1]):
        word = item[:, i:i + 1]
        same = (window == word) & (word != 0)
        now = np.zeros_like(prev)
        now[:, 1:] = prev[:, :-1] + np.where(same, _MATCH * _UNIT + 1, _MISS * _UNIT)
        now = np.maximum(now, prev + _GAP * _UNIT)
        now = np.maximum(now, 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps along the window
        now[(word == 0)[:, 0]] = 0
        j = now.argmax(1)
        top = now[np.arange(rows), j]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, j, end)
        prev = now
    return best // _UNIT, best % _UNIT, end


def _search(items: list[np.ndarray], seeds: dict[int, tuple], share: float, run_words: int):
    """Findings of a slice of documents against a block of items."""
    length = np.array([len(h) for h in items])
    edits_of = np.array([edits(len(h), share) for h in items])
    needed = np.array([seeds_needed(len(h)) for h in items])

    def run(part):
        w = words_of(part.column("text"), loose=True)
        doc, item, start, seed = [], [], [], []
        for n, (keys, owner, offset, lookup) in seeds.items():
            h = w.grams(n)
            at, which = lookup.hits(h)
            ok = w.after(n)[at]
            at, which = at[ok], which[ok]
            last = np.searchsorted(keys, keys[which], side="right") if len(which) else which
            many = last - which                                      # items that share the seed
            place = np.repeat(which - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            at = np.repeat(at, many)
            doc.append(w.doc[at])
            item.append(owner[place])
            start.append(at - offset[place])
            seed.append(offset[place])
        doc, item, start, seed = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, item, start, seed))
        if not len(doc):
            return None
        m = length[item]
        slack = edits_of[item] + 1
        order = np.lexsort((start, item, doc))
        doc, item, start, m, slack, seed = (x[order] for x in (doc, item, start, m, slack, seed))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > slack[1:])
        first = np.flatnonzero(new)
        place = np.cumsum(new) - 1
        # room for as many words put in as the item has before and after a seed
        lo, hi = np.minimum.reduceat(start - seed, first), np.maximum.reduceat(start + 2 * m - seed, first)
        distinct = np.unique(np.stack([place, seed]), axis=1)[0]  # different seeds that meet
        enough = np.bincount(distinct, minlength=len(first)) >= needed[item[first]]
        first, lo, hi = first[enough], lo[enough], hi[enough]
        if not len(first):
            return None
        doc, item, m = doc[first], item[first], m[first]
        lo, hi = np.maximum(lo, w.bounds[doc]), np.minimum(hi, w.bounds[doc + 1])
        score, matched, end = (np.zeros(len(doc), np.int64) for _ in range(3))
        order = np.argsort(hi - lo, kind="stable")
        begin = 0
        while begin < len(order):  # batches of bounded area
            wide = int((hi - lo)[order[begin:begin + 4096]].max())
            take = order[begin:begin + max(1, min(4096, (1 << 19) // max(1, wide)))]
            wide = int((hi - lo)[take].max())
            place = lo[take, None] + np.arange(wide)
            window = np.where(place < hi[take, None], w.hash[np.minimum(place, len(w.hash) - 1)], np.uint64(1))
            words = np.zeros((len(take), int(m[take].max())), np.uint64)
            for r, i in enumerate(item[take]):
                words[r, :len(items[i])] = items[i]
            score[take], matched[take], end[take] = align(words, window)
            begin += len(take)
        part_of = (matched >= run_words) & (score >= 2 * matched)
        good = np.flatnonzero((matched >= share * m - 1e-9) | part_of)
        if not len(good):
            return None
        order = good[np.lexsort((lo[good], -matched[good], -score[good], item[good], doc[good]))]
        one = np.ones(len(order), bool)
        one[1:] = (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1])
        g = order[one]
        return pa.RecordBatch.from_arrays(
            [part.column("id").take(pa.array(doc[g])), pa.array(item[g], pa.int64()),
             pa.array(score[g] / (_MATCH * m[g])), pa.array(matched[g] / m[g]),
             pa.array(lo[g] + end[g] - w.bounds[doc[g]])], ["id", "item", "score", "share", "end"])

    return run


def find_copies(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = BLOCK,
                key: str = "doc_id", item_key: str = "item_id", run: int = RUN) -> DataFrame:
    """(key, item_key, score, share, end_word): the best alignment of each
    benchmark item with each document that has at least ``share`` of it, or
    ``run`` words of it in one passage."""
    spark = docs.sparkSession
    src = only(docs, id=key, text="text")
    items = only(benchmark, item=item_key, text="text")
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((src, "id"), (items, "item")))
    blocks = max(1, -(-items.count() // block))
    limit = max(RARE_LEAST, RARE * src.count())
    out = None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        rows = [(r.item, h) for r, h in zip(rows, item_words([r.text for r in rows]), strict=True) if len(h)]
        if not rows:
            continue
        hashes = [h for _, h in rows]
        size = [min(SEED_WORDS, len(h)) for h in hashes]
        each = [_gram(h, n) for h, n in zip(hashes, size, strict=True)]
        grams = {n: np.unique(np.concatenate([g for g, k in zip(each, size, strict=True) if k == n]))
                 for n in set(size)}
        df = _frequencies(src, grams)
        found: dict[int, list] = {n: [] for n in grams}
        for i, (g, n) in enumerate(zip(each, size, strict=True)):
            often = np.array([df[n].get(int(x), 0) for x in np.searchsorted(grams[n], g)])
            found[n] += [(int(g[p]), i, int(p)) for p in choose_seeds(often, limit)]
        seeds = {}
        for n, f in found.items():
            f.sort()
            keys = np.array([x for x, *_ in f], np.uint64)
            seeds[n] = (keys, np.array([x[1] for x in f]), np.array([x[2] for x in f]), _Lookup(keys))
        hits = src.mapInArrow(arrow_map(_search(hashes, seeds, share, run)),
                              f"id {kind}, item long, score double, share double, end long")
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item long, name {item_kind}")
        hits = hits.join(F.broadcast(names), "item").select(
            F.col("id").alias(key), F.col("name").alias(item_key), "score", "share", F.col("end").alias("end_word"))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], f"`{key}` {kind}, `{item_key}` {item_kind}, "
                                        "score double, share double, end_word long")
    return out


def without_copies(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows, all columns as they are, in which no item is found. A row is
    known by its id and the hash of its text, so that clashing ids stay apart."""
    known = docs.select(F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    hits = find_copies(known, benchmark, share).select(
        F.col("doc_id.i").alias("_id"), F.col("doc_id.h").alias("_hash")).distinct()
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["_id"]) & (F.xxhash64(docs["text"]) == hits["_hash"]),
                     "left_anti")


@register("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in any document, with their alignment scores."""
    return find_copies(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
