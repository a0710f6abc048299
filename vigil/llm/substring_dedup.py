"""Repeated windows of words, found with a compressed FM-index per shard.

A window is ``width`` consecutive words of one document; every word covered by
a window whose words also start anywhere else goes.

Equal windows must meet in one shard without sending every document to every
index. Each window is keyed by the smallest hash of its short word grams, so
equal windows have equal keys, and consecutive windows with one key form a
passage (its windows' words, split after ``RUN`` windows). Then

1. keys are counted over all documents (map-side combined); a key that one
   window alone has needs nothing more;
2. passages of the other keys are reduced to distinct texts with counts;
   a text that occurs twice has only repeated windows;
3. the distinct passages of a key go to one shard (a run of keys of about
   ``SHARD_WORDS`` words). The shard builds one FM-index over them and streams
   them through it backwards: a window whose matching statistic reaches
   ``width`` occurs twice;
4. the words' intervals go back to every occurrence of a passage by an
   equi-join, and each document drops its covered words.

A key with more than ``hot`` distinct passages (a very common passage amid
different text) is never gathered: its windows are counted by 128-bit digests
with map-side combining instead, the same decision at any size.

Defined cases: null or empty text has no words; texts shorter than ``width``
words keep all; repeated rows are occurrences of their own, so all their
windows repeat; rows with equal or null ids are kept apart by their texts (see
``with_identity``); other input columns stay out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import arrow_map, only, read, shuffle_width, stored
from vigil.llm.fm_index import FMIndex
from vigil.llm.registry import register
from vigil.llm.words import sliding_min, words_of

WIDTH = 35
GRAM = 8
RUN = 48
SHARD_WORDS = 1 << 20
HOT = 4096


def _runs(w, width: int):
    """Passages of a slice: document, key, first and last window (word index),
    occurrences of the key's gram."""
    gram = min(GRAM, width)
    ok = w.after(width)
    if not ok.any():
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, none
    grams = w.grams(gram)
    low = sliding_min(grams, width - gram + 1)
    at = np.flatnonzero(ok)
    key, doc = low[at], w.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    new |= since % RUN == 0
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(at)) - 1
    doc, key, first, last = doc[first], key[first], at[first], at[stop]
    return doc, key, first, last, _times(grams, key, first, last + width - gram)


def _times(grams, key, first, last) -> np.ndarray:
    """How often a passage has the gram of its key (from twice on it could
    hold two equal windows)."""
    n = last - first + 1
    start = np.cumsum(n) - n
    place = np.repeat(first - start, n) + np.arange(int(n.sum()))
    return np.add.reduceat(grams[place] == np.repeat(key, n), start)


def _digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def keys_of(docs: DataFrame, width: int) -> DataFrame:
    """(id, key, first, windows, times, digest) of every passage; the digest is
    of its bytes as they stand."""
    def run(part):
        w = words_of(part.column("text"))
        doc, key, first, last, times = _runs(w, width)
        data = w.data.tobytes()
        digest = [_digest(data[a:b]) for a, b in zip(w.start[first].tolist(), w.end[last + width - 1].tolist(),
                                                     strict=True)]
        return pa.RecordBatch.from_arrays(
            [part.column("id").take(pa.array(doc)), _signed(key), pa.array(first - w.bounds[doc], pa.int32()),
             pa.array((last - first + 1).astype(np.int32)), pa.array(times.astype(np.int32)),
             pa.array(digest, pa.binary())], ["id", "key", "first", "windows", "times", "digest"])

    return docs.select("id", "text").mapInArrow(
        arrow_map(run), f"id {_kind(docs)}, key long, first int, windows int, times int, digest binary")


def _kind(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def with_identity(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, id, text): ``id`` is the key where keys are unique and present,
    else key and text hash together, which only exact repeats of a row share
    (they are the same text, so they may share their intervals)."""
    src = only(docs, doc_id=key, text="text")
    clash = src.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    whole = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                        F.hex(F.xxhash64("text")))
    return src.select("doc_id", (whole if clash else F.col("doc_id")).alias("id"), "text")


def _passages(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(key, digest, count, text) of the distinct passages, cut from the
    document that each is taken from."""
    spots = reps.groupBy("id").agg(F.collect_list(F.struct("key", "digest", "count", "first", "windows"))
                                   .alias("spots"))

    def run(part):
        w = words_of(part.column("text"))
        data = w.data.tobytes()
        spots = part.column("spots")
        flat, bound = spots.values, spots.offsets.to_numpy()
        kept = slice(int(bound[0]), int(bound[-1]))
        first, windows = (flat.field(k).to_numpy(zero_copy_only=False)[kept] for k in ("first", "windows"))
        a = np.repeat(w.bounds[:-1], np.diff(bound)) + first
        text = [data[i:j] for i, j in zip(w.start[a].tolist(), w.end[a + windows + width - 2].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [flat.field("key")[kept], flat.field("digest")[kept], flat.field("count")[kept],
             pa.array(text, pa.binary())], ["key", "digest", "count", "text"])

    return (docs.select("id", "text").join(spots, "id").select("text", "spots")
            .mapInArrow(arrow_map(run), "key long, digest binary, count long, text binary"))


def _index_shards(width: int):
    """Search shards of whole keys; input sorted by key within the partition."""
    def shard(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        alone = Counter(r[0] for r in rows)
        for k, d, _, t in (r for r in rows if alone[r[0]] == 1 and r[2] > 1):
            out.append((k, d, 0, len(t.split())))
        rows = [r for r in rows if alone[r[0]] > 1 or r[2] == 1]
        if rows:
            out += search(rows)
        if not out:
            return None
        k, d, a, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(d, pa.binary()),
                                           pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                                          ["key", "digest", "lo", "hi"])

    def search(rows: list[tuple]) -> list[tuple]:
        key, digest, count, text = zip(*rows, strict=True)
        w = words_of(pa.array(text, pa.large_binary()))
        size = np.diff(w.bounds)
        code = np.unique(w.hash, return_inverse=True)[1]
        ends = np.cumsum(size) + np.arange(len(size))           # a separator after every passage
        s = np.zeros(int(size.sum()) + len(size), np.int64)
        body = np.ones(len(s), bool)
        body[ends] = False
        s[body] = code + 1
        s[ends] = 0
        index = FMIndex(s, width)
        begin = ends - size
        windows = size - width + 1
        once = np.flatnonzero(np.array(count) == 1)
        last = np.concatenate([np.arange(begin[i] + width - 1, ends[i]) for i in once]) if len(once) \
            else np.zeros(0, np.int64)
        repeated = index.statistics(s, last, width) == width
        bound = np.cumsum(windows[once]) - windows[once]
        out = []
        at = dict(zip(once.tolist(), bound.tolist(), strict=True))
        for i in range(len(size)):
            flags = np.ones(windows[i], bool) if i not in at else repeated[at[i]:at[i] + windows[i]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                out.append((key[i], digest[i], a, b + width - 1))
        return out

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        words = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "count", "text")), strict=True):
                if words >= SHARD_WORDS and r[0] != rows[-1][0]:
                    if (out := shard(rows)) is not None:
                        yield out
                    rows, words = [], 0
                rows.append(r)
                words += r[3].count(b" ") + 1
        if rows and (out := shard(rows)) is not None:
            yield out

    return run


def _hot_windows(passages: DataFrame, width: int) -> DataFrame:
    """Intervals of a hot key's passages, by counting window digests."""
    def spread(part):
        rows = []
        for key, digest, count, text in zip(*(part.column(c).to_pylist() for c in
                                              ("key", "digest", "count", "text")), strict=True):
            words = text.split()
            for i in range(len(words) - width + 1):
                rows.append((key, digest, i, _digest(b" ".join(words[i:i + width])), count))
        k, d, i, w, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int64()), pa.array(d, pa.binary()), pa.array(i, pa.int32()),
             pa.array(w, pa.binary()), pa.array(c, pa.int64())], ["key", "digest", "lo", "window", "count"])

    each = passages.mapInArrow(arrow_map(spread, limit=1 << 16),
                               "key long, digest binary, lo int, window binary, count long")
    often = each.groupBy("window").agg(F.sum("count").alias("n")).filter("n > 1").select("window")
    return each.join(often, "window").select("key", "digest", "lo", (F.col("lo") + F.lit(width)).alias("hi"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """(id, lo, hi): word intervals of a document covered by repeated windows;
    ``docs`` as from ``with_identity``. One plan: the shuffles of the texts by
    id and of the passages are written once and read by each use."""
    keys = keys_of(docs, width)
    often = keys.groupBy("key").agg(F.sum("times").alias("n")).filter("n > 1").select("key")
    wanted = stored(keys.join(often, "key").drop("times"), "dedup-passages")
    reps = (wanted.groupBy("key", "digest")
            .agg(F.count("*").alias("count"), F.min(F.struct("id", "first", "windows")).alias("at"))
            .select("key", "digest", "count", "at.*"))
    hot_keys = (reps.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"))
    shards = shuffle_width(docs.sparkSession)
    warm = _passages(docs, reps.join(hot_keys, "key", "left_anti"), width)
    found = (warm.repartition(shards, "key").sortWithinPartitions("key")
             .mapInArrow(_index_shards(width), "key long, digest binary, lo int, hi int"))
    found = found.unionByName(_hot_windows(_passages(docs, reps.join(hot_keys, "key", "left_semi"), width), width))
    return (wanted.join(found, ["key", "digest"])
            .select("id", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi")))


def remove_repeats(docs: DataFrame, width: int = WIDTH, hot: int = HOT, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept) of every document; ``kept`` is the text
    that is left, its words joined by one space."""
    rows = with_identity(docs, key)
    spans = (repeated_spans(rows, width, hot).groupBy("id")
             .agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(part):
        n, removed, kept = [], [], []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
            words = (text or "").encode().split()
            n.append(len(words))
            if spans:
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, [s["lo"] for s in spans], 1)
                np.add.at(gone, [s["hi"] for s in spans], -1)
                stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
                words = [words[i] for i in stay]
            removed.append(n[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return (rows.join(spans, "id", "left").select("doc_id", "text", "spans")
            .mapInArrow(arrow_map(cut), f"doc_id {kind}, n_words long, n_removed long, kept string")
            .withColumnRenamed("doc_id", key))


@register("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated 35-word windows."""
    return (remove_repeats(read(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")))
