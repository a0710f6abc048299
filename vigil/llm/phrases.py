"""Phrase collocations by top-order marginalisation.

Every word starts one window of up to ``MAX_WORDS`` words of its piece. Only
these longest windows are counted, as lead columns w1 to w4, padded where the
window is shorter; ``ROLLUP (lang, w1, w2, w3, w4)`` then sums them to the
counts of every shorter phrase and, over a language, of all words. There is no
explosion into n-grams of each length.

Before that, windows are cut where they can't matter: what a phrase as frequent
as ``least`` begins with is as frequent, so a window ends before its prefix gets
rarer, and a rare word leaves an empty window, which counts as a word only.
Words and bigrams are counted by 42-bit hashes in partial sums, then phrases of
three and four words whose bigrams are frequent; the frequent ones are marked in
two bitmaps of fixed size (32 MB each, broadcast). Phrases that share a bit are
cut less, never more, so all counts that reach ``least`` are exact.

Candidates, their parts and the phrases that hold them all reach ``least``, so
what follows works on that table: each cut is joined with its parts' counts,
each longer candidate with the candidates inside it. The first ``top`` of a
language are taken per salted part, then of those.

Defined cases: null text has no words, a null language is ``und``; a phrase
lies in one piece; ties of cuts go to the earlier cut, ties of ranks to the
higher count, then the smaller phrase by bytes; repeated rows count each time;
empty tables and languages without candidates have no rows; other columns stay
out. Scores are computed in decimals of 38 digits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import arrow_map, only, read, shuffle_width, stored, text_slices
from vigil.llm.registry import register
from vigil.llm.words import mix, words_of

MAX_WORDS = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
#: A longer candidate with this share (per cent) of a count makes it redundant.
INSIDE_PERCENT = 80
_PART_BITS = 10
_BIT_BITS = 18           # bits of the bitmap within a part
_COLUMNS = [f"w{k + 1}" for k in range(MAX_WORDS)]
_SALTS = 64
_BLOCK_WORDS = 1 << 20

_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[9] = 0x20
_MAP[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 10


class Pieces:
    """Words of a slice of documents, joined by single bytes: a blank within a
    piece, a line feed where a piece ends."""

    def __init__(self, part: pa.RecordBatch):
        text = part.column("text").fill_null("")
        size = len(text)
        _, offsets, data = text.buffers()
        wide = pa.types.is_large_string(text.type)
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset:text.offset + size + 1]
        raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
        plain = pa.Array.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(
            np.ascontiguousarray(off - off[0], np.int64)), pa.py_buffer(_MAP[raw])])
        w = words_of(plain)
        breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
        m = len(w.start)
        self.doc = w.doc
        # does the next word follow in the same piece?
        self.follows = np.zeros(m, bool)
        if m > 1:
            self.follows[:-1] = (self.doc[1:] == self.doc[:-1]) & (breaks[w.start[1:]] == breaks[w.end[:-1]])
        self.words, self.hash = w, w.hash

    def grams(self, langs: np.ndarray, most: int) -> list[np.ndarray]:
        """Hashes of the 1 to ``most`` words from each word on; what runs over
        a piece's end is of no use."""
        out = [mix(self.hash ^ langs[self.doc])]
        for k in range(1, most):
            h = out[-1].copy()
            if len(h) > k:
                h[:-k] = mix(h[:-k] * np.uint64(0xD6E8FEB86659FD93) + self.hash[k:])
            out.append(h)
        return out

    def runs(self, joined: np.ndarray, words: int) -> np.ndarray:
        """Where ``words`` words follow each other, each pair of them ``joined``."""
        out = joined.copy()
        for k in range(1, words - 1):
            out[:-k] &= joined[k:]
            out[len(out) - k:] = False
        return out

    def windows(self, length: np.ndarray) -> pa.Array:
        """The ``length`` words from each word on, joined by a blank; none is
        the empty text."""
        w = self.words
        solid = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(solid, w.start, 1)
        np.add.at(solid, w.end, -1)
        keep = np.cumsum(solid[:-1]) > 0
        keep[w.end[w.end < len(keep)]] = True  # the byte after a word
        data = np.where(w.data == 10, 0x20, w.data).astype(np.uint8)[keep]
        place = np.cumsum(keep) - 1
        start, end = place[w.start], place[w.end - 1] + 1
        n = np.where(length > 0, end[np.arange(len(start)) + np.maximum(length, 1) - 1] - start, 0)
        off = np.concatenate([[0], np.cumsum(n)])
        chars = data[np.repeat(start - off[:-1], n) + np.arange(off[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(chars)])


def _lang_hash(langs: list[str]) -> np.ndarray:
    return mix(np.array([zlib.crc32(x.encode()) + 1 for x in langs], np.uint64))


def _blocks(hashes: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct 42-bit hashes by part, with counts up to 255."""
    h, n = np.unique(np.concatenate(hashes) >> np.uint64(64 - _PART_BITS - 32), return_counts=True)
    part = (h >> np.uint64(32)).astype(np.int64)
    rest, n = h.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
    parts, first = np.unique(part, return_index=True)
    last = [*first[1:], len(h)]
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array([rest[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
         pa.array([n[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())], ["part", "rest", "n"])


def _set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set."""
    at = h >> np.uint64(64 - _PART_BITS - _BIT_BITS)
    return ((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


def _words_and_pairs(p: Pieces, langs: np.ndarray) -> list[np.ndarray]:
    one, two = p.grams(langs, 2)
    return [one, two[p.follows]]


def _longer(pairs):
    """Phrases of three words and more, all of whose bigrams are frequent."""
    def hashes(p: Pieces, langs: np.ndarray) -> list[np.ndarray]:
        h = p.grams(langs, MAX_WORDS)
        joined = p.follows & _set(pairs.value, h[1])
        return [h[k - 1][p.runs(joined, k)] for k in range(3, MAX_WORDS + 1)]
    return hashes


def frequent(docs: DataFrame, least: int, hashes) -> np.ndarray:
    """Bitmap over 28 bits of the hashes that ``hashes`` gives for a slice, set
    where 42 bits of one occur ``least`` times (at most 255)."""
    def count(batches):
        held, many = [], 0
        for batch in batches:
            for part in text_slices(batch):
                p = Pieces(part)
                if len(p.doc):
                    found = hashes(p, _lang_hash(part.column("lang").to_pylist()))
                    held += [h for h in found if len(h)]
                    many += sum(map(len, found))
                if many > _BLOCK_WORDS:
                    yield _blocks(held)
                    held, many = [], 0
        if held:
            yield _blocks(held)

    def add(batches):
        last, rest, n = None, [], []

        def done():
            r, c = np.frombuffer(b"".join(rest), np.uint32), np.frombuffer(b"".join(n), np.uint8)
            order = np.argsort(r, kind="stable")
            r, c = r[order], c[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            often = r[first][np.add.reduceat(c, first) >= least] >> np.uint32(32 - _BIT_BITS)
            bits = np.zeros(1 << _BIT_BITS, np.uint8)
            bits[often] = 1
            return pa.RecordBatch.from_arrays(
                [pa.array([last], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())],
                ["part", "bits"])

        for b in batches:
            for part, r, c in zip(*(b.column(k).to_pylist() for k in ("part", "rest", "n")), strict=True):
                if part != last and last is not None:
                    yield done()
                    rest, n = [], []
                last = part
                rest.append(r)
                n.append(c)
        if last is not None:
            yield done()

    found = (docs.mapInArrow(count, "part int, rest binary, n binary")
             .repartition(shuffle_width(docs.sparkSession), "part").sortWithinPartitions("part")
             .mapInArrow(add, "part int, bits binary"))
    bitmap = np.zeros((1 << _PART_BITS, 1 << (_BIT_BITS - 3)), np.uint8)
    for r in found.collect():  # at most 32 MB, whatever the input
        bitmap[r.part] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return bitmap.ravel()


def counted_windows(docs: DataFrame, least: int) -> DataFrame:
    """(lang, w1 to w4, n): the longest windows that can matter, counted."""
    spark = docs.sparkSession
    # hashes are counted up to 255: below that every rarer phrase is cut
    some = min(least, 255)
    pairs = spark.sparkContext.broadcast(frequent(docs, some, _words_and_pairs))
    longer = spark.sparkContext.broadcast(frequent(docs, some, _longer(pairs)))

    def cut(part):
        p = Pieces(part)
        if not len(p.doc):
            return None
        langs = part.column("lang")
        h = p.grams(_lang_hash(langs.to_pylist()), MAX_WORDS)
        joined = p.follows & _set(pairs.value, h[1])
        length, go_on = _set(pairs.value, h[0]).astype(np.int64), joined
        for k in range(2, MAX_WORDS + 1):
            if k > 2:
                go_on = go_on & p.runs(joined, k) & _set(longer.value, h[k - 1])
            length += go_on & (length == k - 1)
        return pa.RecordBatch.from_arrays([langs.take(pa.array(p.doc)), p.windows(length)], ["lang", "window"])

    cuts = docs.mapInArrow(arrow_map(cut), "lang string, window string")
    words = F.split("window", " ")
    return (cuts.groupBy("lang", "window").agg(F.count("*").alias("n"))
            .select("lang", *(F.coalesce(F.get(words, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(_COLUMNS)), "n"))


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, words, phrase, f) of the phrases that occur ``least`` times; with
    ``words`` 0 and no phrase, a language's number of words."""
    rolled = (counted_windows(docs, least).rollup("lang", *_COLUMNS)
              .agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled")))
    # rolled-up columns are null; a padded one is a shorter window, not a phrase
    level = F.lit(None).cast("int")
    for k in range(MAX_WORDS + 1):
        real = F.col(_COLUMNS[k - 1]) != "" if k else F.lit(True)
        level = F.when((F.col("rolled") == (1 << (MAX_WORDS - k)) - 1) & real, F.lit(k)).otherwise(level)
    return (rolled.withColumn("words", level).filter("words = 0 or (words > 0 and f >= %d)" % least)
            .select("lang", "words", F.concat_ws(" ", *_COLUMNS).alias("phrase"), "f"))


def _part(first: Column, many: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, many), " ")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases."""
    docs = only(documents, text=text, lang=lang).withColumn("lang", F.coalesce("lang", F.lit("und")))
    table = stored(phrase_counts(docs, least), "phrases")
    f = table.filter("words > 0").select("lang", "phrase", "f")
    candidates = table.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = (candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"),
                    _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
            .join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    score = F.expr(f"cast(a as decimal(20,0)) * cast({SCALE} as decimal(7,0)) div "
                   "(cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
            .select("lang", "phrase", "a", "c.score", "c.l", "c.r"))
    # the contiguous shorter phrases of two words or more inside a candidate
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda at: _part(at, m))))
    held = (candidates.filter("words > 2").select("lang", "a", F.explode(inner).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    open_ = (best.join(held, ["lang", "phrase"], "left")
             .filter(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {INSIDE_PERCENT}"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).orderBy(*order)
    few = open_.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    ranked = (few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
              .filter(F.col("rank") <= top))
    total = table.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
w AS (SELECT pid, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM p),
g AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
      FROM w WINDOW o AS (PARTITION BY pid ORDER BY pos)),
f AS MATERIALIZED (SELECT lang, 1 AS m, w AS phrase, count(*) AS f FROM g GROUP BY ALL UNION ALL
      SELECT lang, 2, w || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL UNION ALL
      SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL UNION ALL
      SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 30),
u AS (SELECT lang, phrase, a, ws, unnest(range(1, m)) AS k FROM c),
k AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM u),
e AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 30),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r,
             CAST((CAST(2000000 AS HUGEINT) * k.a) // (x.f + y.f) AS BIGINT) AS score
      FROM k JOIN e x ON x.lang = k.lang AND x.phrase = k.head JOIN e y ON y.lang = k.lang AND y.phrase = k.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE m = 3 UNION ALL
        SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' '), array_to_string(ws[3:4], ' '),
                                array_to_string(ws[1:3], ' '), array_to_string(ws[2:4], ' ')]) FROM c WHERE m = 4) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT t.lang, t.rank, t.phrase, t.a, t.l, t.r, CAST(n.n AS BIGINT) AS n, t.score FROM t JOIN n USING (lang) WHERE t.rank <= 2000
"""


@register("op12_collocations", _SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two to four words."""
    return collocations(read(spark, sf_dir, "documents"))
