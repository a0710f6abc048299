"""Exact n-gram Jaccard join in a metric space.

The Jaccard distance of shingle sets is a metric, so pivots and the triangle
inequality bound where a document's partners (distance at most ``tau``) can be.

1. Every document becomes its set of 64-bit shingle hashes; equal sets form a
   class, and all further work is on one document per class.
2. First pivots are single shingles. A set is as near to a pivot as it can be
   if it has the shingle; ties go to the rarer one. A document's region is its
   first pivot in that order, and the boundary window replicates it to its
   first n - ceil((1 - tau) n) + 1 pivots: two sets within ``tau`` share one of
   these. Any order gives exact results; "rarer" is judged by a fixed-size
   count sketch over all documents, so that common passages attract nobody.
3. Within a region, cut where its sizes leave a gap that no link can cross,
   members whose parity sketches (a lower bound of the distance) don't rule a
   link out are joined by candidate edges, as many as members. Components of
   the edges (large-star / small-star joins) are the groups.
4. Within a group pivots are documents: members go to their nearest pivot's
   Voronoi region and, by the triangle inequality, to each region whose pivot
   is within the nearest distance + 2 tau; those that share nothing with any
   pivot form a region of the far. Regions split recursively until small or no
   longer shrinking; a leaf grows exact components by comparing each reached
   member with the members not yet reached, through an inverted index. Groups
   beyond ``max_group`` shingles are split by pivots in Spark first, in salted
   parts and as often as a split makes them smaller; what no split divides is
   solved by comparing hubs with salted parts. No task takes more than
   ``max_group`` shingles, single documents beyond it excepted.

No pairs are listed, and copies never leave their class. The result is one row
per document with its component.

Defined cases: null or empty text, or text without words, has no shingles and
links with nothing; a text of fewer than ``n`` words is one shingle; repeated
rows and copies share a class; rows are known by id and text hash, so rows that
share an id but not a text are linked each by its own text; a null id cannot
name a component, so such rows get the smallest id of their component, else
null; other input columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import arrow_map, only, read, shuffle_width, stored, text_slices
from vigil.llm.graph import components
from vigil.llm.registry import register
from vigil.llm.words import mix, words_of

SHINGLE = 4
PERCENT = 85
SKETCH_BITS = 22
#: Shingles of a group up to which one task takes it whole.
MAX_GROUP = 1 << 21
#: Rows of a region up to which its members are compared by parity sketches.
MAX_REGION = 20_000
_BLOCK_BITS = 14


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for part in text_slices(pa.RecordBatch.from_arrays([texts], ["text"])):
        out += _sets(words_of(part.column("text"), lower=True), n)
    return out


def _sets(w, n: int) -> list[np.ndarray]:
    grams = w.grams(n)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            whole = xxhash.xxh3_64_intdigest(w.text(a, b - 1), b - a)
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _narrow(counts: np.ndarray) -> bytes:
    """Counters in as few bytes each as their largest needs (up to 4)."""
    top = min(int(counts.max()), 0xFFFFFFFF)
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    return np.minimum(counts, top).astype(kind).tobytes()


def _counters(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) >> _BLOCK_BITS])


def rarity_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Counts of shingles by the top bits of their hash, over all documents:
    2^22 counters whatever the input's size."""
    blocks = 1 << (SKETCH_BITS - _BLOCK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                w = words_of(part.column("text"), lower=True)
                grams = w.grams(n)[w.after(n)[:max(0, len(w.start) - n + 1)]]
                np.add.at(total, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        if total.any():
            parts = [_narrow(p) for p in total.reshape(blocks, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(blocks, dtype=np.int32)), pa.array(parts, pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums.setdefault(k, np.zeros(1 << _BLOCK_BITS, np.int64))
                sums[k] += _counters(c)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([_narrow(s) for s in sums.values()], pa.binary())],
                ["block", "counts"])

    schema = "block int, counts binary"
    each = docs.select("text").mapInArrow(count, schema)
    summed = each.repartition(min(blocks, shuffle_width(docs.sparkSession)), "block").mapInArrow(add, schema)
    total = np.zeros((blocks, 1 << _BLOCK_BITS), np.uint32)
    for r in summed.collect():  # 2^22 counters, whatever the input; a block is one row
        total[r.block] = _counters(r.counts)
    return total.ravel()


def parity(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 2^k >= n hash buckets. Two
    sets differ in at least as many shingles as their parities differ in."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, h, n_shingles, class, window, parity): the row's text hash, the
    set's hash, first pivots and parities."""
    sent = docs.sparkSession.sparkContext.broadcast(rarity_sketch(docs, n))
    kind = docs.schema["id"].dataType.simpleString()

    def run(part):
        sketch = sent.value
        size, name, window, odd = [], [], [], []
        for s in shingle_sets(part.column("text"), n):
            size.append(len(s))
            if not len(s):
                name.append(None)
                window.append(None)
                odd.append(None)
                continue
            name.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
            keep = len(s) - (percent * len(s) + 99) // 100 + 1
            rare = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            window.append(s[np.lexsort((mix(s), rare))[:keep]].view(np.int64))
            odd.append(parity(s))
        return pa.RecordBatch.from_arrays(
            [part.column("id"), part.column("h"), pa.array(size, pa.int64()), pa.array(name, pa.int64()),
             pa.array(window, pa.list_(pa.int64())), pa.array(odd, pa.binary())],
            ["id", "h", "n_shingles", "class", "window", "parity"])

    return docs.select("id", "h", "text").mapInArrow(
        arrow_map(run), f"id {kind}, h long, n_shingles long, class long, window array<long>, parity binary")


def _near(percent: int, max_region: int):
    """Edges (class, root) among each region's members whose parities don't
    rule a link out; rows sorted by region."""
    def close(members: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
        free = list(range(1, len(members)))
        todo, root = [0], members[0][2]
        while True:
            while todo and free:
                n, width, _, bits = members[todo.pop()]
                stay = []
                for k in free:
                    m, other_width, name, other = members[k]
                    a, b = _fold(bits, width, other_width), _fold(other, other_width, width)
                    if (100 + percent) * (a ^ b).bit_count() <= (100 - percent) * (n + m):
                        todo.append(k)
                        yield name, root
                    else:
                        stay.append(k)
                free = stay
            if not free:
                return
            first = free.pop(0)
            todo, root = [first], members[first][2]

    def run(batches):
        last, members, edges, large = None, [], [], False

        def out():
            a, b = zip(*edges, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for p, r, c, n, bits in zip(*(batch.column(k).to_pylist() for k in
                                          ("pivot", "run", "class", "n_shingles", "parity")), strict=True):
                if (p, r) != last:
                    edges.extend(close(members) if len(members) > 1 else ())
                    last, members, large = (p, r), [], False
                    if len(edges) > 10_000:
                        yield out()
                        edges.clear()
                if large:
                    edges.append((c, members[0][2]))
                    continue
                members.append((n, len(bits) * 8, c, int.from_bytes(bits, "little")))
                if len(members) > max_region:  # compared later: all go with the first
                    edges.extend((m[2], members[0][2]) for m in members[1:])
                    members, large = members[:1], True
        edges.extend(close(members) if len(members) > 1 else ())
        if edges:
            yield out()

    return run


def _fold(bits: int, width: int, to: int) -> int:
    """Parities over half as many buckets, until ``to``."""
    while width > to:
        width //= 2
        bits = (bits ^ (bits >> width)) & ((1 << width) - 1)
    return bits


class Group:
    """Shingle sets of one group with an inverted index over shared shingles."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.tau = 1 - percent / 100
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
        shared = df[code] > 1
        dense = np.cumsum(df > 1) - 1
        code, owner = dense[code[shared]], owner[shared]
        order = np.argsort(code, kind="stable")
        self.posting = owner[order]
        df = df[df > 1]
        self.at = np.cumsum(df) - df
        self.df = df
        self.codes = code
        self.bound = np.searchsorted(owner, np.arange(len(sets) + 1))

    def common(self, x: int) -> np.ndarray:
        """Shared shingles of member x with each member."""
        c = self.codes[self.bound[x]:self.bound[x + 1]]
        n = self.df[c]
        first = np.cumsum(n) - n
        place = np.repeat(self.at[c] - first, n) + np.arange(int(n.sum()))
        got = np.bincount(self.posting[place], minlength=len(self.size))
        got[x] = self.size[x]
        return got

    def linked(self, x: int) -> np.ndarray:
        both = self.common(x)
        return 100 * both >= self.percent * (self.size + self.size[x] - both)

    def distance(self, x: int) -> np.ndarray:
        both = self.common(x)
        return 1 - both / np.maximum(1, self.size + self.size[x] - both)

    def grow(self, members: np.ndarray, label: np.ndarray) -> None:
        """Exact components of the members by growing one at a time; labels
        are merged by ``_union``."""
        free = np.zeros(len(self.size), bool)
        free[members] = True
        for seed in members.tolist():
            if not free[seed]:
                continue
            free[seed] = False
            todo = [seed]
            while todo and free.any():
                x = todo.pop()
                new = np.flatnonzero(self.linked(x) & free)
                free[new] = False
                for y in new.tolist():
                    _union(label, x, y)
                todo.extend(new.tolist())

    def join(self, members: np.ndarray, label: np.ndarray, leaf: int = 256, pivots: int = 8) -> None:
        """Voronoi regions with triangle-inequality windows, recursively."""
        if len(members) <= leaf:
            return self.grow(members, label)
        dist, far = [], np.full(len(members), np.inf)
        p = int(members[0])
        for _ in range(pivots):  # farthest first
            d = self.distance(p)[members]
            dist.append(d)
            far = np.minimum(far, d)
            p = int(members[int(far.argmax())])
        dist = np.array(dist)
        least = dist.min(0)
        inside = (dist <= least + 2 * self.tau + 1e-9) & (dist < 1)
        inside = np.vstack([inside, least >= 1 - self.tau - 1e-9])  # and the far
        if inside.sum(1).max() > .7 * len(members):
            return self.grow(members, label)
        for region in inside:
            if region.any():
                self.join(members[region], label, leaf, pivots)
        return None


def _root(label: np.ndarray, x: int) -> int:
    while label[x] != x:
        label[x] = label[label[x]]
        x = int(label[x])
    return x


def _union(label: np.ndarray, x: int, y: int) -> None:
    x, y = _root(label, x), _root(label, y)
    if x != y:
        label[max(x, y)] = min(x, y)


def _resolve(n: int, percent: int):
    """Exact edges (class, root) of groups; rows sorted by group."""
    def solve(name: list[int], texts: list[str]) -> Iterator[tuple[int, int]]:
        group = Group(shingle_sets(pa.array(texts, pa.large_string()), n), percent)
        label = np.arange(len(name))
        group.join(np.arange(len(name)), label)
        for i in range(len(name)):
            r = _root(label, i)
            if r != i:
                yield name[i], name[r]

    def run(batches):
        name: list[int] = []
        texts: list[str] = []
        last = None
        found: list[tuple[int, int]] = []

        def out():
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for g, c, t in zip(*(batch.column(k).to_pylist() for k in ("group", "class", "text")), strict=True):
                if g != last:
                    found.extend(solve(name, texts))
                    name, texts, last = [], [], g
                    if len(found) > 10_000:
                        yield out()
                        found.clear()
                name.append(c)
                texts.append(t)
        found.extend(solve(name, texts))
        if found:
            yield out()

    return run


def _beside(rows: DataFrame, hubs: DataFrame, judge, schema: str, max_group: int) -> DataFrame:
    """``judge`` of salted parts of each group (of about a quarter of
    ``max_group``), each beside all of the group's ``hubs`` (hub, hub_text)."""
    parts = F.ceil(F.col("members") * 4 / max_group).cast("int")
    sent = hubs.select(F.col("group").alias("home"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("share"),
                       "hub", "hub_text")
    return (rows.withColumn("part", F.pmod(F.xxhash64("class", F.lit(1)), parts).cast("int"))
            .groupBy("group", "part").cogroup(sent.groupBy("home", "share")).applyInPandas(judge, schema))


def _measured(left: pd.DataFrame, right: pd.DataFrame, n: int, percent: int) -> Group:
    """Hubs, then members."""
    texts = [*right["hub_text"], *left["text"]]
    return Group(shingle_sets(pa.array(texts, pa.large_string()), n), percent)


def _regions(large: DataFrame, n: int, percent: int, max_group: int, level: int) -> DataFrame:
    """Add ``homes``: the regions of the group's (at most 16) pivots that a
    member belongs to, as ``group:pivot``. A member that shares nothing with
    any pivot, or hardly anything, goes to the region of the far."""
    slot = F.pmod(F.xxhash64("class", F.lit(level)), F.lit(16))
    pivots = (large.groupBy("group", slot.alias("slot"))
              .agg(F.min(F.struct("class", "text")).alias("p"), F.first("members").alias("members"))
              .select("group", "members", F.col("p.class").alias("hub"), F.col("p.text").alias("hub_text")))

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        group = _measured(left, right, n, percent)
        dist = np.array([group.distance(k)[len(right):] for k in range(len(right))])
        least = dist.min(0)
        inside = (dist <= least + 2 * group.tau + 1e-9) & (dist < 1)
        far = least >= 1 - group.tau - 1e-9
        homes = [[*(f"{g}:{p}" for p in right["hub"].to_numpy()[near]), *([f"{g}:far"] if away else [])]
                 for g, near, away in zip(left["group"], inside.T, far, strict=True)]
        return left.drop(columns="part").assign(homes=pd.Series(homes, index=left.index, dtype=object))

    return _beside(large.select("group", "class", "n_shingles", "text", "members"), pivots, assign,
                   "group string, class long, n_shingles long, text string, members long, homes array<string>", max_group)


def _hub_edges(large: DataFrame, n: int, percent: int, max_group: int) -> DataFrame | None:
    """Exact edges (class, root) of groups that pivots don't divide. In rounds,
    hubs are compared with all members in salted parts; hubs are taken from
    the components so far, one of each, but not from a group's largest. A hub
    is done once compared; a group is when the rest lie in one component."""
    brief = large.select("group", "class", "n_shingles", "members")
    bound = brief.groupBy("group").agg(F.max("n_shingles").alias("longest"))
    edges, used, many = None, None, 16

    def link(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        group = _measured(left, right, n, percent)
        name = np.concatenate([right["hub"].to_numpy(np.int64), left["class"].to_numpy(np.int64)])
        first = np.full(len(name), -1)
        a, b = [], []
        for k in range(len(right)):  # each with its first hub, and hubs that meet in one
            got = np.flatnonzero(group.linked(k))
            new = got[first[got] < 0]
            met = np.unique(first[got])
            first[new] = k
            a += [name[new], name[met[met >= 0]]]
            b.append(np.full(len(new) + int((met >= 0).sum()), name[k]))
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    while True:
        rest = brief if used is None else brief.join(used, ["group", "class"], "left_anti")
        if edges is None:
            named = rest.withColumn("component", F.col("class"))
        else:
            named = (rest.join(components(edges).withColumnRenamed("node", "class"), "class", "left")
                     .withColumn("component", F.coalesce("component", "class")))
        named = stored(named, "hub-components")
        weight = named.groupBy("group", "component").agg(
            F.sum("n_shingles").alias("w"), F.min(F.struct(F.xxhash64("class"), "class")).alias("one"))
        main = weight.groupBy("group").agg(F.max(F.struct("w", "component")).alias("m"))
        # as many hubs as a part has room for
        slots = F.greatest(F.lit(1), F.least(F.lit(many), F.floor(F.lit(max_group // 4) / F.col("longest")).cast("int")))
        taken = (weight.join(main, "group").filter("component <> m.component").join(bound, "group")
                 .select("group", F.col("one.class").alias("class"), slots.alias("slots"))
                 .groupBy("group", F.pmod(F.xxhash64("class", F.lit(many)), "slots").alias("slot"))
                 .agg(F.min("class").alias("class")).select("group", "class"))
        taken = stored(taken, "hubs")
        if not taken.limit(1).count():
            return edges
        hubs = large.join(taken, ["group", "class"]).select(
            "group", "members", F.col("class").alias("hub"), F.col("text").alias("hub_text"))
        rows = large if used is None else large.join(used, ["group", "class"], "left_anti")
        rows = rows.join(taken.select("group").distinct(), "group", "left_semi")  # groups that are not done
        found = _beside(rows.select("group", "class", "text", "members"), hubs, link, "a long, b long", max_group)
        found = stored(found.distinct(), "hub-links")
        edges = found if edges is None else edges.unionByName(found)
        used = taken if used is None else used.unionByName(taken)
        many = min(2 * many, 1 << 12)


def _solve_large(large: DataFrame, n: int, percent: int, max_group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Groups beyond ``max_group`` as (tasks, edges): regions that one task may
    take, and exact edges of what could not be divided. Each round stores one
    row per member with its regions; a group is divided if its regions are at
    most half of it each and twice of it together, and copies stay within four
    times the texts, else it is solved by hubs in salted parts."""
    tasks, edges, level, room = [], [], 0, None
    while True:
        level += 1
        dealt = stored(_regions(large, n, percent, max_group, level), "regions")
        size = (dealt.select("group", "class", "members", "n_shingles", F.explode("homes").alias("home"))
                .groupBy("group", "members", "home")
                .agg(F.sum("n_shingles").alias("size"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("mark")))
        size = stored(size.groupBy("group", "members", "size", "mark").agg(F.min("home").alias("home")), "region-sizes")
        part = (size.groupBy("group", "members").agg(F.max("size").alias("top"), F.sum("size").alias("total"))
                .filter("top * 2 <= members and total <= members * 2"))
        have = size.select("group", "members").distinct().agg(F.sum("members")).first()[0] or 0
        room = 4 * have if room is None else room
        if (part.agg(F.sum("total")).first()[0] or 0) > room:
            part = part.limit(0)
        stuck = dealt.join(part, "group", "left_anti").drop("homes")
        if stuck.limit(1).count():
            found = _hub_edges(stored(stuck, "unsplit"), n, percent, max_group)
            edges += [found] if found is not None else []
        homes = size.join(part.select("group"), "group", "left_semi").select("home", F.col("size").alias("members"))
        split = stored(dealt.select(F.explode("homes").alias("home"), "class", "n_shingles", "text").join(homes, "home")
                       .withColumnRenamed("home", "group"), "split")
        tasks.append(split.filter(F.col("members") <= max_group).select("group", "class", "text"))
        large = split.filter(F.col("members") > max_group)
        if not large.limit(1).count():
            return tasks, edges


def _first() -> F.Column:
    """Rows in order of their id (null last), then text hash."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "h")


def linked_rows(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id",
                max_group: int = MAX_GROUP, max_region: int = MAX_REGION) -> DataFrame:
    """(id, h, n_shingles, root) of every row, which is known by its id and its
    text's hash ``h``: rows of one root are linked; without shingles it is null."""
    src = only(docs, id=key, text="text").withColumn("h", F.xxhash64("text"))
    table = stored(classes(src, n, percent), "classes")
    named = table.select("class", F.explode("window").alias("pivot"))
    shared = (named.groupBy("pivot").agg(F.min("class").alias("low"), F.max("class").alias("high"))
              .filter("low <> high").select("pivot"))
    sketch = table.filter("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n_shingles"),
                                                                   F.first("parity").alias("parity"))
    region = named.join(shared, "pivot").distinct().join(sketch, "class")
    # no link crosses a gap in a region's sizes
    by_size = Window.partitionBy("pivot").orderBy("n_shingles", "class")
    gap = F.col("n_shingles") * percent > 100 * F.coalesce(F.lag("n_shingles").over(by_size), "n_shingles")
    edges = (region.withColumn("run", F.sum(gap.cast("int")).over(by_size))
             .mapInArrow(_near(percent, max_region), "a long, b long").distinct())
    groups = components(stored(edges, "stars"))
    least = (table.filter("class is not null").groupBy("class")
             .agg(F.min(_first()).alias("one"), F.first("n_shingles").alias("n_shingles"))
             .select("class", "n_shingles", F.col("one.id").alias("one_id"), F.col("one.h").alias("one_h")))
    chosen = groups.select(F.col("node").alias("class"), F.col("component").cast("string").alias("group"))
    taken = stored(chosen.join(least, "class"), "chosen")
    sizes = taken.groupBy("group").agg(F.sum("n_shingles").alias("members"))
    # texts move by their rows' keys at every size, whether or not the few keys would fit a broadcast
    own = F.col("id").eqNullSafe(F.col("one_id")) & (F.col("h") == F.col("one_h"))
    members = src.hint("merge").join(taken.join(sizes, "group"), own).select("group", "class", "n_shingles", "text", "members")
    members = stored(members.dropDuplicates(["class"]), "members")
    tasks = members.filter(F.col("members") <= max_group).select("group", "class", "text")
    solved: list[DataFrame] = []
    if sizes.filter(F.col("members") > max_group).limit(1).count():
        split, solved = _solve_large(members.filter(F.col("members") > max_group), n, percent, max_group)
        for t in split:
            tasks = tasks.unionByName(t)
    links = (tasks.repartition(shuffle_width(docs.sparkSession), "group").sortWithinPartitions("group")
             .mapInArrow(_resolve(n, percent), "a long, b long"))
    for e in solved:
        links = links.unionByName(e)
    linked = components(stored(links, "links"))
    return (table.join(linked.withColumnRenamed("node", "class"), "class", "left")
            .select("id", "h", "n_shingles", F.coalesce("component", "class").alias("root")))


def jaccard_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id",
                       max_group: int = MAX_GROUP, max_region: int = MAX_REGION) -> DataFrame:
    """(key, n_shingles, component_id) of every document: 100 * intersection
    >= percent * union links two documents."""
    rows = linked_rows(docs, n, percent, key, max_group, max_region)
    smallest = rows.filter("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    return (rows.join(smallest, "root", "left")
            .select(F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id")))


def one_of_each(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows, all columns as they are, of which each group of linked
    documents keeps the one of smallest id, then text hash, and beside it one
    of those without an id; exact repeats of a row keep one. Rows are known by
    id and text, so a clean document that shares an id with a copy stays;
    documents without shingles stay."""
    rows = stored(linked_rows(docs, n, percent), "linked")
    judged = rows.filter("root is not null")
    judged = judged.withColumn("none", F.col("id").isNull())
    best = judged.groupBy("root", "none").agg(F.min(F.struct("id", "h")).alias("best"))
    gone = (judged.join(best, ["root", "none"]).filter(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))))
            .select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct())
    text = F.xxhash64("text")
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (text == F.col("_h")), "left_anti")
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = F.col("doc_id").isNotNull() | words
    if not kept.filter(once).groupBy("doc_id", text.alias("h")).count().filter("count > 1").limit(1).count():
        return kept
    one = kept.filter(once).withColumn("_hash", text).dropDuplicates(["doc_id", "_hash"])
    return one.drop("_hash").unionByName(kept.filter(~once))


@register("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at a 4-shingle Jaccard of 0.85."""
    return jaccard_components(read(spark, sf_dir, "documents"))
