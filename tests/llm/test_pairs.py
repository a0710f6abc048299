"""Operators on repeated and similar texts against brute force."""


import random

import numpy as np
import pytest
from corpus_fixtures import corpus, make, prose  # noqa: F401  (fixtures)

from vigil.llm import decontaminate, jaccard_join, substring_dedup
from vigil.llm.fm_index import FMIndex, suffix_array
from vigil.llm.graph import components



def words(text):
    return (text or "").encode().split()


def brute_dedup(texts, width):
    count = {}
    split = [words(t) for t in texts]
    for w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            count[k] = count.get(k, 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring_dedup_is_exact(make, corpus, hot):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in
           substring_dedup.remove_repeats(make(corpus), hot=hot).collect()}
    assert got == dict(enumerate(brute_dedup(corpus, 35)))


def test_substring_dedup_repeated_rows_and_ids(make):
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 60)
    texts = [(1, a), (1, a), (1, b), (None, None), (None, b), (2, "")]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in
                 substring_dedup.remove_repeats(make(texts)).collect())
    assert got == sorted([("1", 60, 60), ("1", 60, 60), ("1", 60, 60), ("None", 0, 0), ("None", 60, 60), ("2", 0, 0)])
    assert substring_dedup.remove_repeats(make(texts).limit(0)).count() == 0


@pytest.mark.parametrize("n,sigma", [(1, 1), (60, 1), (300, 3), (2000, 40)])
def test_fm_index(n, sigma):
    s = np.append(np.random.default_rng(n).integers(1, sigma + 1, n), 0)
    t = [tuple(s[i:i + 20]) for i in suffix_array(s, 20)]
    assert t == sorted(t)
    last = np.arange(min(n, 150))
    got = FMIndex(s, 20).statistics(s, last, 12)
    for e in last:
        best = 0
        for k in range(1, min(12, e + 1) + 1):
            p = tuple(s[e - k + 1:e + 1])
            if sum(tuple(s[i:i + k]) == p for i in range(n)) < 2:
                break
            best = k
        assert got[e] == best


def shingles(text, n=4):
    w = [x.decode().translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("limits", [{}, {"max_group": 200, "max_region": 2}])
def test_jaccard_components_are_exact(make, corpus, limits):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           jaccard_join.jaccard_components(make(corpus), **limits).collect()}
    assert got == brute_components(list(enumerate(corpus)))


def test_no_task_takes_a_large_group(make, monkeypatch):
    """A group that no pivot divides, and one that they do, in bounded tasks."""
    rng = random.Random(8)
    base = prose(rng, 60).split()
    texts = []
    for k in range(36):  # near copies, the later ones far from each other
        w = list(base)
        for _ in range(k // 6):
            w[rng.randrange(len(w))] = f"edit{k}x{rng.randrange(99)}"
        texts.append(" ".join(w))
    mark = "four words in common"
    texts += [" ".join([mark, prose(rng, 20)]) for _ in range(24)]
    whole, limit = jaccard_join._resolve, 600

    def bounded(n, percent):
        solve = whole(n, percent)

        def run(batches):
            size = {}
            kept = list(batches)
            for b in kept:
                for g, t in zip(b.column("group").to_pylist(), b.column("text").to_pylist(), strict=True):
                    size[g] = size.get(g, 0) + len(t.split()) - 3
            if max(size.values(), default=0) > limit:
                raise ValueError("a task got more than max_group")
            yield from solve(iter(kept))
        return run

    monkeypatch.setattr(jaccard_join, "_resolve", bounded)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           jaccard_join.jaccard_components(make(texts), max_group=limit, max_region=3).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_jaccard_odd_rows(make):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (5, "A b c d e"), (7, ""), (8, None)]
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in
                 jaccard_join.jaccard_components(make(rows)).collect())
    assert got == [(-1, 2, 3), (3, 2, 3), (3, 2, 3), (5, 2, 3), (7, 0, 7), (8, 0, 8)]
    assert jaccard_join.jaccard_components(make(rows).limit(0)).count() == 0
    one = jaccard_join.one_of_each(make(rows))
    assert sorted((r.doc_id or -1) for r in one.collect()) == [-1, 3, 7, 8]
    assert one.columns == make(rows).columns


def test_group_regions_recurse(corpus):
    """The in-task Voronoi recursion equals growing the whole group."""
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        w = prose(rng, 120).split()
        for _ in range(8):
            v = list(w)
            for _ in range(rng.randrange(7)):
                v[rng.randrange(len(v))] = "zz" + str(rng.randrange(1000))
            texts.append(" ".join(v))
    import pyarrow as pa
    group = jaccard_join.Group(jaccard_join.shingle_sets(pa.array(texts), 4), 85)
    plain, split = np.arange(len(texts)), np.arange(len(texts))
    group.grow(np.arange(len(texts)), plain)
    group.join(np.arange(len(texts)), split, leaf=20, pivots=4)
    assert [jaccard_join._root(plain, i) for i in range(len(texts))] == \
        [jaccard_join._root(split, i) for i in range(len(texts))]


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(0)
    for n, m in ((3, 5), (60, 64), (65, 130), (500, 700)):
        pool = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, k)) for k in (n, m))
        pa_, pb = jaccard_join.parity(a), jaccard_join.parity(b)
        x, y = (int.from_bytes(v, "little") for v in (pa_, pb))
        wx, wy = len(pa_) * 8, len(pb) * 8
        d = (jaccard_join._fold(x, wx, wy) ^ jaccard_join._fold(y, wy, wx)).bit_count()
        assert d <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    looped = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k not in looped}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontaminate_finds_edited_copies(spark, make):
    rng = random.Random(11)
    items = [prose(rng, rng.randint(3, 60)) for _ in range(12)] + ["", None, "Two words"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    texts, want = [], set()
    for k in range(40):
        i = rng.randrange(12)
        w = items[i].split()
        for _ in range(rng.randint(0, int(len(w) * .15))):
            w[rng.randrange(len(w))] = "changed"
        host = prose(rng, 80).split()
        at = rng.randrange(80)
        texts.append(" ".join(host[:at] + [w[0].upper() + ","] + w[1:] + host[at:]))
        want.add((k, i))
    clean = [prose(rng, 200, ["xa", "xe", "xi", "xo", "xu", "ya", "ye", "yi"]) for _ in range(20)]
    docs = make(texts + clean + ["", None])
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_copies(docs, bench).collect()}
    assert want <= got and not any(d >= 40 for d, _ in got)
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.find_copies(docs, bench, block=4).collect()}
    assert blocks == got
    kept = decontaminate.without_copies(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40, 62))
    assert decontaminate.find_copies(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_copies(docs.limit(0), bench).count() == 0


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a = rng.integers(1, 6, rng.integers(1, 9)).astype(np.uint64)
        b = rng.integers(1, 6, rng.integers(1, 14)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                same = 4 if a[i] == b[j] else -3
                h[i + 1, j + 1] = max(0, h[i, j] + same, h[i, j + 1] - 3, h[i + 1, j] - 3)
        score, *_ = decontaminate.align(a[None], b[None])
        assert score[0] == h.max()


def test_seeds_are_the_rarer_half_and_all_rare_pairs():
    df = np.array([5, 1, 9, 2, 2, 7, 1, 3])
    assert decontaminate.choose_seeds(df, 0).tolist() == [1, 3, 4, 6]
    assert decontaminate.choose_seeds(df, 5).tolist() == [0, 1, 3, 4, 6, 7]


def plain_alignment(a, b):
    """(score, matched words) of the best local alignment."""
    h = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = (0, 0)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s, k = h[i][j]
            h[i + 1][j + 1] = max((0, 0), (s + 4, k + 1) if x == y else (s - 3, k), (h[i][j + 1][0] - 3, h[i][j + 1][1]),
                                  (h[i + 1][j][0] - 3, h[i + 1][j][1]))
            best = max(best, h[i + 1][j + 1])
    return best


def test_partial_and_inserted_copies_against_plain_alignment(make, spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    common = [word() for _ in range(6)]
    words = lambda n: [rng.choice(common) if rng.random() < .4 else word() for _ in range(n)]
    items = [words(60), words(60), words(300), words(14), words(27), words(1)]
    a, b, c = items[:3]
    texts = [words(30) + a[:45] + words(20),                                        # three quarters, word for word
             [w for k in range(0, 60, 3) for w in [*a[k:k + 3], word()]],           # a word after each three
             words(9) + [w for k in range(0, 60, 2) for w in [*b[k:k + 2], word()]],  # and after each two
             words(80) + c[120:170] + words(50),                                    # a passage of a long item
             [w if k % 6 else word() for k, w in enumerate(c[20:110])],             # edited
             c[:12] + words(40) + c[100:112],                                       # short parts only
             a[:10] + words(5) + b[:11] + words(3), items[3] + words(4), words(5) + items[4][:21], words(200), items[5], [],
             [w for k, w in enumerate(c) if k % 5]]
    docs = make([" ".join(t) for t in texts] + [None])
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            score, matched = plain_alignment(item, t)
            if t and (matched >= .8 * len(item) or (matched >= decontaminate.RUN and score >= 2 * matched)):
                want.add((d, i, round(score / (4 * len(item)), 9)))
    got = {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.find_copies(docs, bench).collect()}
    assert got == want
    assert {(0, 0), (1, 0), (2, 1), (3, 2), (4, 2)} <= {w[:2] for w in want} and not any(w[0] in (5, 6, 9) for w in want)


def test_decontaminate_long_items_and_shared_seeds(make, spark):
    rng = random.Random(22)
    long = [f"w{rng.randrange(4000)}" for _ in range(6000)]
    docs = make(["x " * 50 + " ".join(long[3000:3400]), " ".join(long), "same words here " * 400, "other " * 30])
    bench = spark.createDataFrame([(1, " ".join(long)), (2, "same words here " * 12), (2, "same words here " * 12), (None, "other " * 30)],
                                  "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or -1) for r in decontaminate.find_copies(docs, bench).collect())
    assert got == [(0, 1), (1, 1), (2, 2), (2, 2), (3, -1)]


def test_rows_that_share_an_id_are_linked_by_their_own_text(make):
    rng = random.Random(31)
    a, b = prose(rng, 80), prose(rng, 80)
    near = " ".join(["other", *b.split()[1:]])
    c = prose(rng, 70)
    near_c = " ".join([*c.split()[:-1], "end"])
    rows = [(1, a), (1, b), (3, near), (None, c), (None, near_c), (5, a + " " + b), (None, near), (1, b), (8, ""), (8, None)]
    got = jaccard_join.jaccard_components(make(rows)).collect()
    sets = [plain_set(t) for _, t in rows]
    want = []
    for x, (i, _) in enumerate(rows):
        same, todo = {x}, [x]
        while todo:
            y = todo.pop()
            for z in range(len(rows)):
                if z not in same and sets[y] and sets[z] and 100 * len(sets[y] & sets[z]) >= 85 * len(sets[y] | sets[z]):
                    same.add(z)
                    todo.append(z)
        ids = [rows[z][0] for z in same if rows[z][0] is not None]
        want.append((i, len(sets[x]), min(ids) if ids else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(make(rows), 4, 85).collect()), key=repr)
    first_c = min((c, near_c), key=lambda t: [k for k, x in kept if x == t] == [])
    assert kept == sorted([(1, a), (1, b), (5, a + " " + b), (None, first_c), (None, near), (8, ""), (8, None)], key=repr)


def plain_set(text, n=4):
    w = [x for x in (text or "").lower().split() if x]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_word_hashes_have_no_structure(make):
    """Thue-Morse words and their complements collide under polynomial hashes."""
    import pyarrow as pa
    from vigil.llm.words import words_of
    bits = [bin(i).count("1") & 1 for i in range(1 << 12)]
    for size in (1 << 10, 1 << 11, 1 << 12):
        pair = ["".join("ab"[x] for x in bits[:size]), "".join("ba"[x] for x in bits[:size])]
        h = words_of(pa.array(pair, pa.large_string())).hash
        assert h[0] != h[1]
    assert len(set(words_of(pa.array(["ab ba abab baba aabb abba b a"], pa.large_string())).hash.tolist())) == 8
    x, y = pair
    tail = " " + " ".join(f"w{i}" for i in range(60))
    rows = [(1, x + tail), (2, y + tail)]
    assert [r.n_removed for r in substring_dedup.remove_repeats(make(rows)).orderBy("doc_id").collect()] == [60, 60]
