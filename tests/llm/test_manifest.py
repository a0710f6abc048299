"""Merkle manifest against a plain recursive tree."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from corpus_fixtures import SCHEMA, prose

from vigil.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([H(*last[i:i + 16]) for i in range(0, len(last), 16)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + 16])))
        i //= 16
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """Sorted result rows of (doc_id, source, lang, n_chars, text)."""
    leaves = {}
    for doc_id, source, lang, n_chars, text in rows:
        head = [field(v) for v in (doc_id, source, lang, n_chars)]
        own = H(*head, field(text))
        bad = own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            bad = H(*head, field(lower(text)))
        leaves.setdefault(source, []).append(((doc_id is not None, doc_id or 0, own), doc_id, own, bad))
    groups = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in groups:
        leaves[s].sort(key=lambda x: x[0])
        trees[s] = levels_of([x[2] for x in leaves[s]])
    top = levels_of([trees[s][-1][0] for s in groups])
    root = top[-1][0]
    out = []
    for g, s in enumerate(groups):
        for i, (_, doc_id, own, bad) in enumerate(leaves[s]):
            steps = path(trees[s], i) + path(top, g)
            folded = bad
            for a, b in steps:
                folded = H(a, folded, b)
            out.append((doc_id, own, trees[s][-1][0], root, H(*(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, lang, s, n, "x", 1, 0.5) for i, s, lang, n, t in rows], SCHEMA)
    got = manifest.Manifest(manifest.document_items(df), ["doc_id"]).verify("tampered", {"doc_id": "bigint"})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_layout_is_a_bijection_that_keeps_runs_together():
    for levels in range(1, 6):
        seen = np.concatenate([manifest.address(levels, d, np.arange(16 ** d)) for d in range(levels)])
        assert sorted(seen.tolist()) == list(range(manifest.size(levels)))
    leaves = manifest.address(4, 3, np.arange(4096)).reshape(-1, 16)
    assert (np.diff(leaves, axis=1) == 1).all()  # siblings are one stretch
    parents = manifest.address(4, 2, np.arange(256))
    assert (leaves[:, 0] - parents == 1).all()   # beside their parent


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257, 300])
def test_stored_subtree_gives_back_its_siblings(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    levels = levels_of([d.hex() for d in leaves])
    height = manifest.height_of(n)
    nodes, root = manifest.lay_out(leaves, height)
    assert root.hex() == levels[-1][0] and height == len(levels) - 1
    sub = manifest.Subtree(nodes, n, height)
    for i in range(0, n, 7):
        assert sub.path(i) == path(levels, i)
        assert manifest.fold(leaves[i].hex(), sub.path(i)) == root.hex()


def test_manifest_with_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "é", ""]), rng.choice(["en", None]), i, prose(rng, 5).title())
            for i in range(400)]
    rows += [(None, "hot", "en", None, None), (None, None, None, None, "Null"), (7, "hot", "en", 1, "Again"),
             (7, "hot", "en", 1, "Again"), (10 ** 12, None, "en", 0, ""), (-3, "lone", "en", 1, "AÉ" * 5000)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_many_tiers_and_many_groups(spark, monkeypatch):
    """Small subtrees, so that each tree takes several tiers, and the tree
    over the groups more than one run."""
    rng = random.Random(6)
    rows = [(i, f"s{i % 40}" if i % 3 else "hot", "en", i, f"Text {i}") for i in range(1200)]
    rng.shuffle(rows)
    monkeypatch.setattr(manifest, "HEIGHT", 1)
    monkeypatch.setattr(manifest, "CAP", 16)
    cloudpickle.register_pickle_by_value(manifest)  # workers get the small sizes too
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(manifest)


def test_lone_and_empty(spark):
    assert run(spark, [(4, "s", "en", 1, "Abc")]) == brute([(4, "s", "en", 1, "Abc")])
    assert run(spark, []) == []
