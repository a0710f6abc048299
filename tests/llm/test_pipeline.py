"""The pipeline and the registered queries on the smallest tables."""

import random
import re

import corpus_pipeline
import pytest
from corpus_fixtures import make, prose  # noqa: F401  (fixtures)

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from vigil.llm import decontaminate, jaccard_join
    from vigil.llm.common import stored
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), "t")
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "mixing":
            assert docs.schema == before.schema
        if name == "near_duplicates":
            assert jaccard_join.jaccard_components(docs).filter("doc_id <> component_id").count() == 0
        if name == "decontaminate":
            assert decontaminate.find_copies(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if name == "pii":
            assert docs.count() == before.count()
            seen = {t for r in before.collect() for t in re.findall(r"\S+@\S+\.com", r.text)}
            assert not seen & {t for r in docs.collect() for t in re.findall(r"\S+@\S+\.com", r.text)}
    assert docs.filter("copies < 1").count() == 0 and docs.count() > 0


def test_near_duplicates_against_brute_force(spark, make):
    """Five words and 0.8: also near copies that 4-shingles at 0.85 don't link."""
    rng = random.Random(3)
    texts = []
    for edits in (0, 1, 3, 4, 5, 6, 9):
        base = prose(rng, 200).split()
        copy = list(base)
        for k in range(edits):
            copy[20 * k + 10] = f"edit{k}"
        texts += [" ".join(base), " ".join(copy)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    kept = [i for i, s in enumerate(sets) if not any(5 * len(s & o) >= 4 * len(s | o) for o in sets[:i])]
    assert 7 not in kept and 9 in kept  # 4 scattered edits: 0.815; 5: 0.773
    got = corpus_pipeline.near_duplicates(spark, make(texts), SF)
    assert sorted(r.doc_id for r in got.collect()) == kept


def test_empty_and_odd_tables(spark, make):
    odd = make([(1, None), (None, "abc"), (2, ""), (2, ""), (3, "some words to keep here")])
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= rows.count()


@pytest.mark.parametrize("n", range(1, 11))
def test_each_operator_has_a_query(n):
    assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1
    assert "pipeline" in entry.queries()
