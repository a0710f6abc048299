"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data,
mixing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

Defined cases: documents without text have no shingles and no entities and
pass every filter that judges text (toxicity judges them by its intercept);
documents with a null id are judged by their text and stay unless that is
rejected; exact repeats of a row are one document of a group, of which one row
stays; extra columns pass through all but the last stage; an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import decontaminate as leaks
from vigil.llm import jaccard_join, mixing, pii
from vigil.llm import toxicity as toxic
from vigil.llm.common import read, stored

#: Words of a shingle and least similarity in per cent of near duplicates.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It is fitted on the
    labelled rows of the ``documents`` table, and scores each row in place."""
    model = toxic.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxic.clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one of smallest id
    (and of repeats of that id the first by text). Documents are linked at a
    Jaccard similarity of their 5-word shingles of 0.8 or more; the query op4
    has thresholds of its own."""
    return jaccard_join.one_of_each(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return leaks.without_copies(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by surrogates; ``n_chars`` is
    that of the new text."""
    out = pii.without_pii(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents to train on, with rates and whole copies for the target
    language shares; documents with no copy go."""
    return mixing.mix(docs, read(spark, sf_dir, "labels")).filter("copies > 0")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("pii", personal_data), ("mixing", mix)]

#: The classifier, the surrogates and the fitted rates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
