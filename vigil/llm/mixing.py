"""Mixing sources to target weights by soft membership.

1. A labelled table (rows of ``labels`` say which documents' domains, here
   languages, may be learnt from) trains a multinomial naive Bayes classifier:
   words hashed into ``BUCKETS`` counts per domain, all by distributed sums.
2. Every document gets a posterior over the domains and a number of tokens
   (words), from its whole text, within its row.
3. Rates r >= 0 are fitted so that the expected domain totals
   sum(r * tokens * posterior) equal the target weights times the wanted number
   of tokens: projected gradient steps on the least squares of the residuals,
   scaled by the domains' second moments, from r = 1. A step is one aggregate
   of a number per domain; a document's rate is an expression of the steps so
   far, so nothing per document is sent or rewritten between steps.
4. Rates become whole copies: the whole part, and one more for documents whose
   hash falls under the fraction.

All of it is DataFrame expressions, and texts are never shuffled. The model is
``BUCKETS`` numbers per domain, whatever the input.

Defined cases: null or empty text has no tokens and the prior as posterior;
rows whose id or domain is null do not train; a null id is a document like
others; without labelled rows every posterior is even; a domain that no
document speaks for cannot be reached and the others are fitted by least
squares; an empty table gives an empty result; repeated rows are fitted alike;
other input columns stay as they are, those named like a result excepted.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.arrays import materialize
from vigil.llm.common import only, read, stored
from vigil.llm.registry import register

BUCKETS = 1 << 12
#: Target share of tokens of each domain.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
STEPS = 50
#: Labelled ids that the classifier is fitted on at most.
MAX_ROWS = 20_000
TOLERANCE = 1e-7
_FRACTION = 1 << 30


def _buckets(text: Column) -> Column:
    """The hash buckets of a text's words, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def train(docs: DataFrame, labels: DataFrame, domains: list[str],
          domain: str = "lang", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Log prior of each domain, and the log-likelihood of each domain per
    bucket, from at most ``max_rows`` labelled ids (in hash order)."""
    lab = (only(labels, doc_id="doc_id").dropna().distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    known = (only(docs, doc_id="doc_id", text="text", domain=domain).filter(F.col("domain").isin(domains))
             .join(F.broadcast(lab), "doc_id", "left_semi"))  # at most max_rows ids
    per = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)]
    n = known.agg(*per).first()
    rows = (known.select("domain", F.explode(_buckets(F.col("text"))).alias("bucket"))
            .groupBy("bucket").agg(*per).collect())  # at most BUCKETS rows
    counts = np.full((BUCKETS, len(domains)), 0.5)
    for r in rows:
        counts[r.bucket] += r[1:]
    prior = np.array([(c or 0) + 1.0 for c in n])
    if not rows:
        counts[:], prior[:] = 1, 1
    return np.log(prior / prior.sum()), np.log(counts / counts.sum(0))


def with_posterior(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], domains: list[str]) -> DataFrame:
    """Add ``tokens`` and one column ``p<k>`` per domain."""
    prior, table = model
    held = materialize(docs, "_buckets", _buckets(F.col("text")))

    def log_odds(k: int) -> Column:
        weights = F.from_json(F.lit(json.dumps([round(x, 6) for x in table[:, k].tolist()])), "array<double>")
        return F.aggregate("_buckets", F.lit(float(prior[k])), lambda a, b: a + F.get(weights, b))

    scored = materialize(held, "_odds", F.array(*(log_odds(k) for k in range(len(domains)))))
    top = F.array_max("_odds")
    held = materialize(scored, "_likely", F.transform("_odds", lambda o: F.exp(o - top)))
    total = F.aggregate("_likely", F.lit(0.0), lambda a, x: a + x)
    return held.select(*(f"`{c}`" for c in docs.columns if c not in _made(domains)),
                       F.size("_buckets").cast("long").alias("tokens"),
                       *((F.col("_likely")[k] / total).alias(f"p{k}") for k in range(len(domains))))


def _made(domains) -> set[str]:
    return {"tokens", "rate", "copies", "_buckets", "_odds", "_likely", *(f"p{k}" for k in range(len(domains)))}


def fit_rates(scored: DataFrame, targets: dict[str, float], total: float | None = None,
              steps: int = STEPS) -> tuple[Column, np.ndarray]:
    """The rate of a document as an expression of its posterior, and the last
    residual of each domain as a share of all tokens."""
    p = [F.col(f"p{k}") for k in range(len(targets))]
    t = F.col("tokens").cast("double")
    pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p))]
    row = scored.agg(F.sum(t), *(F.sum(t * p[i] * p[j]) for i, j in pairs)).first()
    all_tokens = float(row[0] or 0)
    rate: Column = F.lit(1.0)
    if not all_tokens:
        return rate, np.zeros(len(p))
    moment = np.zeros((len(p), len(p)))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        moment[i, j] = moment[j, i] = v / all_tokens
    scale = np.linalg.pinv(moment, rcond=1e-6, hermitian=True)
    weights = np.array(list(targets.values()), float)
    wanted = weights / weights.sum() * (total or all_tokens) / all_tokens
    rest = np.zeros(len(p))
    for _ in range(steps):
        sums = scored.agg(*(F.sum(t * rate * x) for x in p)).first()
        rest = np.array([s / all_tokens for s in sums]) - wanted
        if np.abs(rest).max() < TOLERANCE:
            break
        step = scale @ rest
        rate = F.greatest(F.lit(0.0), rate - sum((x * float(s) for x, s in zip(p, step, strict=True)), F.lit(0.0)))
    return rate, rest


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = "lang",
        labelled: DataFrame | None = None, total: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """The documents (columns ``keep``, default all) with tokens, posterior
    columns, ``rate`` and ``copies``. ``labelled``: the documents to learn
    from, if not the same."""
    domains = list(targets)
    model = train(labelled if labelled is not None else docs, labels, domains, domain)
    scored = with_posterior(docs, model, domains)
    scored = scored.withColumn("_draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(_FRACTION)) / float(_FRACTION))
    kept = [c for c in (keep or docs.columns) if c not in _made(domains)]
    scored = stored(scored.select(*(f"`{c}`" for c in kept), "tokens", *(f"p{k}" for k in range(len(domains))),
                                  "_draw"), "posteriors")
    rate, _ = fit_rates(scored, targets, total)
    copies = F.floor("rate") + (F.col("_draw") < F.col("rate") - F.floor("rate")).cast("long")
    return (scored.withColumn("rate", rate).withColumn("copies", copies.cast("int"))
            .select(*(f"`{c}`" for c in kept), "tokens",
                    *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)), "rate", "copies"))


@register("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target language shares."""
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])
