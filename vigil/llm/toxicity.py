"""Toxicity scores by weak supervision.

1. Lexicons are induced from the labelled training rows: lower-cased words and
   word beginnings of 4 to 8 letters whose smoothed log-odds between toxic and
   clean documents is high, copies of a text counting once.
2. Many voters look at each training document: one per leading lexicon entry
   (toxic or abstain), and patterns (entry counts, density, shouting, no entry
   at all).
3. A generative label model - one accuracy per voter and class, a class prior,
   and pairwise correlations that share weight among voters that repeat each
   other - is fitted to the votes by EM; the training labels enter as one more
   voter, of fixed accuracy.
4. A linear classifier is trained on the model's posterior labels.

The fit uses at most ``max_rows`` labelled rows (documented bound, taken in
hash order of the id, all toxic and clean alike); scoring reads every whole
text. Labels, language, source and id never enter a score.

Defined cases: null or empty text scores the classifier's intercept; a null id
is never held out; rows whose label is null do not train; without both classes
among the training rows every score is the share of toxic labels (0 without
any); repeated rows score alike; other input columns stay out.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import arrow_map, crc_mod4, only, read, text_slices
from vigil.llm.registry import register
from vigil.llm.words import words_of

HELD_OUT = 2
THRESHOLD = 0.3
MAX_ROWS = 8_000
_WORD = regex.compile(r"[^\W\d_]+")
_STEMS = range(4, 9)


def features(text: str | None) -> set[str]:
    """Distinct lower-cased words and, marked by a final ``*``, their beginnings."""
    found = set(_WORD.findall((text or "").lower()))
    return found | {w[:n] + "*" for w in found for n in _STEMS if len(w) > n}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]   # of lexicon entries
    extra: tuple[float, ...]    # of the pattern features
    bias: float


def _patterns(text: str, hits: int) -> tuple[float, ...]:
    words = max(1, text.count(" ") + 1)
    return (float(min(hits, 3)) / 3, min(1.0, 20 * hits / words), min(1.0, 10 * text.count("!") / words))


def copy_weights(texts: list[str]) -> np.ndarray:
    """One over the number of texts that share a text's smallest 3-word hash,
    so that copies and near copies speak once."""
    key = np.arange(len(texts)).astype(np.uint64)  # fewer than 3 words: on its own
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    at = 0
    for part in text_slices(batch):
        w = words_of(part.column("text"), lower=True)
        grams, ok = w.grams(3), w.after(3)
        ok = ok[:len(grams)]
        doc = w.doc[:len(grams)][ok]
        if len(doc):
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            key[at + doc[first]] = np.minimum.reduceat(grams[ok], first)
        at += part.num_rows
    _, which, n = np.unique(key, return_inverse=True, return_counts=True)
    return 1 / n[which]


def induce(found: list[np.ndarray], names: list[str], label: np.ndarray, weight: np.ndarray,
           keep: int = 4000, least: float = 3) -> tuple[list[str], list[float]]:
    """Entries that speak for the toxic class, strongest first, with their log-odds."""
    flat = np.concatenate(found) if found else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(found)), [len(f) for f in found])
    sums = [np.bincount(flat, (weight * side)[of], len(names)) for side in (label, 1 - label)]
    often = np.flatnonzero(sums[0] >= least)
    toxic, clean = ({names[i]: float(t[i]) for i in often} for t in sums)
    n1, n0 = max(1., (weight * label).sum()), max(1., (weight * (1 - label)).sum())
    scored = []
    for w, k in toxic.items():
        p1, p0 = (k + .1) / (n1 + .2), (clean.get(w, 0) + .5) / (n0 + 1)
        odds = math.log(p1 / p0)
        z = (k / n1 - clean.get(w, 0) / n0) / math.sqrt((k + clean.get(w, 0)) / (n1 + n0) * (1 / n1 + 1 / n0))
        if odds > 1.5 and z > 4:
            scored.append((odds * math.sqrt(k), w, odds))
    kept: dict[str, float] = {}
    for _, w, o in sorted(scored, reverse=True):
        stem = w.rstrip("*")
        if any(stem[:n] + "*" in kept for n in _STEMS if n < len(stem)):
            continue  # a kept beginning stands for it
        if w.endswith("*") and any(v.startswith(stem) and toxic[v] > .99 * toxic[w] for v in kept):
            continue  # only that one word begins so
        kept[w] = o
        if len(kept) == keep:
            break
    return list(kept), list(kept.values())


def votes(hits: list[list[int]], odds: list[float], texts: list[str], leading: int = 24) -> np.ndarray:
    """Votes of every voter: 1 toxic, 0 clean, -1 abstains. ``hits``: the
    lexicon entries of each text."""
    out = np.full((len(hits), leading + 5), -1, np.int8)
    for i, (hit, t) in enumerate(zip(hits, texts, strict=True)):
        words = max(1, t.count(" ") + 1)
        total = sum(odds[j] for j in hit)
        for j in hit:
            if j < leading:
                out[i, j] = 1
        out[i, leading] = 1 if len(hit) >= 2 else 0 if not hit else -1
        out[i, leading + 1] = 1 if total > 6 else 0 if total < 1 else -1
        out[i, leading + 2] = 1 if any(odds[j] > 3.5 for j in hit) else 0 if not hit else -1
        out[i, leading + 3] = 1 if len(hit) / words > .02 else 0 if len(hit) / words < .001 else -1
        out[i, leading + 4] = 1 if t.count("!") / words > .2 else -1
    return out


def label_model(v: np.ndarray, known: np.ndarray, rounds: int = 25, trust: float = .95) -> np.ndarray:
    """Posterior of the toxic class: class-conditional vote rates by EM, each
    voter's log-likelihood weighted down by its correlation with the others
    given the class. ``known`` (the labels) is a voter whose accuracy is held at
    ``trust``, which keeps the two classes from drifting to another split."""
    onehot = np.stack([v == k for k in (-1, 0, 1)], -1).astype(float)       # doc, voter, vote
    anchor = np.where(known > .5, 1, -1) * math.log(trust / (1 - trust))
    post = np.where(known > .5, trust, 1 - trust)
    share = np.ones(v.shape[1])
    for step in range(rounds):
        rates = []
        for q in (1 - post, post):
            r = np.einsum("d,dvk->vk", q, onehot) + .5
            rates.append(r / r.sum(1, keepdims=True))
        if step % 5 == 4:  # correlations given the class
            x = (v == 1).astype(float)
            expect = np.outer(1 - post, rates[0][:, 2]) + np.outer(post, rates[1][:, 2])
            rest = x - expect
            scale = np.sqrt((rest ** 2).mean(0)) + 1e-6
            corr = np.clip(np.abs(rest.T @ rest / len(rest) / np.outer(scale, scale)), 0, 1)
            share = 1 / (1 + np.where(corr > .1, corr, 0).sum(1) - np.diag(corr) * (np.diag(corr) > .1))
        gain = np.einsum("dvk,vk,v->d", onehot, np.log(rates[1]) - np.log(rates[0]), share)
        odds = gain + anchor + math.log(max(1e-6, post.mean()) / max(1e-6, 1 - post.mean()))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def fit_linear(rows: list[tuple[list[int], tuple[float, ...]]], width: int, target: np.ndarray,
               rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r, _ in rows])
    col = np.fromiter((c for r, _ in rows for c in r), np.int64)
    dense = np.array([e for _, e in rows])
    w, e, b = np.zeros(width), np.zeros(dense.shape[1]), math.log((target.mean() + 1e-3) / (1.001 - target.mean()))
    momentum = [np.zeros_like(w), np.zeros_like(e), 0.0]
    rate = np.bincount(col, minlength=width) / len(rows) + .002
    for _ in range(rounds):
        z = np.bincount(doc, w[col], len(rows)) + dense @ e + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        step = (np.bincount(col, g[doc], width) / rate + ridge * w, dense.T @ g + ridge * e, g.sum())
        for k, (s, lr) in enumerate(zip(step, (.15, 2., .5), strict=True)):
            momentum[k] = .9 * momentum[k] + lr * s
        w, e, b = w - momentum[0], e - momentum[1], b - momentum[2]
    return w, e, float(b)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled rows outside the held-out fold (at most ``max_rows``).
    One task fits; only the weights reach the driver."""
    lab = (only(labels, doc_id="doc_id", y="toxic").dropna().filter(crc_mod4() != HELD_OUT)
           .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = (only(docs, doc_id="doc_id", text="text").join(F.broadcast(lab), "doc_id")
            .select(F.xxhash64("doc_id", "text").alias("h"), "text", F.col("y").cast("double").alias("y")))

    def run(batches):
        texts: list[str] = []
        y: list[float] = []
        for b in batches:
            texts += [t or "" for t in b.column("text").to_pylist()]
            y += b.column("y").to_pylist()
        model = fit_texts(texts, np.array(y))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = rows.repartition(1).sortWithinPartitions("h", "y").select("text", "y").mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit_texts([], np.zeros(0))


def fit_texts(texts: list[str], y: np.ndarray) -> Model:
    """The model of labelled texts."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, (0., 0., 0.), math.log((share + 1e-9) / (1 - share + 1e-9)))
    # only what three toxic texts share can enter the lexicon; counts by hash
    # first, so that names are kept of few features
    often = np.zeros(1 << 20, np.int32)
    for t in (t for t, toxic in zip(texts, y, strict=True) if toxic):
        often[[hash(w) & 0xFFFFF for w in features(t)]] += 1
    known: Counter[str] = Counter()
    for t in (t for t, toxic in zip(texts, y, strict=True) if toxic):
        known.update(w for w in features(t) if often[hash(w) & 0xFFFFF] >= 3)
    names = {w: i for i, w in enumerate(w for w, k in known.items() if k >= 3)}
    del often, known
    found = [np.array([names[w] for w in features(t) if w in names], np.int64) for t in texts]
    lexicon, odds = induce(found, list(names), y, copy_weights(texts))
    if not lexicon:
        return Model({}, (0., 0., 0.), math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    at = np.full(len(names), -1)
    at[[names[w] for w in lexicon]] = np.arange(len(lexicon))
    hits = [at[f][at[f] >= 0].tolist() for f in found]
    post = label_model(votes(hits, odds, texts), y)
    data = [(hit, _patterns(t, len(hit))) for hit, t in zip(hits, texts, strict=True)]
    w, e, b = fit_linear(data, len(lexicon), post)
    return Model(dict(zip(lexicon, w.tolist(), strict=True)), tuple(e.tolist()), b)


def _score(text: str | None, m: Model) -> float:
    text = text or ""
    hit = [m.weights[w] for w in features(text) if w in m.weights]
    z = m.bias + sum(hit) + sum(a * b for a, b in zip(m.extra, _patterns(text, len(hit)), strict=True))
    return 1 / (1 + math.exp(-max(-500., min(500., z))))


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) of every whole text."""
    src = only(docs, key=key, text="text")
    kind = src.schema["key"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = [_score(t, sent.value) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.float64())], ["key", "score"])

    return src.mapInArrow(arrow_map(run), f"key {kind}, score double").withColumnRenamed("key", key)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns as they are, whose text scores below the threshold."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        keep = [_score(t, sent.value) < threshold for t in part.column(at).to_pylist()]
        return part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(arrow_map(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, fit(docs, labels, max_rows))
    return scored.select("doc_id", F.coalesce(crc_mod4() == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
