"""Model scoring: isolation forest, reconstruction error, dual-model rule.

The reference scores each point with two pre-trained models whose files are
not shipped: an isolation forest (anomaly when it predicts -1) and a neural
autoencoder (degradation when the mean squared reconstruction error exceeds
0.05). A prediction is published when either fires. Here both models are
trained as Spark jobs on the data they score:

* isolation forest (Liu, Ting & Zhou 2008): ``t`` trees, each grown on a
  random subsample of ``psi`` rows. The subsample rows are tagged with a tree
  id and each tree is grown by ``applyInPandas`` on its own group (groups
  hold ~psi rows by construction). The forest is at most t * (2 psi - 1)
  nodes — bounded by parameters, not data — so it is broadcast to a
  vectorised pandas UDF that scores Arrow batches. Score
  s = 2^(-E[h(x)] / c(psi)); anomaly when s > 0.5.
* reconstruction model: a *stand-in* linear autoencoder (the reference's
  network is not available): the vector of the last ``d`` standardised values
  of the series is projected onto the top-``k`` principal components
  (``pyspark.ml.feature.PCA``, fitted distributedly) and back; the loss is
  the mean squared error. The projection is a d x k matrix written into
  plain column arithmetic, so scoring stays on the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.config import MadConfig
from vigil.schemas import SERIES_KEY
from vigil.session import store_table

# --- fixed values ---------------------------------------------------------
RECONSTRUCTION_THRESHOLD = 0.05
# --------------------------------------------------------------------------
EULER_GAMMA = 0.5772156649015329
DEFAULT_PRODUCER = "vigil-ml"


def reconstruction_mse(x: Column, xhat: Column) -> Column:
    """mean((xhat - x)^2) over two equal-length arrays (summed left to right)."""
    sq = F.zip_with(xhat, x, lambda o, i: (o - i) * (o - i))
    return F.aggregate(sq, F.lit(0.0), lambda acc, y: acc + y) / F.size(x)


def array_mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y) / F.size(x)


def recent_values(points: DataFrame, d: int, chunk_seconds="auto") -> DataFrame:
    """Adds ``recent``: the last ``d`` values of the series ending at each point
    (fewer at the start), with the detector's skew-safe framing."""
    from vigil.operators.mad import _normalize_keys, _window_frames, plan_chunks
    keys = list(SERIES_KEY)
    pts = _normalize_keys(points, keys)
    if isinstance(chunk_seconds, str) and chunk_seconds == "auto":
        chunk_seconds = plan_chunks(pts, keys)
    cfg = MadConfig(window_size=d, warmup=1).normalized()
    return _window_frames(pts, cfg, keys, False, chunk_seconds).withColumnRenamed("_frame", "recent")


# ------------------------------------------------------------ isolation forest
def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


_TREE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("split", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType())])


def _grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    nodes: list[tuple[int, float, int, int, int]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        nid = len(nodes)
        nodes.append((-1, 0.0, -1, -1, len(rows)))
        if depth >= max_depth or len(rows) <= 1:
            return nid
        f = int(rng.integers(x.shape[1]))
        col = x[rows, f]
        lo, hi = col.min(), col.max()
        if lo == hi:
            return nid
        s = float(rng.uniform(lo, hi))
        left = grow(rows[col < s], depth + 1)
        right = grow(rows[col >= s], depth + 1)
        nodes[nid] = (f, s, left, right, len(rows))
        return nid

    grow(np.arange(len(x)), 0)
    return nodes


_DRAWS = 1 << 40


def fit_isolation_forest(points: DataFrame, features: list[str], *, n_trees: int = 100,
                         psi: int = 256, seed: int = 42) -> pd.DataFrame:
    """Grow the forest as a Spark job; returns the node table (bounded by
    n_trees * (2 psi - 1) rows).

    Each tree has its own subsample of ``psi`` points (all of them, if there are
    fewer): those of the smallest hash of (seq, tree). A hash threshold first
    leaves some 1.5 psi candidates per tree, so what is gathered is bounded by the
    forest. The draw depends on ``seq`` alone, not on how rows are partitioned."""
    total = points.count()
    psi = max(1, min(psi, total))
    share = min(1.0, (1.5 * psi + 60) / max(total, 1))
    max_depth = max(1, int(math.ceil(math.log2(max(psi, 2)))))
    draw = lambda t: F.pmod(F.xxhash64(F.col("seq"), t, F.lit(seed)), F.lit(_DRAWS))
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(
        t.alias("tree_id"), draw(t).alias("draw"))), lambda s: s.draw < F.lit(int(share * _DRAWS)))
    sample = points.select(*features, "seq", F.explode(drawn).alias("d")).select(*features, "seq", "d.*")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tid = int(pdf["tree_id"].iloc[0])
        rng = np.random.default_rng(seed * 1_000_003 + tid)
        x = pdf.sort_values(["draw", "seq"])[features].to_numpy(dtype=float)[:psi]
        nodes = _grow_tree(x, rng, max_depth)
        return pd.DataFrame({"tree_id": tid, "node": np.arange(len(nodes), dtype=np.int32),
                             "feature": [n[0] for n in nodes], "split": [n[1] for n in nodes],
                             "left": [n[2] for n in nodes], "right": [n[3] for n in nodes],
                             "size": [n[4] for n in nodes]})

    return sample.groupBy("tree_id").applyInPandas(fit, _TREE_SCHEMA).toPandas()


def _compiled(forest: pd.DataFrame) -> list[tuple]:
    """Per tree: arrays of its nodes, the length that a leaf's own points add,
    and the path length that normalises the tree's sample size."""
    out = []
    for _, t in forest.sort_values(["tree_id", "node"]).groupby("tree_id"):
        sizes = t["size"].to_numpy()
        out.append((*(t[c].to_numpy() for c in ("feature", "split", "left", "right")),
                    np.array([c_factor(n) for n in sizes]), c_factor(float(sizes[0])) or 1.0))
    return out


def _path_lengths(x: np.ndarray, tree: tuple) -> np.ndarray:
    """Path length of each point over that of the tree's sample size."""
    feat, split, left, right, leaf, norm = tree
    cur = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x))
    active = feat[cur] >= 0
    while active.any():
        idx = np.nonzero(active)[0]
        f = feat[cur[idx]]
        go_left = x[idx, f] < split[cur[idx]]
        cur[idx] = np.where(go_left, left[cur[idx]], right[cur[idx]])
        depth[idx] += 1
        active = feat[cur] >= 0
    return (depth + leaf[cur]) / norm


def calibrated_cut(scored: DataFrame, contamination: float, error: float = 1e-4, score: str = "if_score") -> float:
    """The score above which the wanted share of the training points lies: its
    quantile by a sketch that tasks build and Spark merges, so that the share
    of points above is at most ``contamination`` and within ``error`` of it
    (but for ties at the cut, which are not flagged)."""
    cut = scored.agg(F.percentile_approx(score, 1.0 - contamination, F.lit(int(1 / error)))).first()[0]
    return float("inf") if cut is None else float(cut)


def isolation_scores(points: DataFrame, features: list[str], forest: pd.DataFrame, cut: float = 0.5) -> DataFrame:
    """Adds ``if_score`` and ``if_anomaly`` (score above ``cut``, see
    ``calibrated_cut``). ``forest``: a node table (tree_id, node, feature or
    -1, split, left, right, size)."""
    bc = points.sparkSession.sparkContext.broadcast(_compiled(forest))

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([col.to_numpy(dtype=float) for col in cols])
        return pd.Series(np.power(2.0, -np.mean([_path_lengths(x, t) for t in bc.value], axis=0)))

    scored = points.withColumn("if_score", score(*[F.col(f) for f in features]))
    return scored.withColumn("if_anomaly", F.col("if_score") > F.lit(float(cut)))


# -------------------------------------------------------- reconstruction model
def fit_pca_autoencoder(vectors: DataFrame, col: str, d: int, k: int):
    """Fit the linear autoencoder: column means (d) and the top-k principal
    directions (d x k) of the centred vectors. Both are tiny."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    means = vectors.select(*[F.avg(F.element_at(col, i + 1)).alias(f"m{i}") for i in range(d)]).first()
    mu = [float(means[f"m{i}"]) for i in range(d)]
    centred = vectors.select(array_to_vector(F.transform(col, lambda x, i: x - F.element_at(
        F.array(*[F.lit(m) for m in mu]), i + 1))).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centred)
    pc = model.pc.toArray()  # d x k
    return mu, pc


def pca_reconstruction(col: str, mu: list[float], pc: np.ndarray) -> Column:
    """Array column: reconstruction mu + P P^T (x - mu), as column arithmetic."""
    d, k = pc.shape
    x = [F.element_at(col, i + 1) - F.lit(mu[i]) for i in range(d)]
    z = []
    for j in range(k):
        acc = F.lit(0.0)
        for i in range(d):
            acc = acc + F.lit(float(pc[i, j])) * x[i]
        z.append(acc)
    out = []
    for i in range(d):
        acc = F.lit(mu[i])
        for j in range(k):
            acc = acc + F.lit(float(pc[i, j])) * z[j]
        out.append(acc)
    return F.array(*out)


@dataclass(frozen=True)
class Autoencoder:
    """A fitted linear autoencoder of vectors of standardised values."""

    mean: float
    std: float
    centre: list[float]     # d
    directions: np.ndarray  # d x k


def fit_autoencoder(points: DataFrame, *, d: int = 8, k: int = 2) -> tuple[Autoencoder, DataFrame]:
    """The autoencoder and the points with their ``recent`` values, framed and
    stored once for the means, the fit and the scores."""
    stats = points.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    m, s = float(stats["m"] or 0.0), float(stats["s"] or 1.0) or 1.0
    framed = store_table(recent_values(points, d), "recent")
    full = framed.filter(F.size("recent") == d).select(
        F.transform("recent", lambda v: (v - F.lit(m)) / F.lit(s)).alias("_x"))
    return Autoencoder(m, s, *fit_pca_autoencoder(full, "_x", d, k)), framed


def reconstruction_flags(points: DataFrame, *, d: int = 8, k: int = 2,
                         threshold: float = RECONSTRUCTION_THRESHOLD,
                         model: Autoencoder | None = None) -> DataFrame:
    """Adds ``custom_loss`` and ``is_degradation`` for points with a full
    vector of the last ``d`` values (standardised with the global mean and
    standard deviation); earlier points get NULL loss and False. A given
    ``model`` is used as it is, else one is fitted on the points."""
    if model is None:
        model, framed = fit_autoencoder(points, d=d, k=k)
    else:
        d = len(model.centre)
        framed = recent_values(points, d)
    std = framed.withColumn("_x", F.transform("recent", lambda v: (v - F.lit(model.mean)) / F.lit(model.std)))
    loss = F.when(F.size("_x") == d, reconstruction_mse(
        F.col("_x"), pca_reconstruction("_x", model.centre, model.directions)))
    out = std.withColumn("custom_loss", loss)
    return (out.withColumn("is_degradation", F.coalesce(F.col("custom_loss") > F.lit(threshold),
                                                        F.lit(False)))
            .drop("_x", "recent"))


def dual_model_predictions(points: DataFrame, *, n_trees: int = 100, psi: int = 256,
                           seed: int = 42, d: int = 8, k: int = 2, forest: pd.DataFrame | None = None,
                           model: Autoencoder | None = None, threshold: float = RECONSTRUCTION_THRESHOLD,
                           producer: str = DEFAULT_PRODUCER, cut: float = 0.5) -> DataFrame:
    """Prediction events for points where either model fires: the series key
    and instance, ``timestamp``, ``seq`` and ``results`` {if_anomaly,
    custom_loss, is_degradation}. Models that are not given are fitted on the
    points; ``cut`` is the forest's (see ``calibrated_cut``)."""
    if forest is None:
        forest = fit_isolation_forest(points, ["value"], n_trees=n_trees, psi=psi, seed=seed)
    scored = reconstruction_flags(isolation_scores(points, ["value"], forest, cut), d=d, k=k, threshold=threshold,
                                  model=model)
    return (scored.filter(F.col("if_anomaly") | F.col("is_degradation"))
            .select(*SERIES_KEY, "instance_id", "timestamp", "seq", F.lit(producer).alias("producer"),
                    F.struct("if_anomaly", "custom_loss", "is_degradation").alias("results")))


def scalar_reconstruction_flags(points: DataFrame, mean: float, std: float,
                                threshold: float = RECONSTRUCTION_THRESHOLD) -> DataFrame:
    """The d = 1 case of the linear-autoencoder stand-in, for stateless
    per-point scoring (as the reference's service scores one scalar per
    call): the standardised value is reconstructed as the mean (0), so the
    loss is its square. Adds ``custom_loss`` and ``is_degradation``."""
    z = (F.col("value") - F.lit(mean)) / F.lit(std or 1.0)
    return (points.withColumn("custom_loss", z * z)
            .withColumn("is_degradation", F.col("custom_loss") > F.lit(threshold)))


def score_stream(points: DataFrame, forest: pd.DataFrame, mean: float, std: float,
                 producer: str = DEFAULT_PRODUCER) -> DataFrame:
    """Stateless scoring of a (streaming or batch) point frame with a fitted
    forest and the scalar reconstruction rule; prediction events where either
    model fires."""
    scored = scalar_reconstruction_flags(isolation_scores(points, ["value"], forest), mean, std)
    return (scored.filter(F.col("if_anomaly") | F.col("is_degradation"))
            .select(*SERIES_KEY, "instance_id", "timestamp", "seq", F.lit(producer).alias("producer"),
                    F.struct("if_anomaly", "custom_loss", "is_degradation").alias("results")))
