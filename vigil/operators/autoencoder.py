"""A small nonlinear autoencoder, trained by distributed gradient sums.

A vector of d standardised values goes through a tanh layer of m units to k
numbers, and through another tanh layer back to d values, so the points it can
return lie on a bent surface, not on a plane as with principal components. Each
step broadcasts the weights (a few hundred numbers), every task sums the
gradient over its rows in Arrow batches, and Spark adds the tasks' sums, one row
per weight; the driver sees the total gradient only and moves the weights
(Adam). Rows never leave their tasks, and a lost task is a sum done again. The
weights are a table, so a fitted model can be stored, read and scored anywhere.
Scoring is column arithmetic on the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.arrays import materialize

WEIGHTS_SCHEMA = "layer int, i int, j int, weight double"
#: Layers with tanh: into the hidden units on either side of the bottleneck.
_BENT = (True, False, True, False)


@dataclass(frozen=True)
class Network:
    """Four layers (weights: out x in, and offsets): d -> m -> k -> m -> d."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    @property
    def d(self) -> int:
        return self.layers[0][0].shape[1]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for w, b in self.layers for x in (w, b)])

    def like(self, flat: np.ndarray) -> "Network":
        """The same shape with other weights."""
        out, at = [], 0
        for w, b in self.layers:
            out.append((np.asarray(flat[at:at + w.size], float).reshape(w.shape), np.asarray(flat[at + w.size:at + w.size + b.size], float)))
            at += w.size + b.size
        return Network(tuple(out))

    @classmethod
    def start(cls, d: int, k: int, hidden: int, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        sizes = (d, hidden, k, hidden, d)
        return cls(tuple((rng.normal(0, a ** -0.5, (b, a)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per weight; column -1 holds the offsets."""
        rows = [(n, i, j - 1, float(m[i, j])) for n, (w, b) in enumerate(self.layers) for m in [np.column_stack([b, w])]
                for i in range(m.shape[0]) for j in range(m.shape[1])]
        return spark.createDataFrame(rows, WEIGHTS_SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame) -> "Network":
        found: dict[int, dict] = {}
        for r in table.collect():  # the weights
            found.setdefault(r.layer, {})[r.i, r.j] = r.weight
        layers = []
        for n in sorted(found):
            w = found[n]
            rows, cols = 1 + max(i for i, _ in w), 1 + max(j for _, j in w)
            layers.append((np.array([[w[i, j] for j in range(cols)] for i in range(rows)]), np.array([w[i, -1] for i in range(rows)])))
        return cls(tuple(layers))


def _gradient(net: Network, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Sum over rows of the gradient of the mean squared error, and of the error."""
    seen = [x]
    for (w, b), bent in zip(net.layers, _BENT, strict=True):
        z = seen[-1] @ w.T + b
        seen.append(np.tanh(z) if bent else z)
    rest = seen[-1] - x
    back, grads = 2 * rest / x.shape[1], []
    for n in range(len(net.layers) - 1, -1, -1):
        if _BENT[n]:
            back = back * (1 - seen[n + 1] ** 2)
        grads.append((back.T @ seen[n], back.sum(0)))
        back = back @ net.layers[n][0]
    return Network(tuple(reversed(grads))).flat(), float((rest * rest).sum() / x.shape[1])


def _total_gradient(vectors: DataFrame, col: str, net: Network) -> tuple[np.ndarray, float, int]:
    sent = vectors.sparkSession.sparkContext.broadcast(net)  # 2 m (d + k + 1) + k + d numbers
    d = net.d

    def run(batches):
        total, error, n = np.zeros(len(net.flat())), 0.0, 0
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                g, e = _gradient(sent.value, x)
                total, error, n = total + g, error + e, n + len(x)
        if n:
            values = np.concatenate([total, [error, n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["i", "v"])

    rows = vectors.select(col).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    sent.unpersist()
    sums = np.zeros(len(net.flat()) + 2)
    for r in rows:  # one row per weight
        sums[r.i] = r.v
    return sums[:-2], sums[-2], int(sums[-1])


def fit_network(vectors: DataFrame, col: str, d: int, k: int, *, hidden: int = 6, steps: int = 200, rate: float = 0.03,
                seed: int = 42, tolerance: float = 1e-5) -> tuple[Network, float]:
    """The network and its mean loss over the rows of ``col`` (arrays of d
    numbers, to be stored or cached by the caller). Stops early when the loss
    has not fallen by ``tolerance`` of itself in twenty steps. Without rows the
    network stays as it starts and the loss is 0."""
    net = Network.start(d, k, hidden, seed)
    flat = net.flat()
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    best, at, kept = np.inf, 0, flat
    for step in range(1, steps + 1):
        grad, error, n = _total_gradient(vectors, col, net.like(flat))
        if not n:
            return net, 0.0
        loss = error / n
        if loss < best * (1 - tolerance):
            best, at, kept = loss, step, flat
        elif step - at >= 20:
            break
        g = grad / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        flat = flat - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return net.like(kept), float(best)


def network_layer(col: str, w: np.ndarray, b: np.ndarray, bent: bool) -> Column:
    out = []
    for i in range(len(b)):
        acc = F.lit(float(b[i]))
        for j in range(w.shape[1]):
            acc = acc + F.lit(float(w[i, j])) * F.element_at(col, j + 1)
        out.append(F.tanh(acc) if bent else acc)
    return F.array(*out)


def with_reconstruction(df: DataFrame, col: str, net: Network, name: str = "reconstruction") -> DataFrame:
    """Add the reconstruction of an array of d values. Each layer is a column of
    its own behind a generator, so that none is computed twice."""
    held, last = df, col
    for n, ((w, b), bent) in enumerate(zip(net.layers, _BENT, strict=True)):
        held = materialize(held, f"_layer{n}", network_layer(last, w, b, bent))
        last = f"_layer{n}"
    return held.select(*df.columns, F.col(last).alias(name))
