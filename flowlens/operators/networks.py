"""Training of networks with sigmoid layers and a softmax at the end, the ones of Spark's perceptron, on the mean loss of all rows.

Rows are packed into blocks once. A pass over the blocks gives the mean loss and its gradient, where every row weighs the same however
the rows lie in parts; tasks send one array as long as the weights. The driver moves the weights by limited-memory BFGS. The result is a
model of Spark ML, which scores, is saved and is loaded as such.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from flowlens.session import ship_package

BLOCK_ROWS = 4096
FEW_PARTS = 64  # whose sums the driver adds up itself
MEMORY, TOLERANCE, LOOK_BACK = 10, 1e-6, 10
ENOUGH, FLAT, MOST_STEPS = 1e-4, 0.9, 10  # of a line search


def _layers(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the matrix (inputs x outputs) and the intercepts of each layer, in the order of Spark's weight vector."""
    out, at = [], 0
    for n, m in itertools.pairwise(layers):
        out.append((weights[at:at + n * m].reshape(n, m), weights[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def loss_sums(weights: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows, summed loss, and its gradient, as one array."""
    steps, seen = _layers(weights, layers), [x]
    for i, (w, b) in enumerate(steps):
        z = seen[-1] @ w
        z += b
        if i < len(steps) - 1:
            z = 1.0 / (1.0 + np.exp(-np.clip(z, -500.0, 500.0)))
        seen.append(z)
    z = seen.pop()
    z -= z.max(axis=1, keepdims=True)
    rows, exp = np.arange(len(y)), np.exp(z)
    total = exp.sum(axis=1)
    out = np.zeros(2 + len(weights))
    out[0], out[1] = len(y), (np.log(total) - z[rows, y]).sum()
    back = exp / total[:, None]
    back[rows, y] -= 1.0
    for (w, _), (gw, gb), a in zip(reversed(steps), reversed(_layers(out[2:], layers)), reversed(seen), strict=True):
        gw += a.T @ back
        gb += back.sum(axis=0)
        if a is not x:
            back = back @ w.T
            back *= a * (1.0 - a)
    return out


def _blocks(data: DataFrame, width: int, classes: int, features: str, target: str) -> RDD:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                x, y = some.column(0).flatten().to_numpy(zero_copy_only=False), some.column(1).to_numpy(zero_copy_only=False)
                if not np.isin(y, np.arange(classes)).all():
                    raise ValueError("a row's class is not among the labels")
                yield pa.RecordBatch.from_pydict({"x": [x.astype("float64").tobytes()], "y": [y.astype("int64").tobytes()]})

    def unpacked(row: Row) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row[0]).reshape(-1, width), np.frombuffer(row[1], dtype="int64")

    packed = data.select(vector_to_array(features).alias("x"), F.col(target).alias("y")).mapInArrow(run, "x binary, y binary")
    cores = data.sparkSession.sparkContext.defaultParallelism
    if data.rdd.getNumPartitions() < cores:
        packed = packed.repartition(cores)
    return packed.rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)


def _mean_loss(blocks: RDD, layers: Sequence[int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    shared = blocks.context.broadcast(weights)

    def run(part: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        total = np.zeros(2 + len(shared.value))
        for x, y in part:
            total += loss_sums(shared.value, layers, x, y)
        yield total

    sums = blocks.mapPartitions(run)
    found = sums.reduce(np.add) if sums.getNumPartitions() <= FEW_PARTS else sums.treeReduce(np.add)
    shared.destroy()
    if not found[0]:
        raise ValueError("no rows to learn from")
    return found[1] / found[0], found[2:] / found[0]


Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def _line(loss: Loss, x: np.ndarray, f: float, g: np.ndarray, way: np.ndarray, step: float):
    """The first point on the way that lowers the loss enough and is flat enough (the conditions of Wolfe); else the lowest seen, or None."""
    slope = float(g @ way)
    low, high = (0.0, f, slope), None
    best = None
    for _ in range(MOST_STEPS):
        value, gradient = loss(x + step * way)
        here = float(gradient @ way)
        if np.isfinite(value) and value < f and (best is None or value < best[1]):
            best = (x + step * way, value, gradient)
        if not np.isfinite(value) or value > f + ENOUGH * step * slope or value >= low[1] and low[0] > 0:
            high = (step, value, here)
        elif abs(here) <= -FLAT * slope:
            return x + step * way, value, gradient
        else:
            if here * ((high[0] if high else np.inf) - low[0]) >= 0:
                high = low
            low = (step, value, here)
        if high is None:
            step *= 2.0
            continue
        # the lowest point of the parabola through the low end, kept off the ends
        width = high[0] - low[0]
        curve = high[1] - low[1] - low[2] * width
        at = -low[2] * width / (2.0 * curve) if np.isfinite(curve) and curve > 0 else 0.5
        step = low[0] + min(max(at, 0.1), 0.9) * width
    return best


def minimize(loss: Loss, x: np.ndarray, max_iter: int) -> np.ndarray:
    """Limited-memory BFGS; ends as Spark's does: after `max_iter` steps, or where gradient or loss no longer move."""
    f, g = loss(x)
    first, losses = abs(f), deque([f], maxlen=LOOK_BACK)
    pairs: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=MEMORY)
    for _ in range(max_iter):
        if np.linalg.norm(g) <= max(TOLERANCE * abs(f), 1e-8):
            break
        way, shares = -g, []
        for s, d, r in reversed(pairs):
            shares.append(r * (s @ way))
            way = way - shares[-1] * d
        if pairs:
            s, d, r = pairs[-1]
            way = way / (r * (d @ d))
        for (s, d, r), a in zip(pairs, reversed(shares), strict=True):
            way = way + (a - r * (d @ way)) * s
        found = _line(loss, x, f, g, way, 1.0 if pairs else 1.0 / np.linalg.norm(way))
        if found is None:
            if not pairs:
                break
            pairs.clear()  # once more along the gradient
            continue
        step, change = found[0] - x, found[2] - g
        x, f, g = found
        if step @ change > 1e-16 * (change @ change):
            pairs.append((step, change, 1.0 / (step @ change)))
        if len(losses) == LOOK_BACK and abs(f - max(losses)) <= TOLERANCE * first:
            break
        losses.append(f)
    return x


def _of_weights(spark: SparkSession, layers: Sequence[int], features: str, target: str, seed: int,
                weights: np.ndarray | None = None) -> MultilayerPerceptronClassificationModel:
    """Spark's model with these weights, or with the ones that its training starts from: no step is taken."""
    given = {} if weights is None else {"initialWeights": Vectors.dense(weights)}
    est = MultilayerPerceptronClassifier(featuresCol=features, labelCol=target, seed=seed, maxIter=0, layers=list(layers), **given)
    return est.fit(spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], [features, target]))


def fit_network(data: DataFrame, layers: Sequence[int], features: str, target: str, max_iter: int, seed: int) -> MultilayerPerceptronClassificationModel:
    """`target` holds 0, 1, ...; `layers` begins with the number of features and ends with the number of classes."""
    spark, layers = data.sparkSession, [int(n) for n in layers]
    ship_package(spark)
    start = _of_weights(spark, layers, features, target, seed).weights.toArray()
    blocks = _blocks(data, layers[0], layers[-1], features, target)
    try:
        weights = minimize(lambda w: _mean_loss(blocks, layers, w), start, max_iter)
    finally:
        blocks.unpersist()
    return _of_weights(spark, layers, features, target, seed, weights)
