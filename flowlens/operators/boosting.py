"""Boosted trees on the softmax loss: every round grows one tree per class, all classes in the same passes.

1. Features become bin numbers once. Rows with the same bins have the same margins whatever the trees are, so a part of the rows is
   stored as its different bins (cells) and, per row, its cell and its class. Parts are bounded in rows.
2. A round weighs each cell with the rows of each class that the round learns from: that gives gradient and curvature of the cell.
3. A pass over the cells finds the trees' next level: tasks sum gradient and curvature per class, node, feature and bin, the sums
   meet by class, running sums over the bins give every cut its gain, and one row per class and node reaches the driver. There is a
   pass per level and round, hence jobs on stored parts that need no plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from flowlens.operators.stages import SoftmaxTrees
from flowlens.session import remove_staged, ship_package, staging_path

BINS = 32
MOST_BINS = 256
WRITTEN_EVERY = 10
LEAST_GAIN = 1e-9
PART_ROWS = 1 << 17
TASK_ROWS = 4096  # rows that are worth a task of their own
PACKED = "cells binary, cell binary, y binary, u binary, m binary"


def cut_points(train: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to `bins` - 1 cuts per feature at its quantiles; a row is left of a cut if it is smaller."""
    steps = [i / bins for i in range(1, bins)]
    found = train.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(list(features), steps, 0.2 / bins)
    return [np.unique(np.array(f, dtype="float64")) for f in found]


class Part(NamedTuple):
    """Rows that are worked on together."""

    cells: np.ndarray  # the different bins, one row each
    cell: np.ndarray  # of each row
    y: np.ndarray
    u: np.ndarray  # number of the row in the table
    margins: np.ndarray  # cells x classes

    def packed(self) -> tuple[bytes, ...]:
        return tuple(a.tobytes() for a in self)

    @staticmethod
    def unpacked(row: Row, features: int, classes: int) -> Part:
        kinds = (("uint8", features), ("int32", 0), ("int32", 0), ("int64", 0), ("float64", classes))
        arrays = [np.frombuffer(b, dtype=kind) for b, (kind, _) in zip(row, kinds, strict=True)]
        return Part(*[a.reshape(-1, width) if width else a for a, (_, width) in zip(arrays, kinds, strict=True)])


def _parts(train: DataFrame, features: Sequence[str], class_col: str, cuts: Sequence[np.ndarray], classes: int, parts: int) -> DataFrame:
    """The binned rows, `PART_ROWS` or less as one packed `Part`."""
    names = [f"f{i}" for i in range(len(features))]

    def folded(frames: Sequence[pd.DataFrame]) -> tuple[bytes, ...]:
        pdf = pd.concat(frames)
        x = pdf[names].to_numpy("float64")
        bins = np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)], axis=1).astype("uint8")
        cells, cell = np.unique(bins, axis=0, return_inverse=True)
        return Part(cells, cell.ravel().astype("int32"), pdf["y"].to_numpy("int32"), pdf["u"].to_numpy("int64"),
                    np.zeros((len(cells), classes))).packed()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, rows = [], 0
        for pdf in batches:
            for start in range(0, len(pdf), PART_ROWS):
                some = pdf.iloc[start:start + PART_ROWS]
                if rows + len(some) > PART_ROWS:
                    yield pd.DataFrame([folded(kept)], columns=Part._fields[:4] + ("m",))
                    kept, rows = [], 0
                kept.append(some)
                rows += len(some)
        if rows:
            yield pd.DataFrame([folded(kept)], columns=Part._fields[:4] + ("m",))

    plain = train.select(*[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)],
                         F.col(class_col).cast("int").alias("y"), F.monotonically_increasing_id().alias("u"))
    return plain.coalesce(parts).mapInPandas(run, PACKED)


def _chosen(row: np.ndarray, turn: int, share: float, seed: int) -> np.ndarray:
    """The rows that a round learns from, by a hash of row and round."""
    with np.errstate(over="ignore"):
        z = row.astype("uint64") + np.uint64((turn * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype("float64") / 2.0**64 < share


class Tree:
    """Nodes by number: the children of node i are 2 i + 1 and 2 i + 2. A node without a feature is a leaf."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature = np.full(size, -1, dtype="int32")
        self.bin = np.zeros(size, dtype="int32")
        self.value, self.gain = np.zeros(size), np.zeros(size)

    def reach(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at, rows = np.zeros(len(bins), dtype="int64"), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            down = 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.bin[at])
            at = np.where(f >= 0, down, at)
        return at


class Weighed(NamedTuple):
    """The cells of a part as a round sees them: gradient and curvature of the softmax loss per class, summed over the rows that it
    learns from; loss and number of all rows."""

    cells: np.ndarray
    g: np.ndarray
    h: np.ndarray
    loss: np.ndarray


def _weighed(part: Part, turn: int, share: float, seed: int) -> Weighed:
    cells, classes = part.margins.shape
    p = np.exp(part.margins - part.margins.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    place = part.cell.astype("int64") * classes + part.y

    def rows_of(places: np.ndarray) -> np.ndarray:
        return np.bincount(places, minlength=cells * classes).reshape(cells, classes)

    every, used = rows_of(place), rows_of(place[_chosen(part.u, turn, share, seed)])
    n = used.sum(axis=1)
    here = np.flatnonzero(n)
    loss = np.array([(every * -np.log(np.maximum(p, 1e-300))).sum(), every.sum()])
    n, p, used = n[here, None], p[here], used[here]
    return Weighed(part.cells[here], n * p - used, n * np.maximum(p * (1.0 - p), 1e-16), loss)


def _advanced(part: Part, trees: Sequence[Tree], depth: int) -> Part:
    margins = part.margins.copy()
    for c, tree in enumerate(trees):
        margins[:, c] += tree.value[tree.reach(part.cells, depth)]
    return part._replace(margins=margins)


def _level_sums(features: int, classes: int, bins: int, trees: Sequence[Tree], level: int) -> Callable:
    """(class, sums of gradient and curvature per node of the level, feature and bin). Class -1 has loss and rows of the round.

    A task holds 16 bytes for each of them, however many rows it reads.
    """
    first, nodes = 2**level - 1, 2**level

    def run(parts: Iterator[Weighed]) -> Iterator[tuple[int, np.ndarray]]:
        total, loss = np.zeros((classes, 2, nodes * features * bins)), np.zeros(2)
        for cells, g, h, lost in parts:
            loss += lost
            spread = np.arange(features) * bins + cells
            for c, tree in enumerate(trees):
                at = tree.reach(cells, level) - first
                here = np.flatnonzero(at >= 0)
                place = (at[here, None] * (features * bins) + spread[here]).ravel()
                for side, values in enumerate((g, h)):
                    total[c, side] += np.bincount(place, np.repeat(values[here, c], features), total.shape[2])
        if level == 0 and loss[1]:
            yield -1, loss
        for c in range(classes):
            if total[c, 1].any():
                yield c, total[c].reshape(2, nodes, features, bins)

    return run


def best_cuts(sums: np.ndarray, penalty: float, least: float) -> list[tuple]:
    """(node, g, h, gain, feature, bin, gl, hl): the cut with the greatest gain per node that has rows; ties (to nine decimals, since
    sums meet in any order) to the smaller feature, then cut. A node that no cut parts into sides of curvature `least` has the gain -1."""
    g, h = sums
    gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
    gt, ht = gl[..., -1:], hl[..., -1:]
    here = h > 0
    later = here[..., ::-1].cumsum(axis=2)[..., ::-1] > here

    def score(a, b):
        return a * a / (b + penalty)

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
    gain = np.where(here & later & (hl >= least) & (ht - hl >= least), gain, -1.0)
    best = np.round(gain, 9).reshape(len(gain), -1).argmax(axis=1)
    f, b = np.unravel_index(best, gain.shape[1:])
    n = np.arange(len(gain))
    found = zip(n, gt[n, f, 0], ht[n, f, 0], gain[n, f, b], f, b, gl[n, f, b], hl[n, f, b], strict=True)
    return [tuple(v.item() for v in r) for r in found if here[r[0]].any()]


def _grow(weighed: RDD, features: int, classes: int, bins: int, depth: int, rate: float, penalty: float, least: float):
    """The trees of a round, and the mean loss before it."""
    trees = [Tree(depth) for _ in range(classes)]
    loss = None
    for level in range(depth):
        sums = weighed.mapPartitions(_level_sums(features, classes, bins, trees, level)).reduceByKey(np.add, classes)
        cuts = sums.map(lambda s: (s[0], s[1].tolist() if s[0] < 0 else best_cuts(s[1], penalty, least))).collect()  # one row per class and node
        split = False
        for c, rows in cuts:
            if c < 0:
                loss = rows[0] / rows[1]
                continue
            for node, g, h, gain, f, b, gl, hl in rows:
                tree, at = trees[c], 2**level - 1 + node
                tree.value[at] = -rate * g / (h + penalty)
                if gain > LEAST_GAIN:
                    split = True
                    tree.feature[at], tree.bin[at], tree.gain[at] = f, b, gain
                    for child, cg, ch in ((2 * at + 1, gl, hl), (2 * at + 2, g - gl, h - hl)):
                        tree.value[child] = -rate * cg / (ch + penalty)
        if not split:
            break
    return trees, loss


def fit_softmax_trees(train: DataFrame, features: Sequence[str], class_col: str, classes: int, rounds: int = 250, depth: int = 8,
                      rate: float = 0.05, subsample: float = 0.9, penalty: float = 1.0, least: float = 1.0, bins: int = BINS,
                      seed: int = 42) -> SoftmaxTrees:
    """`class_col` holds 0, 1, ... `classes` - 1; rows where it is null are left out. Missing and not-a-number features are right of
    every cut. An empty table gives a model without trees (all classes alike). `least` is the smallest curvature of a side."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"bins must be 2 to {MOST_BINS}")
    spark = train.sparkSession
    ship_package(spark)
    known = train.where(F.col(class_col).isNotNull())
    cuts = cut_points(known, features, bins)
    width, cores = len(features), spark.sparkContext.defaultParallelism
    rows = known.count()
    parts = max(1, min(cores, math.ceil(rows / TASK_ROWS)), math.ceil(rows / PART_ROWS))
    path, state = _written(_parts(known, features, class_col, cuts, classes, parts), parts, width, classes)
    grown, losses, stored = [], [], [state]
    for turn in range(rounds):
        weighed = state.map(lambda part, turn=turn: _weighed(part, turn, subsample, seed)).persist(StorageLevel.MEMORY_AND_DISK)
        trees, loss = _grow(weighed, width, classes, bins, depth, rate, penalty, least)
        weighed.unpersist()
        if loss is None:
            break
        losses.append(loss)
        grown.append(trees)
        if turn + 1 == rounds:
            break
        # the parts before are read once more, when the next round asks for these
        for old in stored[:-1]:
            old.unpersist()
        state = state.map(lambda part, trees=trees: _advanced(part, trees, depth)).persist(StorageLevel.MEMORY_AND_DISK)
        stored = [stored[-1], state]
        if (turn + 1) % WRITTEN_EVERY == 0:
            before = path
            path, state = _written(_frame(spark, state), parts, width, classes)
            for old in stored:
                old.unpersist()
            remove_staged(spark, before)
            stored = [state]
    for old in stored:
        old.unpersist()
    remove_staged(spark, path)
    stage = SoftmaxTrees(names=list(features), classes=classes, depth=depth, losses=losses)
    stage.nodes = _nodes(grown, cuts)
    return stage


def _frame(spark: SparkSession, state: RDD) -> DataFrame:
    return spark.createDataFrame(state.map(lambda part: part.packed()), PACKED)


def _written(df: DataFrame, parts: int, features: int, classes: int) -> tuple[str, RDD]:
    """The packed parts as files, and as they are read back: the lineage of the rounds starts there."""
    spark, path = df.sparkSession, staging_path(df.sparkSession, "boosting")
    df.write.parquet(path)
    read = spark.read.parquet(path).repartition(parts).rdd.map(lambda row: Part.unpacked(row, features, classes))
    return path, read.persist(StorageLevel.MEMORY_AND_DISK)


def _nodes(grown: Sequence[Sequence[Tree]], cuts: Sequence[np.ndarray]) -> pd.DataFrame:
    """The nodes that rows can reach: round, class, node, feature (-1: leaf), threshold, value, gain."""
    parts = []
    for turn, trees in enumerate(grown):
        for c, tree in enumerate(trees):
            inner = np.flatnonzero(tree.feature >= 0)
            at = np.unique(np.concatenate([[0], inner, 2 * inner + 1, 2 * inner + 2]))
            f = tree.feature[at]
            threshold = [float(cuts[i][b]) if i >= 0 else 0.0 for i, b in zip(f, tree.bin[at], strict=True)]
            parts.append(pd.DataFrame({"round": turn, "class": c, "node": at, "feature": f, "threshold": threshold,
                                       "value": tree.value[at], "gain": tree.gain[at]}))
    empty = pd.DataFrame({"round": [0], "class": [0], "node": [0], "feature": [-1], "threshold": [0.0], "value": [0.0], "gain": [0.0]})
    return pd.concat(parts, ignore_index=True) if parts else empty
