"""Pipeline stages of models and detectors that are saved and loaded with their pipeline.

A saved pipeline holds all that scoring needs: feature order, labels, class priors, name, thresholds. `PipelineModel.load` in a new
session gives the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame, functions as F, types as T

from flowlens.operators.anomaly_scores import to_probability
from flowlens.session import ship_package

INTERNAL = ("_features", "_scaled", "rawPrediction", "probability", "prediction", "_x", "_v", "_z", "_score")
NUMBERS = ("int", "bigint", "smallint", "tinyint", "float")
MOST_CUTS = 1 << 14  # of a feature, more than any has
MOST_CELLS = 1 << 16  # that a task keeps the margins of


def _param(name: str, converter) -> Param:
    return Param(Params._dummy(), name, name, converter)


class Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose settings are its params: given by name, read back by name."""

    def __init__(self, **given):
        super().__init__()
        self._set(**given)

    def get(self, name: str):
        return self.getOrDefault(name)

    def has(self, name: str) -> bool:
        return self.isDefined(name)


class Doubles(Stage):
    """Casts whole-number and float features to double."""

    names = _param("names", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        wrong = [f.name for f in df.schema if f.name in self.get("names") and f.dataType.simpleString() in NUMBERS]
        return df.withColumns({c: F.col(c).cast("double") for c in wrong}) if wrong else df


class Standardized(Stage):
    """The features, less their mean and over their deviation, as one array."""

    names = _param("names", TypeConverters.toListString)
    means = _param("means", TypeConverters.toListFloat)
    deviations = _param("deviations", TypeConverters.toListFloat)
    out = _param("out", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        cells = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                 for c, m, s in zip(*(self.get(p) for p in ("names", "means", "deviations")), strict=True)]
        return df.withColumn(self.get("out"), F.array(*cells))


def standardized(names: Sequence[str], scaler: dict[str, tuple[float, float]], out: str = "_x") -> Standardized:
    return Standardized(names=list(names), means=[scaler[c][0] for c in names], deviations=[scaler[c][1] for c in names], out=out)


class SequenceVector(Stage):
    """A sequence of feature arrays as one vector; zeros where a row has no full sequence."""

    sequence = _param("sequence", TypeConverters.toString)
    width = _param("width", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        flat = F.coalesce(F.flatten(self.get("sequence")), F.array_repeat(F.lit(0.0), self.get("width")))
        return df.withColumn("_features", array_to_vector(flat))


class ClassProbabilities(Stage):
    """The probability array of a fitted classifier and nothing else of it; last stage of every model.

    `labels[i]` is the class of probability i. Where the column `guard` is null, the row gets `priors`.
    """

    name = _param("name", TypeConverters.toString)
    labels = _param("labels", TypeConverters.toListInt)
    features = _param("features", TypeConverters.toListString)
    priors = _param("priors", TypeConverters.toListFloat)
    guard = _param("guard", TypeConverters.toString)
    settings = _param("settings", TypeConverters.toString)

    def out(self) -> str:
        return f"p_{self.get('name')}"

    def _transform(self, df: DataFrame) -> DataFrame:
        if "probability" in df.columns:
            made = vector_to_array("probability")
        else:
            raw = vector_to_array("rawPrediction")
            weights = F.transform(raw, lambda r: F.exp(r - F.array_max(raw)))
            total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
            made = F.transform(weights, lambda w: w / total)
        if self.has("guard"):
            priors = F.array(*[F.lit(p) for p in self.get("priors")])
            made = F.when(F.col(self.get("guard")).isNull(), priors).otherwise(made)
        return df.withColumn(self.out(), made).drop(*INTERNAL)


class ReconstructionError(Stage):
    """Mean squared part of the standardized row that the leading components (`_z` of `_v`) leave: they are orthonormal."""

    width = _param("width", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        def squares(v):
            return F.aggregate(vector_to_array(v), F.lit(0.0), lambda a, x: a + x * x)

        return df.withColumn("_score", F.greatest((squares("_v") - squares("_z")) / float(self.get("width")), F.lit(0.0)))


class AsVector(Stage):
    """The array `_x` as the vector `_v`."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_v", array_to_vector("_x"))


class BoundaryScore(Stage):
    """Distance below a linear boundary on random cosine features of the array `_x`."""

    turn = _param("turn", TypeConverters.toListFloat)  # features x width, row by row
    phase = _param("phase", TypeConverters.toListFloat)
    normal = _param("normal", TypeConverters.toListFloat)
    offset = _param("offset", TypeConverters.toFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        phase, normal, offset = np.array(self.get("phase")), np.array(self.get("normal")), self.get("offset")
        turn = np.array(self.get("turn")).reshape(-1, len(phase))

        @F.pandas_udf(T.DoubleType())
        def score(vectors: pd.Series) -> pd.Series:
            return pd.Series(offset - lift(np.stack(vectors.to_numpy()), turn, phase) @ normal)

        ship_package(df.sparkSession)
        return df.withColumn("_score", score("_x"))


def lift(x: np.ndarray, turn: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random cosine features of a Gaussian kernel."""
    return np.sqrt(2.0 / len(phase)) * np.cos(x @ turn + phase)


class _ForestWriter(MLWriter):
    def __init__(self, stage: Stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.sparkSession.createDataFrame(self.stage.nodes).coalesce(1).write.parquet(f"{path}/nodes")


class _ForestReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Stage:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(stage, meta)
        stage.nodes = self.sparkSession.read.parquet(f"{path}/nodes").toPandas()  # trees x rows at most
        return stage


class IsolationScore(Stage):
    """Score of an isolation forest on the array `_x`. The nodes, one row each, are a table beside the params."""

    limit = _param("limit", TypeConverters.toInt)
    norm = _param("norm", TypeConverters.toFloat)
    nodes: pd.DataFrame | None = None  # tree, node, feature, threshold, left, right, path

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)

    def _transform(self, df: DataFrame) -> DataFrame:
        forest = [t.sort_values("node") for _, t in self.nodes.groupby("tree")]
        packed = df.sparkSession.sparkContext.broadcast([
            tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")) for t in forest])
        limit, norm = self.get("limit"), self.get("norm")

        @F.pandas_udf(T.DoubleType())
        def score(vectors: pd.Series) -> pd.Series:
            x = np.stack(vectors.to_numpy())
            depth = np.zeros(len(x))
            for feature, threshold, left, right, path in packed.value:
                at = np.zeros(len(x), dtype="int64")
                for _ in range(limit):
                    f = feature[at]
                    goes = x[np.arange(len(x)), np.maximum(f, 0)] < threshold[at]
                    at = np.where(f >= 0, np.where(goes, left[at], right[at]), at)
                depth += path[at]
            return pd.Series(np.power(2.0, -depth / len(packed.value) / norm))

        return df.withColumn("_score", score("_x"))


class SoftmaxTrees(Stage):
    """Margins of boosted trees, one tree per class and round, as `rawPrediction`. The nodes are a table beside the params."""

    names = _param("names", TypeConverters.toListString)
    classes = _param("classes", TypeConverters.toInt)
    depth = _param("depth", TypeConverters.toInt)
    losses = _param("losses", TypeConverters.toListFloat)  # mean loss of the training rows before each round
    nodes: pd.DataFrame | None = None  # round, class, node, feature, threshold, value, gain

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)

    @property
    def featureImportances(self) -> DenseVector:
        """The gains of a feature's cuts, as a share of all."""
        inner = self.nodes[self.nodes["feature"] >= 0]
        gains = np.bincount(inner["feature"], inner["gain"], len(self.get("names")))
        return DenseVector(gains / gains.sum() if len(inner) else gains)

    def _tables(self) -> tuple[list[np.ndarray], list[tuple]]:
        """The cuts of each feature, and per tree its class and per node the feature, the number of its cut, the left child and the
        value. Children lie side by side; a leaf is its own left child and no row goes right there."""
        nodes = self.nodes.sort_values(["round", "class", "node"])
        inner = nodes[nodes["feature"] >= 0]
        cuts = [np.unique(inner["threshold"].to_numpy()[inner["feature"].to_numpy() == f]) for f in range(len(self.get("names")))]
        trees = []
        for (_, c), t in nodes.groupby(["round", "class"]):
            node, feature, threshold = (t[n].to_numpy() for n in ("node", "feature", "threshold"))
            leaf = feature < 0
            at = np.array([0 if f < 0 else np.searchsorted(cuts[f], v) for f, v in zip(feature, threshold, strict=True)], dtype="int64")
            child = np.where(leaf, np.arange(len(node)), np.searchsorted(node, 2 * node + 1))
            trees.append((c, np.maximum(feature, 0), np.where(leaf, MOST_CUTS, at), child, t["value"].to_numpy()))
        return cuts, trees

    def _transform(self, df: DataFrame) -> DataFrame:
        classes, depth = self.get("classes"), self.get("depth")
        packed = df.sparkSession.sparkContext.broadcast(self._tables())

        def grown(cells: np.ndarray) -> np.ndarray:
            out, rows = np.zeros((len(cells), classes)), np.arange(len(cells))
            for c, feature, cut, child, value in packed.value[1]:
                at = np.zeros(len(cells), dtype="int64")
                for _ in range(depth):
                    at = child[at] + (cells[rows, feature[at]] > cut[at])
                out[:, c] += value[at]
            return out

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[bytes, np.ndarray] = {}  # rows between the same cuts go the same ways: a task follows the trees once for them
            for vectors in batches:
                if not len(vectors):
                    yield pd.Series([], dtype=object)
                    continue
                x = np.stack(vectors.to_numpy())
                # the number of cuts that are not greater; what is no number is right of every cut
                bins = np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(packed.value[0])], axis=1).astype("int16")
                cells, cell = np.unique(bins, axis=0, return_inverse=True)
                names = [r.tobytes() for r in cells]
                new = [i for i, n in enumerate(names) if n not in known]
                found = dict(zip((names[i] for i in new), grown(cells[new]), strict=True)) if new else {}
                out = np.stack([known[n] if n in known else found[n] for n in names])
                known = known | found if len(known) + len(found) <= MOST_CELLS else found
                yield pd.Series(list(out[cell.ravel()]))

        ship_package(df.sparkSession)
        cells = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.get("names")])
        return df.withColumn("rawPrediction", array_to_vector(margins(cells)))


class AttackProbability(Stage):
    """A detector's score as two class probabilities: logistic in deviations from its threshold."""

    name = _param("name", TypeConverters.toString)
    features = _param("features", TypeConverters.toListString)
    threshold = _param("threshold", TypeConverters.toFloat)
    deviation = _param("deviation", TypeConverters.toFloat)
    settings = _param("settings", TypeConverters.toString)

    def out(self) -> str:
        return f"p_{self.get('name')}"

    def _transform(self, df: DataFrame) -> DataFrame:
        attack = to_probability("_score", self.get("threshold"), self.get("deviation"))
        return df.withColumn(self.out(), F.array(1.0 - attack, attack)).drop(*INTERNAL)


class _DensityWriter(MLWriter):
    def __init__(self, stage: NeighbourDensity):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.rows.write.parquet(f"{path}/rows")
        self.stage.densities.write.parquet(f"{path}/densities")


class _DensityReader(MLReader):
    def load(self, path: str) -> NeighbourDensity:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = NeighbourDensity()
        stage._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(stage, meta)
        stage.rows = self.sparkSession.read.parquet(f"{path}/rows")
        stage.densities = self.sparkSession.read.parquet(f"{path}/densities")
        return stage


class NeighbourDensity(Stage):
    """Local outlier factor of the array `_x` against stored training rows and their densities.

    Rows meet the training rows in a distributed search, so a table that streams is scored micro-batch by micro-batch.
    """

    neighbors = _param("neighbors", TypeConverters.toInt)
    rowId = _param("rowId", TypeConverters.toString)
    rows: DataFrame | None = None  # id, _x
    densities: DataFrame | None = None  # neighbor, kd, lrd

    def write(self) -> MLWriter:
        return _DensityWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _DensityReader()

    def _transform(self, df: DataFrame) -> DataFrame:
        from flowlens.operators.neighbors import knn_join

        row_id = self.get("rowId")
        asked = df.select(F.col(row_id).alias("id"), "_x")
        found = knn_join(self.rows, self.get("neighbors"), "id", "_x", queries=asked, exclude_self=False)
        reach = F.greatest("distance", "kd")
        scores = found.join(self.densities, "neighbor").groupBy("id").agg(
            (F.avg("lrd") * (F.avg(reach) + F.lit(1e-10))).alias("_score"))
        return df.join(scores, F.col(row_id) == F.col("id"), "left").drop("id")
