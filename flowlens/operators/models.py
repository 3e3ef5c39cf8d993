"""Supervised models: a table in, a probability array out. Models are Spark ML's; so are the fits but those of several boosted
classes and of networks.

All approximate the reference's estimators: other solvers, other random numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.operators.boosting import fit_softmax_trees
from flowlens.operators.ensemble import argmax_label
from flowlens.operators.networks import fit_network
from flowlens.operators.stages import ClassProbabilities, Doubles, SequenceVector

@dataclass(frozen=True)
class Model:
    """A fitted pipeline that ends in `ClassProbabilities`: its last stage knows name, labels and feature order."""

    pipeline: PipelineModel

    @property
    def _last(self) -> ClassProbabilities:
        return self.pipeline.stages[-1]

    @property
    def name(self) -> str:
        return self._last.get("name")

    @property
    def labels(self) -> tuple:
        return tuple(self._last.get("labels"))

    @property
    def features(self) -> tuple:
        return tuple(self._last.get("features"))

    @property
    def classifier(self):
        return self.pipeline.stages[-2]

    def score(self, df: DataFrame, out: str | None = None) -> DataFrame:
        """Adds the probability array. Works on streaming tables too."""
        scored = self.pipeline.transform(df)
        return scored.withColumnRenamed(self._last.out(), out) if out else scored

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        return self.score(df).withColumn(out, argmax_label(self._last.out(), self.labels))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> Model:
        return Model(PipelineModel.load(path))


def class_index(target: str, labels: Sequence) -> Column:
    """0, 1, 2, ... in the order of the labels, as Spark ML wants."""
    return (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(target)) - 1).cast("double")


def _fit(name, train: DataFrame, features, target, labels, estimator, scaled: bool) -> Model:
    """`estimator`: Spark's, or a function from the prepared rows to a fitted model."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_features")]
    if scaled:
        stages.append(StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True))
    data = train.select(*features, class_index(target, labels).alias("_y"))
    fitted = Pipeline(stages=[Doubles(names=list(features)), *stages, *([estimator] if isinstance(estimator, Estimator) else [])]).fit(data)
    if not isinstance(estimator, Estimator):
        fitted = PipelineModel([*fitted.stages, estimator(fitted.transform(data))])
    last = ClassProbabilities(name=name, labels=[int(v) for v in labels], features=list(features))
    return Model(PipelineModel([*fitted.stages, last]))


def logistic(train, features, target, labels, c: float = 1.0, max_iter: int = 1000) -> Model:
    reg = 1.0 / (c * max(train.count(), 1))
    est = LogisticRegression(featuresCol="_scaled", labelCol="_y", regParam=reg, maxIter=max_iter,
                             standardization=False, family="multinomial" if len(labels) > 2 else "binomial")
    return _fit("logistic", train, features, target, labels, est, True)


def forest(train, features, target, labels, trees: int = 200, depth: int = 30, seed: int = 42) -> Model:
    # with the node of each row and tree kept, a level does not follow every tree from its root again
    est = RandomForestClassifier(featuresCol="_features", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed,
                                 maxMemoryInMB=512, cacheNodeIds=True)
    return _fit("forest", train, features, target, labels, est, False)


def boosted(train, features, target, labels, rounds: int = 250, depth: int = 8, rate: float = 0.05,
            subsample: float = 0.9, seed: int = 42) -> Model:
    """Binary: boosted trees. More classes: a tree per class and round on the softmax loss."""
    if len(labels) > 2:
        data = train.select(*features, class_index(target, labels).alias("_y"))
        trees = fit_softmax_trees(data, features, "_y", len(labels), rounds, depth, rate, subsample, seed=seed)
        last = ClassProbabilities(name="boosted", labels=[int(v) for v in labels], features=list(features))
        return Model(PipelineModel([trees, last]))
    est = GBTClassifier(featuresCol="_features", labelCol="_y", maxIter=rounds, maxDepth=depth, stepSize=rate,
                        subsamplingRate=subsample, seed=seed)
    return _fit("boosted", train, features, target, labels, est, False)


def dense(train, features, target, labels, hidden: Sequence[int] = (256, 128, 64), max_iter: int = 100,
          seed: int = 42) -> Model:
    def fit(data: DataFrame):
        return fit_network(data, [len(features), *hidden, len(labels)], "_scaled", "_y", max_iter, seed)

    return _fit("dense", train, features, target, labels, fit, True)


def sequence_model(windows: DataFrame, target: str, labels: Sequence, priors: Sequence[float], steps: int, width: int,
                   hidden: Sequence[int] = (128, 64), max_iter: int = 60, seed: int = 42, sequence: str = "sequence") -> Model:
    """Classifier over flattened feature sequences; rows with a short history (no sequence) get the class priors."""
    stages = [
        SequenceVector(sequence=sequence, width=steps * width),
        StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True),
    ]
    data = windows.select(sequence, class_index(target, labels).alias("_y"))
    fitted = Pipeline(stages=stages).fit(data)
    network = fit_network(fitted.transform(data), [steps * width, *hidden, len(labels)], "_scaled", "_y", max_iter, seed)
    last = ClassProbabilities(name="sequence", labels=[int(v) for v in labels], features=[sequence], guard=sequence,
                              priors=[float(p) for p in priors])
    return Model(PipelineModel([*fitted.stages, network, last]))


def stacking(calibration: DataFrame, inputs: Sequence[str], target: str, labels: Sequence, c: float = 1.0,
             max_iter: int = 1000) -> Model:
    """Logistic model over component probabilities given as columns."""
    reg = 1.0 / (c * max(calibration.count(), 1))
    est = LogisticRegression(featuresCol="_features", labelCol="_y", regParam=reg, maxIter=max_iter, standardization=False,
                             family="multinomial" if len(labels) > 2 else "binomial")
    return _fit("stacking", calibration, inputs, target, labels, est, False)


def spread_probabilities(df: DataFrame, columns: Sequence[str], classes: int) -> tuple[DataFrame, list[str]]:
    """One column for each class of each probability array."""
    names = [f"{c}_{i}" for c in columns for i in range(classes)]
    return df.withColumns({f"{c}_{i}": F.col(c)[i] for c in columns for i in range(classes)}), names


def native_importance(model: Model, spark, task: str, class_names: dict | None = None) -> DataFrame:
    """Importances of a tree model, or absolute coefficients: their mean over classes and one row per class."""
    fitted = model.classifier
    rows: list[tuple] = []
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
        rows = [(task, model.name, "aggregated", None, None, f, float(v), "native_feature_importance")
                for f, v in zip(model.features, values)]
    elif hasattr(fitted, "coefficientMatrix"):
        matrix = abs(fitted.coefficientMatrix.toArray())
        rows = [(task, model.name, "aggregated", None, None, f, float(v), "absolute_coefficient")
                for f, v in zip(model.features, matrix.mean(axis=0))]
        for i, line in enumerate(matrix):
            label = 1 if task == "binary" else int(model.labels[i])
            name = "ATTACK" if task == "binary" else (class_names or {}).get(label, str(label))
            rows += [(task, model.name, "class_specific", label, name, f, float(v), "absolute_coefficient")
                     for f, v in zip(model.features, line)]
    else:
        raise ValueError(f"{model.name} has neither importances nor coefficients")
    table = spark.createDataFrame(
        rows, "task string, model string, importance_scope string, class_label int, class_name string, "
              "feature_name string, importance double, importance_type string")
    return table.orderBy("importance_scope", F.desc("importance"), "feature_name")


def shapley(
    samples: DataFrame, background: DataFrame, features: Sequence[str], id_col: str, score, permutations: int = 12,
    seed: int = 42, max_background: int = 1000,
) -> DataFrame:
    """(id, feature_name, contribution, base_value, explained_value) by sampled feature orders.

    `score(df)` adds a column `_value`. Samples and background are the capped samples of an explanation run.
    The background travels as one array; sample, order, step and background row are unrolled by explode and
    scored in one batch. Feature orders come from hashes.
    """
    names = list(features)
    rows = background.select(*[F.col(f).cast("double").alias(f) for f in names]).limit(max_background + 1).collect()
    if not rows or len(rows) > max_background:
        raise ValueError(f"the background needs 1 to {max_background} rows")
    literal = background.sparkSession.createDataFrame([(1, [tuple(r) for r in rows])],
                                                      "_k int, _bg array<struct<" + ", ".join(f"{f}: double" for f in names) + ">>")
    base = samples.select(F.col(id_col).alias("_id"), *[F.col(f).cast("double").alias(f) for f in names], F.lit(1).alias("_k"))
    ordered = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("_perm"))
    keys = [F.struct(F.md5(F.concat_ws("-", F.col("_id").cast("string"), F.col("_perm").cast("string"), F.lit(f), F.lit(str(seed)))).alias("h"),
                     F.lit(f).alias("f")) for f in names]
    ordered = ordered.withColumn("_order", F.transform(F.sort_array(F.array(*keys)), lambda s: s["f"]))
    steps = ordered.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(names)))).alias("_step"))
    met = steps.join(F.broadcast(literal), "_k").select("*", F.explode("_bg").alias("_b")).drop("_bg", "_k")
    # the first _step features of the order come from the sample, the others from the background
    mixed = met.withColumns({
        f: F.when(F.array_position("_order", f) <= F.col("_step"), F.col(f)).otherwise(F.col(f"_b.{f}")) for f in names})
    values = score(mixed).groupBy("_id", "_perm", "_step", "_order").agg(F.avg("_value").alias("v"))
    lists = values.groupBy("_id", "_perm", "_order").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_step", "v"))), lambda s: s["v"]).alias("v"))
    gained = lists.select("_id", F.col("v")[0].alias("base_value"), F.element_at("v", -1).alias("explained_value"),
                          F.posexplode("_order").alias("_p", "feature_name"), "v").select(
        "_id", "base_value", "explained_value", "feature_name",
        (F.get("v", F.col("_p") + 1) - F.get("v", F.col("_p"))).alias("_gain"))
    return gained.groupBy(F.col("_id").alias(id_col), "feature_name").agg(
        F.avg("_gain").alias("contribution"), F.avg("base_value").alias("base_value"),
        F.avg("explained_value").alias("explained_value"))
