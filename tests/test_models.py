"""Models and detectors against what their definitions say: optimality, closed forms, brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from flowlens.operators import anomaly, models, networks, selection
from flowlens.operators.stages import IsolationScore, lift

NAMES = ("a", "b", "c")


def numbers(seed, n=300, classes=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, -1.0]
    y = (x[:, 0] + rng.normal(size=n) * 0.7 > 0).astype(int) + (classes - 2) * (x[:, 1] > 4)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    def make(seed, **kw):
        x, y = numbers(seed, **kw)
        rows = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
        return x, y, spark.createDataFrame(rows, "row_id long, a double, b double, c double, label int").repartition(3)

    return make


def arrays(df, column):
    return np.array([r[1] for r in df.select("row_id", column).orderBy("row_id").collect()])


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_is_at_the_optimum(table, classes):
    """The gradient of the penalized loss vanishes: mean of (p - y) x plus the penalty's share."""
    x, y, df = table(1, classes=classes)
    labels = list(range(classes))
    model = models.logistic(df, NAMES, "label", labels, c=2.0)
    p = arrays(model.score(df), "p_logistic")
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    hit = np.eye(classes)[y]
    w = model.classifier.coefficientMatrix.toArray()
    reg = 1.0 / (2.0 * len(x))
    if classes == 2:
        gradient = ((p - hit)[:, 1:].T @ z) / len(x) + reg * w
    else:
        gradient = ((p - hit).T @ z) / len(x) + reg * w
    assert np.abs(gradient).max() < 1e-4 and np.abs((p - hit).mean(axis=0)).max() < 1e-4
    assert np.allclose(p.sum(axis=1), 1)


def test_stacking_is_at_the_optimum(table):
    x, y, df = table(2)
    model = models.stacking(df, NAMES, "label", (0, 1))
    p = arrays(model.score(df), "p_stacking")
    gradient = ((p[:, 1] - y) @ x) / len(x) + model.classifier.coefficientMatrix.toArray()[0] / len(x)
    assert np.abs(gradient).max() < 1e-3


def test_forest_and_boosting_follow_their_trees(table):
    """Probabilities of the forest are the mean of its trees'; boosting is the weighted sum through the logistic function."""
    _, _, df = table(3)
    forest = models.forest(df, NAMES, "label", (0, 1), trees=5, depth=4)
    p = arrays(forest.score(df), "p_forest")
    rows = df.orderBy("row_id").collect()
    from pyspark.ml.linalg import Vectors

    vectors = [Vectors.dense([r[c] for c in NAMES]) for r in rows]
    per = np.mean([[t.predictProbability(v).toArray() for v in vectors] for t in forest.classifier.trees], axis=0)
    assert np.allclose(p, per)
    boosted = models.boosted(df, NAMES, "label", (0, 1), rounds=4, depth=3, rate=0.3)
    q = arrays(boosted.score(df), "p_boosted")
    fitted = boosted.classifier
    total = sum(w * np.array([t.predict(v) for v in vectors]) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True))
    assert np.allclose(q[:, 1], 1 / (1 + np.exp(-2 * total)))


def test_dense_network_forward_pass(table):
    """Probabilities are those of the weights: sigmoid layers, softmax at the end, on standardized features."""
    x, _, df = table(4)
    model = models.dense(df, NAMES, "label", (0, 1), hidden=(4, 3), max_iter=30)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    weights, at, layers = model.classifier.weights.toArray(), 0, [3, 4, 3, 2]
    for i, (n, m) in enumerate(itertools.pairwise(layers)):
        w = weights[at:at + n * m].reshape(m, n, order="F")
        b = weights[at + n * m:at + n * m + m]
        at += n * m + m
        z = z @ w.T + b
        z = 1 / (1 + np.exp(-z)) if i < len(layers) - 2 else np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(arrays(model.score(df), "p_dense"), z / z.sum(axis=1, keepdims=True))


def test_network_gradient_and_layouts(table):
    """The gradient is the slope of the loss; a fit does not depend on how rows lie in parts and gets as low as Spark's own."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    rng = np.random.default_rng(11)
    layers, x, y = [3, 4, 2], rng.normal(size=(7, 3)), np.arange(7) % 2
    w = rng.normal(size=3 * 4 + 4 + 4 * 2 + 2)
    rows, _, *slope = networks.loss_sums(w, layers, x, y)
    step = 1e-6 * np.eye(len(w))
    want = [(networks.loss_sums(w + d, layers, x, y)[1] - networks.loss_sums(w - d, layers, x, y)[1]) / 2e-6 for d in step]
    assert rows == 7 and np.allclose(slope, want, atol=1e-6)

    x, y, df = table(4)
    parts = [df.coalesce(1), df.repartition(7, "a"), df.repartition(3)]
    made = [models.dense(d, NAMES, "label", (0, 1), hidden=(4, 3), max_iter=10) for d in parts]
    found = [m.classifier.weights.toArray() for m in made]
    assert np.allclose(found[0], found[1], atol=1e-6) and np.allclose(found[0], found[2], atol=1e-6)

    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    ours = models.dense(df, NAMES, "label", (0, 1), hidden=(4, 3), max_iter=60)
    spark_fit = MultilayerPerceptronClassifier(featuresCol="_scaled", labelCol="_y", seed=42, maxIter=60, layers=[3, 4, 3, 2]).fit(
        PipelineModel(ours.pipeline.stages[:-2]).transform(df.coalesce(1).withColumn("_y", F.col("label").cast("double"))))
    low = [networks.loss_sums(m.weights.toArray(), [3, 4, 3, 2], z, y)[1] for m in (ours.classifier, spark_fit)]
    assert low[0] <= 1.1 * low[1] + 1e-3


def test_sequence_model_falls_back_to_priors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [[float(v) for v in rng.normal(size=2) + i % 2] for _ in range(3)] if i % 4 else None, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, sequence array<array<double>>, label int")
    model = models.sequence_model(df.where("sequence is not null"), "label", (0, 1), (0.25, 0.75), 3, 2, hidden=(4,), max_iter=20)
    got = {r["row_id"]: r["p_sequence"] for r in model.score(df).collect()}
    assert all(got[i] == [0.25, 0.75] for i in range(0, 80, 4))
    hits = [got[i][1] > 0.5 for i in range(80) if i % 4 and i % 2]
    assert sum(hits) > 0.7 * len(hits)


def test_native_importance_of_a_linear_model(spark, table):
    _, _, df = table(6, classes=3)
    model = models.logistic(df, NAMES, "label", (0, 1, 2), max_iter=50)
    found = models.native_importance(model, spark, "multiclass", {0: "x", 1: "y", 2: "z"}).collect()
    w = np.abs(model.classifier.coefficientMatrix.toArray())
    mean = {r["feature_name"]: r["importance"] for r in found if r["importance_scope"] == "aggregated"}
    assert np.allclose([mean[f] for f in NAMES], w.mean(axis=0))
    own = {(r["class_label"], r["feature_name"]): r["importance"] for r in found if r["importance_scope"] == "class_specific"}
    assert all(math.isclose(own[k, f], w[k, i]) for k in range(3) for i, f in enumerate(NAMES))
    trees = models.forest(df, NAMES, "label", (0, 1, 2), trees=3, depth=3)
    parts = models.native_importance(trees, spark, "multiclass").collect()
    assert math.isclose(sum(r["importance"] for r in parts), 1.0)


def test_contributions_sum_to_the_difference(spark, table):
    """Contributions of a row add up to its value less the background's; of an additive function they are its parts."""
    x, _, df = table(7, n=40)

    def value(rows):
        return rows.withColumn("_value", 2 * F.col("a") - F.col("b") + F.col("c") * F.col("c"))

    samples, ground = df.where("row_id < 5").drop("label"), df.where("row_id >= 20").drop("label")
    found = models.shapley(samples, ground, NAMES, "row_id", value, permutations=4).collect()
    back = x[20:]
    for i in range(5):
        mine = {r["feature_name"]: r for r in found if r["row_id"] == i}
        want = {"a": 2 * (x[i, 0] - back[:, 0].mean()), "b": back[:, 1].mean() - x[i, 1], "c": x[i, 2] ** 2 - (back[:, 2] ** 2).mean()}
        assert all(math.isclose(mine[f]["contribution"], want[f], abs_tol=1e-9) for f in NAMES)
        assert math.isclose(sum(r["contribution"] for r in mine.values()),
                            mine["a"]["explained_value"] - mine["a"]["base_value"], abs_tol=1e-9)


def test_contributions_with_all_orders(spark, table):
    """With many orders the contributions of a product come near the exact ones over all six orders."""
    x, _, df = table(8, n=12)

    def value(rows):
        return rows.withColumn("_value", F.col("a") * F.col("b") * F.col("c"))

    ground = df.where("row_id >= 10").drop("label")
    found = {r["feature_name"]: r["contribution"] for r in models.shapley(
        df.where("row_id = 0").drop("label"), ground, NAMES, "row_id", value, permutations=400).collect()}

    def mean(own):
        return np.mean([np.prod([x[0, j] if j in own else r[j] for j in range(3)]) for r in x[10:]])

    exact = dict.fromkeys(range(3), 0.0)
    for order in itertools.permutations(range(3)):
        for k, j in enumerate(order):
            exact[j] += (mean(order[:k + 1]) - mean(order[:k])) / 6
    scale = max(abs(v) for v in exact.values())
    assert all(abs(found[f] - exact[j]) < 0.15 * scale for j, f in enumerate(NAMES))


def test_principal_components_against_eigenvalues(spark, table):
    x, _, df = table(9)
    found = selection.principal_components(df.withColumn("d", F.col("a") + F.col("b") / 10), (*NAMES, "d")).collect()
    wide = np.column_stack([x, x[:, 0] + x[:, 1] / 10])
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(wide.T)))[::-1]
    assert np.allclose([r["variance_ratio"] for r in found], values / values.sum(), atol=1e-8)
    before = np.concatenate([[0], np.cumsum(values / values.sum())[:-1]])
    assert [r["needed"] for r in found] == (before < 0.95).tolist()


def test_reconstruction_against_a_decomposition(table):
    """What the leading components leave of a standardized row."""
    x, _, df = table(10)
    got = arrays(anomaly.reconstruction(df, NAMES, 2)(df), "score")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, vectors = np.linalg.eigh(np.cov(z.T))
    rest = z @ vectors[:, :1]
    assert np.allclose(got, (rest ** 2).sum(axis=1) / 3, atol=1e-8)


def test_elimination_keeps_what_tells(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 300)
    columns = {"tells": y + 0.1 * rng.normal(size=300), "half": y + 2.0 * rng.normal(size=300), **{
        f"n{i}": rng.normal(size=300) for i in range(4)}}
    df = spark.createDataFrame(pd.DataFrame(columns | {"c": y}))
    found = {r["feature"]: (r["ranking"], r["selected"]) for r in selection.eliminate(df, list(columns), "c", keep=2).collect()}
    assert found["tells"] == (1, True) and sum(s for _, s in found.values()) == 2
    assert sorted(r for r, _ in found.values()) == [1, 1, 2, 3, 4, 5]


def test_path_lengths_of_given_trees(spark):
    """Scores follow from the depth of the leaf and the rows left there."""
    stage = IsolationScore(limit=8, norm=anomaly._mean_path(256))
    stage.nodes = pd.DataFrame(
        [(0, 0, 0, 1.0, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 1 + anomaly._mean_path(5)), (0, 2, 1, 0.0, 3, 4, 0.0),
         (0, 3, -1, 0.0, -1, -1, 2.0), (0, 4, -1, 0.0, -1, -1, 2 + anomaly._mean_path(2)), (1, 0, -1, 0.0, -1, -1, 3.0)],
        columns=["tree", "node", "feature", "threshold", "left", "right", "path"])
    df = spark.createDataFrame([(0, [0.5, 9.0]), (1, [1.0, -1.0]), (2, [2.0, 0.0])], "row_id long, _x array<double>")
    got = arrays(stage.transform(df), "_score")
    depth = np.array([1 + 2 * (math.log(4) + np.euler_gamma) - 8 / 5, 2.0, 3.0])
    assert np.allclose(got, 2.0 ** (-(depth + 3.0) / 2 / anomaly._mean_path(256)))


def test_grown_trees_separate_their_rows():
    """Every row of a sample reaches a leaf; an outlier gets there sooner than the rest."""
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(size=(60, 2)), [[40.0, 40.0]]])
    depths = []
    for seed in range(50):
        nodes = {n[0]: n for n in anomaly._grow(x, np.random.default_rng(seed), 8)}
        paths = []
        for row in x:
            node = nodes[0]
            while node[1] >= 0:
                node = nodes[node[3] if row[node[1]] < node[2] else node[4]]
            paths.append(node[5])
        depths.append(paths)
    mean = np.mean(depths, axis=0)
    assert mean[-1] == mean.min() and mean[-1] < mean[:-1].mean() - 2


def test_one_class_boundary_against_a_dense_solver(table):
    """The objective (half the squared normal, less the offset, plus the mean shortfall over nu) is near the optimum, which
    projected gradient on the dual finds on the same lifted rows."""
    x, _, df = table(13, n=200)
    nu = 0.1
    _, stage = anomaly.fit_boundary(df, NAMES, width=24, nu=nu, steps=60)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    phase = np.array(stage.get("phase"))
    up = lift(z, np.array(stage.get("turn")).reshape(-1, len(phase)), phase)

    def objective(w):
        rho = np.quantile(up @ w, nu)
        return 0.5 * w @ w - rho + np.maximum(rho - up @ w, 0).mean() / nu

    top = 1 / (nu * len(up))
    alpha = np.full(len(up), 1 / len(up))
    gram = up @ up.T

    def project(v):
        low, high = v.min() - top, v.max()
        for _ in range(100):
            middle = (low + high) / 2
            if np.clip(v - middle, 0, top).sum() > 1:
                low = middle
            else:
                high = middle
        return np.clip(v - high, 0, top)

    rate = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(4000):
        alpha = project(alpha - rate * (gram @ alpha))
    best = objective(alpha @ up)
    assert objective(np.array(stage.get("normal"))) <= best + 0.01 * max(abs(best), 0.1)
