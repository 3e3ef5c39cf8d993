"""Boosting on the softmax loss against a version that looks at every cut of every node."""

import numpy as np
import pytest

from flowlens.operators import boosting, models

NAMES = ("a", "b", "c")


def rows_of(seed, n=240):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] > 0.5).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    def make(x, y):
        rows = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
        return spark.createDataFrame(rows, "row_id long, a double, b double, c double, label int").repartition(3)

    return make


def brute(x, y, cuts, classes, rounds, depth, rate, penalty=1.0, least=1.0):
    """Margins after all rounds and the loss before each, by trying every cut at every node."""
    margins, losses, gains = np.zeros((len(x), classes)), [], []

    def grow(here, g, h, level, out):
        total, curve = g[here].sum(), h[here].sum()
        out[here] = -rate * total / (curve + penalty)
        if level == depth:
            return
        best = (1e-9, None, None)
        for f, points in enumerate(cuts):
            for point in points:
                left = here & (x[:, f] < point)
                right = here & ~(x[:, f] < point)
                if not left.any() or not right.any() or h[left].sum() < least or h[right].sum() < least:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + penalty) for s in (left, right)) - total**2 / (curve + penalty)
                if gain > best[0] + 1e-9:
                    best = (gain, left, right)
        if best[1] is not None:
            gains.append(best[0])
            grow(best[1], g, h, level + 1, out)
            grow(best[2], g, h, level + 1, out)

    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        step = np.zeros_like(margins)
        for c in range(classes):
            grow(np.ones(len(x), dtype=bool), p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), 0, step[:, c])
        margins += step
    return margins, losses, gains


def scores(df, column):
    return np.array([r[1] for r in df.select("row_id", column).orderBy("row_id").collect()])


def test_softmax_trees_equal_brute_force(table, monkeypatch):
    monkeypatch.setattr(boosting, "WRITTEN_EVERY", 2)  # margins are written on the way
    x, y = rows_of(1)
    df = table(x, y)
    stage = boosting.fit_softmax_trees(df, NAMES, "label", 3, rounds=5, depth=3, rate=0.3, subsample=1.1, bins=16)
    margins, losses, gains = brute(x, y, boosting.cut_points(df, NAMES, 16), 3, 5, 3, 0.3)
    got = np.array([r[1].toArray() for r in stage.transform(df).select("row_id", "rawPrediction").orderBy("row_id").collect()])
    assert np.allclose(got, margins)
    assert np.allclose(stage.get("losses"), losses) and (np.diff(losses) < 0).all()
    assert np.allclose(sorted(stage.nodes.loc[stage.nodes["feature"] >= 0, "gain"]), sorted(gains))
    assert np.isclose(stage.featureImportances.toArray().sum(), 1.0)


def test_boosted_classes_are_learned_saved_and_loaded(table, tmp_path):
    x, y = rows_of(2, 400)
    df = table(x[:300], y[:300] * 10)
    asked = table(x[300:], y[300:] * 10)
    model = models.boosted(df, NAMES, "label", (0, 10, 20), rounds=12, depth=3, rate=0.3)
    p = scores(model.score(asked), "p_boosted")
    assert np.allclose(p.sum(axis=1), 1.0)
    assert (scores(model.predict(asked), "predicted") == y[300:] * 10).mean() > 0.95
    assert (np.diff(model.classifier.get("losses")) < 0).all()
    again = models.boosted(df, NAMES, "label", (0, 10, 20), rounds=3, depth=3, rate=0.3)
    third = models.boosted(df, NAMES, "label", (0, 10, 20), rounds=3, depth=3, rate=0.3)
    assert np.allclose(again.classifier.nodes, third.classifier.nodes)
    model.save(str(tmp_path / "model"))
    assert np.array_equal(scores(models.Model.load(str(tmp_path / "model")).score(asked), "p_boosted"), p)


def test_missing_features_empty_tables_and_one_class(spark, table):
    x, y = rows_of(3, 60)
    df = table(x, y)
    gaps = df.selectExpr("row_id", "case when row_id % 3 = 0 then null when row_id % 3 = 1 then double('nan') else a end as a", "b", "c",
                         "case when row_id % 7 = 0 then null else label end as label")
    found = models.boosted(gaps, NAMES, "label", (0, 1, 2), rounds=2, depth=2)
    assert np.isfinite(scores(found.score(gaps), "p_boosted")).all()
    nothing = models.boosted(df.where("false"), NAMES, "label", (0, 1, 2), rounds=2, depth=2)
    assert np.allclose(scores(nothing.score(df), "p_boosted"), 1 / 3)
    single = models.boosted(df.where("label = 1"), NAMES, "label", (0, 1, 2), rounds=2, depth=2, rate=0.3)
    assert (scores(single.predict(df), "predicted") == 1).all()


def test_rows_between_the_same_cuts_go_one_way(table, monkeypatch):
    """Rows, cells of parts and remembered cells of a task give the same margins; a level is one pass over cells, not over rows."""
    x, y = rows_of(4, 300)
    df = table(x, y)
    once = boosting.fit_softmax_trees(df, NAMES, "label", 3, rounds=4, depth=3, rate=0.3, bins=8)
    monkeypatch.setattr(boosting, "PART_ROWS", 20)
    monkeypatch.setattr(boosting, "TASK_ROWS", 50)
    parts = boosting.fit_softmax_trees(df, NAMES, "label", 3, rounds=4, depth=3, rate=0.3, bins=8)
    assert np.allclose(once.nodes, parts.nodes)
    part = boosting.Part(np.array([[0], [1]], dtype="uint8"), np.array([0, 0, 1], dtype="int32"), np.array([1, 0, 1]), np.arange(3), np.zeros((2, 2)))
    seen = boosting._weighed(part, 0, 1.1, 1)
    assert seen.g.tolist() == [[0.0, 0.0], [0.5, -0.5]] and seen.h.tolist() == [[0.5, 0.5], [0.25, 0.25]] and seen.loss[1] == 3
    got = np.array([r[0].toArray() for r in parts.transform(df.orderBy("row_id")).select("rawPrediction").collect()])
    want = np.zeros((len(x), 3))
    for (_, c), t in parts.nodes.groupby(["round", "class"]):
        tree = {n.node: n for n in t.itertuples()}
        for i, row in enumerate(x):
            at = tree[0]
            while at.feature >= 0:
                at = tree[2 * at.node + 1 + (not row[at.feature] < at.threshold)]
            want[i, c] += at.value
    assert np.allclose(got, want)


def test_a_level_is_one_small_job(spark, table):
    """250 rounds of depth 8 are 2 000 levels: a level may not plan a query, nor send sums of every part to the driver."""
    x, y = rows_of(5)
    df = table(x, y)
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("levels", "")
    try:
        boosting.fit_softmax_trees(df, NAMES, "label", 3, rounds=1, depth=2, rate=0.3)
        few = len(tracker.getJobIdsForGroup("levels"))
        boosting.fit_softmax_trees(df, NAMES, "label", 3, rounds=4, depth=2, rate=0.3)
        more = len(tracker.getJobIdsForGroup("levels"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert (more - few) - few == 3 * 2
