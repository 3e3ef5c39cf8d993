"""Neighbours over many pivots: exact, and with work per query that falls as the table grows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import anomaly, neighbors
from flowlens.session import shared_dir


def vectors(spark, x, group=None):
    rows = [(i, [float(v) for v in r], int(group[i]) if group is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, g int")


def clustered(seed, n, clusters=40):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, 4)) * 20
    return middle[rng.integers(clusters, size=n)] + rng.normal(size=(n, 4))


def nearest(x, y, k, same=None):
    """(query, neighbour) by all distances, ties to the smaller id."""
    d = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(-1))
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(y)) if same is None or (j != i and same[i] == same[j])), key=lambda j: (d[i, j], j))
        out[i] = order[:k]
    return out


def found(df):
    got = {}
    for r in df.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    return got


def test_two_levels_of_pivots_place_rows_near(spark):
    x = clustered(1, 3000)
    pivots = neighbors.Pivots(x[:400])
    cell, radius = pivots.place(x)
    assert len(pivots.heads) == 20 and sorted(np.concatenate(pivots.members)) == list(range(400))
    assert np.allclose(radius, np.sqrt(((x - x[:400][cell]) ** 2).sum(axis=1)))
    assert np.median(radius) <= 1.3 * np.median(np.sqrt(((x[:, None] - x[None, :400]) ** 2).sum(-1)).min(axis=1))


def test_groups_and_queries_are_exact(spark):
    x = clustered(2, 600)
    group = np.arange(600) % 7 // 3
    got = found(neighbors.knn_join(vectors(spark, x, group), 5, "id", "v", ["g"], block=8))
    assert got == nearest(x, x, 5, group)
    asked = clustered(3, 90)
    points = vectors(spark, x)
    got = found(neighbors.knn_join(points, 4, "id", "v", queries=vectors(spark, asked), exclude_self=False, block=8))
    assert got == nearest(asked, x, 4)


def blocks_met(spark, n, need=6, block=16):
    x = clustered(4, n)
    pivots = neighbors.Pivots(x[:n // block])
    rows = neighbors._representatives(vectors(spark, x).select(F.col("id").alias("_id"), F.col("v").alias("_vec")), [], need)
    placed = neighbors._place(rows, pivots)
    meets = neighbors._visits(placed, placed, [], pivots, need, block)
    return meets.select(F.sum(F.col("_qsubs") * F.col("_psubs"))).first()[0]


def test_visited_blocks_grow_far_slower_than_all_pairs(spark):
    few, many = blocks_met(spark, 800), blocks_met(spark, 8000)
    assert many < 30 * few  # all pairs of blocks: 100 times as many
    assert many < 0.15 * (8000 / 16) ** 2


@pytest.mark.parametrize("k", [3, 30])
def test_few_rows(spark, k):
    x = clustered(5, 12)
    assert found(neighbors.knn_join(vectors(spark, x), k, "id", "v", block=2)) == nearest(x, x, k, np.zeros(12))


def shuffled_bytes(spark, n):
    """Bytes shuffled by a search in which the bound skips nothing."""
    def total():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    x = np.random.default_rng(6).normal(size=(n, 16))
    points, before = vectors(spark, x), total()
    assert neighbors.knn_join(points, 5, "id", "v", block=20, pivots=8).count() == 5 * n
    return total() - before


def test_rows_sent_grow_as_the_table_where_nothing_is_skipped(spark):
    shuffled_bytes(spark, 600)
    assert shuffled_bytes(spark, 3600) < 9 * shuffled_bytes(spark, 600)  # all pairs of blocks: 36 times as many


def test_the_outlier_factor_stores_no_pairs_of_its_queries(spark):
    def stored():
        where = shared_dir(spark)
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(where) for f in names)

    def rows(n, seed, first):
        x = np.random.default_rng(seed).normal(size=(n, 3))
        return vectors(spark, x).withColumn("id", F.col("id") + first)

    def kept(n):
        before = stored()
        got = anomaly.local_outlier_factor(rows(400, 7, 0), rows(n, 8, 10_000), "id", "v")
        assert got.count() == n
        return stored() - before

    few, many = kept(500), kept(4500)
    assert many - few < 4000 * 200  # 20 neighbours of 28 bytes each are more
