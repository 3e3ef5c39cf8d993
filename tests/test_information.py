"""Mutual information by nearest neighbours against the plain estimate."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import selection


def psi(n):
    return sum(1.0 / i for i in range(1, n)) - 0.5772156649015329


def plain(values, classes, k=3):
    rows = [(v, c) for v, c in zip(values, classes, strict=True) if v is not None and classes.count(c) > 1]
    n, told = len(rows), []
    for i, (v, c) in enumerate(rows):
        own = sorted(abs(v - w) for j, (w, d) in enumerate(rows) if d == c and j != i)
        kk = min(k, len(own))
        r = own[kk - 1]
        closer = sum(v - r < w < v + r for w, _ in rows) if r > 0 else sum(w == v for w, _ in rows)
        told.append(psi(kk) - psi(len(own) + 1) - psi(closer))
    return max(0.0, psi(n) + sum(told) / n)


def test_digamma(spark):
    got = spark.range(1, 300).select("id", selection.digamma(F.col("id")).alias("v")).collect()
    assert all(math.isclose(r["v"], psi(r["id"]), abs_tol=1e-9) for r in got)


@pytest.mark.parametrize("block_rows", [4, 7, 32_768])
def test_neighbour_information(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    classes = [int(c) for c in rng.integers(0, 3, 200)] + [9]  # a class of one row
    shifted = [float(x + 2 * c) for x, c in zip(rng.normal(size=201), classes, strict=True)]
    noise = [float(x) for x in rng.normal(size=201)]
    grid = [float(x) for x in rng.integers(0, 6, 201)]  # many equal values
    gaps = [None if i % 11 == 0 else float(i % 50) ** 2 for i in range(201)]
    names = ("shifted", "noise", "grid", "gaps")
    df = spark.createDataFrame(list(zip(shifted, noise, grid, gaps, classes, strict=True)),
                               "shifted double, noise double, grid double, gaps double, c int")
    got = {r["feature"]: r["score"] for r in selection.neighbour_information(df, names, "c", block_rows=block_rows).collect()}
    for name, values in zip(names, (shifted, noise, grid, gaps), strict=True):
        rest = [c for v, c in zip(values, classes, strict=True) if v is not None]
        want = plain([v for v in values if v is not None], rest)
        assert math.isclose(got[name], want, abs_tol=1e-9), name
    assert got["shifted"] > 0.3 > got["noise"]


@pytest.mark.parametrize("edge_rows", [0, 3, 65_536])
def test_cut_of_a_hash_order(spark, edge_rows):
    """However few rows of the edge are sorted, the quota's last row is the same."""
    import hashlib

    from flowlens.operators import ordering

    rows = [(i, "hot" if i % 3 else "cold") for i in range(3000)] + [(3000, "one")]
    df = spark.createDataFrame(rows, "row_id long, c string")
    quotas = {"hot": 777, "cold": 1, "one": 5, "none": 0}
    got = {r["_class"]: r["_last_rid"] for r in ordering.hash_thresholds(df, "c", "row_id", quotas, 42, edge_rows).collect()}
    for c, q in quotas.items():
        order = sorted((hashlib.md5(f"{i}-42".encode()).hexdigest(), i) for i, k in rows if k == c)
        assert got.get(c) == (order[min(q, len(order)) - 1][1] if q and order else None)
