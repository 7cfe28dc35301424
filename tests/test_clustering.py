"""Ward clusters against merging by hand, and cluster features against the vectors they hold."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.operators import clustering as C

COLS = ["x", "y"]


def plain_ward(points, k):
    """Merges the two clusters whose union adds the least sum of squares, until k are left."""
    groups = [[i] for i in range(len(points))]

    def cost(g):
        p = points[g]
        return ((p - p.mean(0)) ** 2).sum()

    while len(groups) > k:
        a, b = min(combinations(range(len(groups)), 2), key=lambda ab: cost(groups[ab[0]] + groups[ab[1]]) - cost(groups[ab[0]]) - cost(groups[ab[1]]))
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def parts(labels):
    return {frozenset(np.flatnonzero(labels == v).tolist()) for v in np.unique(labels)}


def rand_index(a, b):
    same = (a[:, None] == a[None]) == (b[:, None] == b[None])
    return (same.sum() - len(a)) / (len(a) * (len(a) - 1))


def table(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double").repartition(3)


def labels_of(df):
    return np.array([r.label for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("k", [1, 2, 4, 9])
def test_ward_of_points(k):
    points = np.random.default_rng(k).normal(size=(30, 3))
    assert parts(C.ward(np.ones(30), points, k)) == plain_ward(points, k)


def test_ward_of_weighted_points():
    """Points that occur several times, as one point with a weight."""
    rng = np.random.default_rng(1)
    points, times = rng.normal(size=(12, 2)), rng.integers(1, 5, 12)
    many = np.repeat(points, times, 0)
    want = {frozenset(np.repeat(np.arange(12), times)[list(g)].tolist()) for g in plain_ward(many, 4)}
    assert parts(C.ward(times, points, 4)) == want


def test_every_leaf_is_one_vector(spark):
    """Few vectors: the clusters are Ward's on the vectors themselves."""
    points = np.round(np.random.default_rng(2).normal(size=(40, 2)) * 50, 2)
    points[5] = points[6]
    out = C.ward_clusters(table(spark, points), COLS, 5)
    assert parts(labels_of(out)) == plain_ward(points, 5)
    means = [points[labels_of(out) == i, 0].mean() for i in range(5)]
    assert means == sorted(means)


def blobs(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    centre = np.array([[0, 0], [60, 5], [10, 80], [-70, -40], [4000, 9000]])
    return centre[rng.choice(5, n, p=[0.4, 0.3, 0.2, 0.09, 0.01])] + rng.normal(size=(n, 2)) * 6


def test_many_vectors_on_few_leaves(spark):
    """A hundred leaves hold 1500 vectors with far outliers; the clusters are nearly Ward's on all of them."""
    points = blobs()
    df = table(spark, points)
    placed, leaf = C.features(df, COLS, 100)
    assert placed.count() == 1500 and 20 < leaf.count() <= 100
    assert rand_index(labels_of(C.ward_clusters(df, COLS, 5, 100)), C.ward(np.ones(1500), points, 5)) >= 0.9


@pytest.mark.parametrize("leaves", [1, 7, 64, 5000])
def test_features_hold_all_vectors(spark, leaves):
    """Numbers, sums and squares of a leaf are those of the rows placed in it."""
    points = np.concatenate([blobs(300), np.full((50, 2), 3.0)])
    placed, leaf = C.features(table(spark, points), COLS, leaves)
    mean = points.mean(0)
    at = {}
    for r in placed.collect():
        at.setdefault((r.level, tuple(r.cell)), []).append(points[r.id] - mean)
    assert sum(map(len, at.values())) == 350
    rows = leaf.collect()
    assert len(rows) == len(at) <= leaves
    for r in rows:
        mine = np.array(at[r.level, tuple(r.cell)])
        assert r.n == len(mine)
        np.testing.assert_allclose([r.s_x, r.s_y, r.q], [*mine.sum(0), (mine**2).sum()], rtol=1e-6, atol=1e-5)


def test_nulls_and_nothing(spark):
    df = table(spark, [(1, 1), (2, 2)]).unionByName(spark.createDataFrame([(9, None, 1.0)], "id long, x double, y double"))
    assert sorted(r.id for r in C.ward_clusters(df, COLS, 2).collect()) == [0, 1]
    assert C.ward_clusters(df.filter(F.col("id") == 9), COLS, 2).collect() == []
    assert [r.label for r in C.ward_clusters(table(spark, [(1, 1), (1, 1)]), COLS, 3).collect()] == [0, 0]
