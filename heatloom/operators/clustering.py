"""Ward clusters of any number of vectors through cluster features.

A *cluster feature* is the number of vectors in a cell of space, their sum and their sum of squares. Features add up, so a cell's is the
sum of its children's: cells of doubling width form a tree, whose levels Spark aggregates one from the other. The leaves
are the widest cells whose vectors deviate by at most some total square from their mean; the bound is the smallest for which there are at most ``LEAVES``. So
dense regions and lonely outliers each get leaves of the width they need, and all vectors are held by some leaf. Ward's method
then merges the leaves, whose number is bounded; where no more than ``LEAVES`` different vectors exist every leaf is one of them, and the
result is Ward's on the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.functions.tables import materialize

#: Bound of the leaves; levels of cells, the widest of which holds everything; bounds that are tried, as powers of two of the whole deviation.
LEAVES, LEVELS, STEPS = 1024, 24, 96


def _cells(cols: Sequence[str], low: Sequence[float], width: float) -> Column:
    """The cells of a vector, one for each level: level -1 is the vector itself."""
    own = F.struct(F.lit(-1).alias("level"), F.array(*[F.col(c) for c in cols]).alias("cell"))
    out = [own]
    for level in range(LEVELS + 1):
        size = width * 2.0 ** (level - LEVELS)
        out.append(F.struct(F.lit(level).alias("level"), F.array(*[F.floor((F.col(c) - F.lit(a)) / F.lit(size)).cast("double") for c, a in zip(cols, low, strict=True)]).alias("cell")))
    return F.array(*out)


def features(rows: DataFrame, cols: Sequence[str], leaves: int = LEAVES) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their leaf (``level``, ``cell``), and the cluster feature of each leaf: ``n``, ``s_<column>``, ``q`` (sum of squares), around the mean.

    Rows with a null in ``cols`` are left out. Both tables are stored.
    """
    rows = materialize(rows.dropna(subset=list(cols)))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in cols for f in (F.min, F.max, F.avg)]).first()
    if not ends.n:
        return rows.withColumns({"level": F.lit(-1), "cell": F.array(F.lit(0.0))}), rows.select(F.lit(-1).alias("level"), F.array(F.lit(0.0)).alias("cell"), F.lit(0).alias("n"))
    low, mean = [ends[f"min_{c}"] for c in cols], [ends[f"avg_{c}"] for c in cols]
    width = max(ends[f"max_{c}"] - ends[f"min_{c}"] for c in cols) * (1 + 1e-9) or 1.0
    centred = {f"s_{c}": F.col(c) - F.lit(m) for c, m in zip(cols, mean, strict=True)}
    square = sum((x * x for x in centred.values()), F.lit(0.0))
    sums = [f"s_{c}" for c in cols]
    finest = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))  # equal vectors are one
    finest = finest.withColumns(centred | {"q": square})
    tree = finest.select("n", *[(F.col(x) * F.col("n")).alias(x) for x in sums], (F.col("q") * F.col("n")).alias("q"), F.explode(_cells(cols, low, width)).alias("_c"))
    tree = tree.groupBy("_c.level", "_c.cell").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in sums], F.sum("q").alias("q"))
    level = sum((F.col(x) * F.col(x) for x in sums), F.lit(0.0)) / F.col("n")
    deviation = F.when(F.col("level") == -1, 0.0).otherwise(F.greatest(F.col("q") - level, F.lit(0.0)))
    tree = materialize(tree.withColumn("deviation", deviation))
    whole = tree.agg(F.max("deviation").alias("d")).first().d or 0.0

    bounds = [0.0, *[whole * 2.0 ** (i - STEPS) for i in range(STEPS)], whole * (1 + 1e-9)]
    # a cell is a leaf for all bounds from its own deviation up to that of the cell above it
    vector = F.array(*[F.col(c) for c in cols]).alias("_vector")
    path = finest.select(vector, F.explode(_cells(cols, low, width)).alias("_c")).select("_vector", "_c.level", "_c.cell")
    path = materialize(path.join(tree.select("level", "cell", "deviation"), ["level", "cell"]))
    above = path.select("_vector", (F.col("level") - 1).alias("level"), F.col("deviation").alias("above"))
    spans = path.join(above, ["_vector", "level"], "left").groupBy("level", "cell").agg(F.first("deviation").alias("own"), F.first("above").alias("above"))
    counts = spans.agg(*[F.count(F.when((F.col("own") <= b) & (F.coalesce("above", F.lit(float("inf"))) > b), 1)).alias(f"b{i}") for i, b in enumerate(bounds)]).first()
    bound = next((b for i, b in enumerate(bounds) if counts[f"b{i}"] <= leaves), bounds[-1])

    widest = path.filter(F.col("deviation") <= bound).groupBy("_vector").agg(F.max_by(F.struct("level", "cell"), "level").alias("_leaf"))
    placed = materialize(rows.withColumn("_vector", vector).join(widest, "_vector").select(*rows.columns, "_leaf.level", "_leaf.cell"))
    kept = placed.select("level", "cell").distinct()
    return placed, materialize(tree.join(kept, ["level", "cell"]).drop("deviation"))


def ward(n: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """Labels of ``k`` clusters of weighted points, merged by the least growth of the sum of squares (nearest-neighbour chains)."""
    m = len(n)
    n, centre = n.astype(float).copy(), centre.astype(float).copy()
    alive, merges = np.ones(m, bool), []
    chain: list[int] = []

    def growth(i: int) -> np.ndarray:
        d = n * n[i] / (n + n[i]) * ((centre - centre[i]) ** 2).sum(1)
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    for _ in range(m - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            d = growth(chain[-1])
            near = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[near]:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((float(d[near]), len(merges), a, b))
        centre[a] = (n[a] * centre[a] + n[b] * centre[b]) / (n[a] + n[b])
        n[a] += n[b]
        alive[b] = False
    label = np.arange(m)
    for _, _, a, b in sorted(merges)[: max(0, m - k)]:  # the cheapest merges are made, whichever chain found them
        label[label == label[b]] = label[a]
    return np.unique(label, return_inverse=True)[1]


def ward_clusters(rows: DataFrame, cols: Sequence[str], k: int, leaves: int = LEAVES) -> DataFrame:
    """``rows`` with the ``label`` of their cluster, in the order of the clusters' mean of the first column."""
    placed, leaf = features(rows, cols, leaves)
    at = leaf.toPandas()  # at most ``leaves`` rows
    if not len(at):
        return placed.drop("level", "cell").withColumn("label", F.lit(0).cast("bigint"))
    n, sums = at["n"].to_numpy(float), at[[f"s_{c}" for c in cols]].to_numpy(float)
    label = ward(n, sums / n[:, None], k)
    mean = [sums[label == i, 0].sum() / n[label == i].sum() for i in range(label.max() + 1)]
    rank = np.argsort(np.argsort(mean, kind="stable"), kind="stable")
    names = rows.sparkSession.createDataFrame(
        [(int(v), [float(x) for x in c], int(rank[i])) for v, c, i in zip(at["level"], at["cell"], label, strict=True)], "level int, cell array<double>, label bigint"
    )
    return placed.join(F.broadcast(names), ["level", "cell"]).drop("level", "cell")
