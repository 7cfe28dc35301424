import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.functions.order import column_quantiles, hash_order, quantiles, sorted_offset
from heatloom.functions.skew import spread_join
from tests.data import rows_of


def groups(spark):
    """Groups of 1 to 40 values with ties, and one with most of all rows."""
    rnd = random.Random(3)
    data = {f"g{n}": [float(rnd.randint(0, 12)) for _ in range(n)] for n in range(1, 41)}
    data["hot"] = [round(rnd.gauss(0, 50), 1) for _ in range(20_000)]
    data["flat"] = [5.0] * 3000 + [7.0]
    rows = [(k, v) for k, vs in data.items() for v in vs]
    return data, spark.createDataFrame(rows, "g string, x double")


PROBS = {"min": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "max": 1.0}


@pytest.mark.parametrize("accuracy", [40, 10_000])
def test_quantiles_are_exact(shuffled, accuracy):
    data, df = groups(shuffled)
    linear = {r["g"]: r for r in quantiles(df, "g", "x", PROBS, accuracy=accuracy).collect()}
    nearest = {r["g"]: r for r in quantiles(df, "g", "x", PROBS, "nearest", accuracy=accuracy).collect()}
    assert set(linear) == set(data)
    for g, values in data.items():
        ordered = sorted(values)
        assert linear[g]["n"] == len(values)
        for name, p in PROBS.items():
            assert linear[g][name] == pytest.approx(np.quantile(values, p), abs=1e-9), (g, name)
            assert nearest[g][name] == ordered[math.floor((len(values) - 1) * p + 0.5)], (g, name)


@pytest.mark.parametrize("accuracy", [40, 10_000])
def test_quantiles_of_everything_and_of_few_groups(spark, accuracy):
    data, df = groups(spark)
    every = [v for vs in data.values() for v in vs]
    row = quantiles(df, [], "x", PROBS, accuracy=accuracy).collect()[0]
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.quantile(every, p), abs=1e-9)
    few = {r["g"]: r["q50"] for r in quantiles(df, "g", "x", {"q50": 0.5}, accuracy=accuracy, few_groups=True).collect()}
    assert few["hot"] == pytest.approx(np.median(data["hot"]))


def test_quantiles_ignore_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "g string, x double")
    assert rows_of(quantiles(df, "g", "x", {"m": 0.5})) == [("a", 2, 2.0)]


def test_quantiles_with_further_aggregates(shuffled):
    """Aggregates of the first scan, with a row for groups without values; a hot group of equal values is spread by another column."""
    data, df = groups(shuffled)
    df = df.withColumn("k", F.monotonically_increasing_id()).unionByName(shuffled.createDataFrame([("none", None, 1)], "g string, x double, k long"))
    also = {"total": F.sum("x"), "rows": F.count(F.lit(1))}
    out = {r["g"]: r for r in quantiles(df, "g", "x", {"m": 0.5}, spread="k", also=also).collect()}
    assert out["none"]["m"] is None and out["none"]["rows"] == 1 and set(out) == {*data, "none"}
    for g, values in data.items():
        assert out[g]["m"] == pytest.approx(np.median(values)) and out[g]["total"] == pytest.approx(sum(values)) and out[g]["n"] == len(values)


@pytest.mark.parametrize("accuracy", [40, 10_000])
def test_quantiles_of_columns(spark, accuracy):
    """Columns of several types, with nulls, ties, infinite values and none at all."""
    rnd = random.Random(9)
    rows = [(rnd.gauss(0, 1), rnd.choice([1, 2, 2, 9, None]), rnd.choice([float("inf"), -float("inf"), 0.0, 1.5]), None) for _ in range(5000)]
    df = spark.createDataFrame(rows, "a double, `b c` int, d double, e double")
    out = column_quantiles(df, ["a", "b c", "d", "e"], PROBS, "nearest", accuracy, {"total": lambda c: F.count(f"`{c}`")})
    got = {r["column"]: r for r in out.collect()}
    for i, c in enumerate(df.columns):
        values = sorted(float(r[i]) for r in rows if r[i] is not None)
        assert got[c]["total"] == len(values)
        for name, p in PROBS.items():
            assert got[c][name] == (values[math.floor((len(values) - 1) * p + 0.5)] if values else None), (c, name)


def test_no_value_is_shuffled(spark):
    """Of many different values only counts and the few inside the brackets are rows of a shuffle."""
    from tests.test_layout import shuffled_records

    df = spark.range(200_000).select((F.col("id") % 7).alias("g"), F.xxhash64("id").cast("double").alias("x")).repartition(6)
    assert shuffled_records(spark, quantiles(df, "g", "x", {"q25": 0.25, "q75": 0.75}))[1] < 6_000  # the first is the repartition above


def test_hash_order_is_a_permutation(spark):
    df = spark.range(5000).withColumn("k", F.col("id").cast("string"))
    out = hash_order(df, ["k"], 7)
    ranks = sorted(r["_rank"] for r in out.collect())
    assert ranks == list(range(5000))
    again = hash_order(df.repartition(13), ["k"], 7)
    assert rows_of(out, "k", "_rank") == rows_of(again, "k", "_rank")
    assert rows_of(out, "k", "_rank") != rows_of(hash_order(df, ["k"], 8), "k", "_rank")


def test_sorted_offset(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") % 7).alias("w"))
    want, total = [], 0
    for k, w in sorted((f"k{i}", i % 7) for i in range(1000)):
        want.append((k, total))
        total += w
    assert rows_of(sorted_offset(df, ["k"], F.col("w"), "before"), "k", "before") == want


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_join(shuffled, how):
    rows = shuffled.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise((F.col("id") % 50).cast("string")).alias("k"), F.col("id").alias("n")
    )
    dim = shuffled.createDataFrame([("hot", 1.0), ("7", 2.0), (None, 3.0)], "k string, x double")
    got = spread_join(rows, dim, "k", how, by="n")
    assert rows_of(got) == rows_of(rows.join(dim, "k", how))
    plan = got._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_spread_join_of_small_dim_is_a_broadcast(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 5)
    dim = spark.range(5).select(F.col("id").alias("k"), F.rand(1).alias("x"))
    plan = spread_join(rows, dim, "k", by="id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "_salt" not in plan


def test_quantiles_at_edges_and_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", x) for x in (inf, 1.0, 2.0, -inf, 5.0)] + [("b", 2.0)] * 3, "g string, x double")
    got = rows_of(quantiles(df, "g", "x", {"lo": 0.0, "m": 0.5, "hi": 1.0}))
    assert got == [("a", 5, -inf, 2.0, inf), ("b", 3, 2.0, 2.0, 2.0)]


def test_quantiles_rank_brackets_by_cells(shuffled):
    """Half of the values lie in one thousandth of the range, so that cells of a bracket are filled unevenly."""
    n = 40_000
    df = shuffled.range(n).selectExpr("'a' AS g", f"CASE WHEN id < {n // 2} THEN id / {n}D ELSE id * 1000D END AS x")
    values = sorted(i / n if i < n // 2 else i * 1000.0 for i in range(n))
    row = quantiles(df, "g", "x", {"q": 0.25, "m": 0.5, "z": 0.9}, "nearest").collect()[0]
    assert [row[c] for c in ("q", "m", "z")] == [values[int((n - 1) * p + 0.5)] for p in (0.25, 0.5, 0.9)]
