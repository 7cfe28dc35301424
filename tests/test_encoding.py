"""Stored encoders: sparse vectors against plain ones."""

import pytest
from pyspark.sql import functions as F

from heatloom.functions.tables import new_path
from heatloom.operators.encoding import Encoder

ROWS = [
    (1, 2.0, "b", "x", 1.0, 10.0), (2, 4.0, "a", None, 0.0, 20.0), (3, 6.0, None, "y", 1.0, 30.0), (4, None, "b", "y", None, 40.0),
]
SCHEMA = "id long, n double, c string, `d e` string, f double, t double"


def vectors(df):
    return {r["id"]: (r["size"], r["indices"], [round(v, 9) for v in r["values"]]) for r in df.collect()}


@pytest.mark.parametrize("path", ["small", "large"])
def test_vectors(spark, path, request):
    s = request.getfixturevalue("shuffled") if path == "large" else spark
    df = s.createDataFrame(ROWS, SCHEMA)
    where = new_path(s)
    Encoder.fit(df, ["n"], ["c", "d e"], ["f"], "t").save(where)
    enc = Encoder.load(s, where)
    z = (8 / 3) ** 0.5
    other = s.createDataFrame([(5, 4.0, "new", "x", 2.0, 25.0)], SCHEMA)
    got = enc.transform(df.unionByName(other), by="id")
    assert vectors(got) == {
        1: (6, [0, 2, 3, 5], [round(-2 / z, 9), 1, 1, 1]),
        2: (6, [0, 1, 5], [0, 1, 0]),
        3: (6, [0, 4, 5], [round(2 / z, 9), 1, 1]),
        4: (6, [2, 4], [1, 1]),
        5: (6, [0, 3, 5], [0, 1, 2]),
    }
    assert got.columns == [*df.columns, "size", "indices", "values"]
    assert {r["id"]: r["n"] for r in got.collect()} == {1: 2.0, 2: 4.0, 3: 6.0, 4: None, 5: 4.0}
    back = enc.inverse(got.select("id", F.col("t").alias("y_hat")))
    assert sorted(round(r["y_hat"], 9) for r in back.collect()) == [10, 20, 25, 30, 40]


def test_no_category_and_nothing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert vectors(Encoder.fit(df, [], [], ["f"]).transform(df, by="id"))[1] == (1, [0], [1.0])
    empty = Encoder.fit(df.limit(0), ["n"], ["c"], [])
    assert vectors(empty.transform(df, by="id"))[1][1] == []
    with pytest.raises(ValueError, match="without a target"):
        empty.inverse(df)


def test_a_million_categories(spark):
    """Unseen ones among them; no job returns categories and the plan has no column for one."""
    train = spark.range(1_000_000).select(F.col("id"), F.format_string("c%07d", F.col("id") * 2).alias("c"))
    enc = Encoder.fit(train, [], ["c"])
    assert enc.size == 1_000_000
    rows = spark.range(0, 2_000_000, 7).select("id", F.format_string("c%07d", "id").alias("c"))
    out = enc.transform(rows, by="id")
    wrong = out.filter(F.when(F.col("id") % 2 == 0, (F.size("indices") != 1) | (F.col("indices")[0] != F.col("id") / 2)).otherwise(F.size("indices") != 0))
    assert wrong.count() == 0 and len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
