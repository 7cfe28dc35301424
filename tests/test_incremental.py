"""A dataset fed in batches against one run over all readings."""

import random

import pytest
from pyspark.sql import functions as F

from heatloom.functions.series import Series
from heatloom.functions.tables import new_path
from heatloom.operators.cleaning import counter_to_diff
from heatloom.sources.incremental import dataset, ingest
from tests.data import at, random_series, rows_of

S = Series("day", points=5)
COLS = ["source", "id", "datetime", "value", "diff"]


def full(df):
    return rows_of(counter_to_diff(df.select("source", "id", "datetime", "value"), S).select(COLS))


def test_batches_in_any_order(spark):
    df = random_series(spark, ids=8, days=60, seed=3).withColumn("source", F.when(F.col("id") < "s3", "a").otherwise("b")).drop("diff").cache()
    path, rnd = new_path(spark), random.Random(1)
    part = F.pmod(F.xxhash64("id", "datetime"), F.lit(5))
    seen = None
    for k in rnd.sample(range(5), 5):
        batch = df.filter(part == k)
        ingest(batch, path, S)
        seen = batch if seen is None else seen.unionByName(batch)
        assert rows_of(dataset(spark, path).select(COLS)) == full(seen)
    ingest(df.filter(part == 2), path, S)  # once more
    assert rows_of(dataset(spark, path).select(COLS)) == full(df)


def test_a_day_touches_its_slice_only(spark):
    rows = [("a", "x", at(d), float(d * d)) for d in range(40)]
    schema = "source string, id string, datetime timestamp_ntz, value double"
    path = new_path(spark)
    ingest(spark.createDataFrame(rows, schema), path, S)
    files = {r.f for r in spark.read.parquet(f"{path}/rows").select(F.col("_metadata.file_name").alias("f")).distinct().collect()}
    touched = ingest(spark.createDataFrame([("a", "x", at(40), 1600.0)], schema), path, S)
    assert [len(v) for v in touched.values()] == [1]
    now = {r.f for r in spark.read.parquet(f"{path}/rows").select(F.col("_metadata.file_name").alias("f")).distinct().collect()}
    assert len(files - now) <= 1 and len(now - files) == 1
    # a late correction changes its slice, and the first row of the next one
    touched = ingest(spark.createDataFrame([("a", "x", at(9), 7.0)], schema), path, S)
    assert [len(v) for v in touched.values()] == [2]
    rows[9] = ("a", "x", at(9), 7.0)
    assert rows_of(dataset(spark, path).select(COLS)) == full(spark.createDataFrame([*rows, ("a", "x", at(40), 1600.0)], schema))


def test_nothing_and_errors(spark):
    schema = "source string, id string, datetime timestamp_ntz, value double"
    path = new_path(spark)
    assert ingest(spark.createDataFrame([], schema), path, S) == {}
    with pytest.raises(ValueError, match="no dataset"):
        dataset(spark, path)
    with pytest.raises(Exception, match="without source, series or time"):
        ingest(spark.createDataFrame([(None, "x", at(0), 1.0)], schema), path, S)
