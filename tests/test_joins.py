"""Joins that carry values or need every key listed."""

import pytest
from pyspark.sql import functions as F

from heatloom.functions.skew import is_small, seems_small, spread_join
from heatloom.functions.tables import materialize
from heatloom.operators import joins


def test_price_is_carried_over_sale_days_only(spark):
    """A day without any sale has no price, also between days with one."""
    grid = spark.createDataFrame([("a", d) for d in range(1, 6)], "id string, day int").selectExpr("id", "date_add(date'2015-01-01', day) AS date")
    sold = grid.filter("day(date) IN (2, 4, 6)").select("date")
    oil = spark.createDataFrame([(50.0,)], "oil double").selectExpr("date'2015-01-02' AS date", "oil")
    got = {r["date"].day: r["oil"] for r in joins.asof_ffill_join(grid, oil, calendar=sold).collect()}
    assert got == {2: 50.0, 3: -1.0, 4: 50.0, 5: -1.0, 6: 50.0}
    assert {r["oil"] for r in joins.asof_ffill_join(grid, oil).collect()} == {50.0}


def test_a_place_that_is_not_listed_fails(spark):
    perm = spark.createDataFrame([(0, 3), (1, 1)], "position int, value int")
    rows = spark.createDataFrame([(0,), (1,), (1,)], "position int")
    assert sorted(r["day"] for r in joins.reorder_by_permutation(rows, perm).collect()) == [0, 0, 2]
    with pytest.raises(Exception, match="no day is listed for position 2"):
        joins.reorder_by_permutation(rows.unionByName(spark.createDataFrame([(2,)], "position int")), perm).collect()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_many_rows_in_small_files_are_not_broadcast(spark, how):
    """A table of 300 000 rows in some KB is joined by shuffles on whichever side it stands; one of a few rows is broadcast."""
    many = materialize(spark.range(300_000).select("id", (F.col("id") % 7).alias("a"), F.lit("text").alias("b"), F.lit("more").alias("c")))
    assert seems_small(many) and not is_small(many) and is_small(many.limit(5))
    rows = materialize(spark.range(300_000).select("id", F.lit("row").alias("r")))
    out = spread_join(rows, many, "id", how, by="r")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 300_000 and out.where("a = id % 7 AND b = 'text'").count() == 300_000
    meta = materialize(spark.range(300_000).select("id", F.concat(F.lit("s"), "id").alias("address")))
    lod = meta.select("address", F.lit(1.0).alias("heated_area"), F.lit("x").alias("id"))
    out = joins.join_meta_lod(meta, lod)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 300_000


def test_no_broadcast_grows_with_the_rows(spark):
    """Neither a high threshold nor files that tell little let many rows of a dimension or a seam be broadcast; few rows are."""
    from heatloom import DAILY

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    many = materialize(spark.range(300_000).select("id", F.lit("text").alias("b")))
    rows = materialize(spark.range(300_000).select("id", F.lit("row").alias("r")))
    days = spark.range(200_000).select(F.col("id").cast("string"), F.expr("timestamp_ntz'2024-01-01'").alias("datetime"), F.lit(1.0).alias("diff"))
    days = materialize(days)
    try:
        spark.conf.set(key, "1g")
        assert not is_small(many) and is_small(many.limit(5))
        out = spread_join(rows, many, "id", "inner", by="r")
        assert "BroadcastHashJoin" not in plan(out) and out.where("b = 'text'").count() == 300_000
        spark.conf.set(key, before)
        assert seems_small(days)
        out = DAILY.running_sum(days, "diff", "sum")
        assert "BroadcastHashJoin" not in plan(out) and out.where("sum = 1").count() == 200_000
        params = materialize(spark.range(90_000).select(F.col("id").cast("string").alias("base_id"), F.rand(1).alias("a"), F.rand(2).alias("b")))
        assert seems_small(params) and not is_small(params)  # 12.6 MB in a hash table
    finally:
        spark.conf.set(key, before)
