"""The plan from features to errors, and windows of the role-declared datasets."""

import pytest
from pyspark.sql import functions as F

from heatloom import Series
from heatloom.plans import evaluation, recipes
from heatloom.schema import RunConfig
from tests.data import at, series

S = Series("day", points=5, chunk=6)


def config(**kw):
    return RunConfig(**{"feature_list": ("diff",), "n_in": 2, "n_out": 2, "n_future": 2, "lag_in": 2, "lag_out": 2, "train_per": 0.6, **kw})


@pytest.mark.parametrize("scaler", ["standard", "minmax", "none"])
def test_straight_lines_are_forecast_exactly(spark, scaler):
    """Each day adds a fixed amount, so the lag gives both targets; the baseline is behind by two days' growth."""
    df = series(spark, **{f"b{k}": [(d, 100 * k + 3 * d) for d in range(60)] for k in (1, 2)}).select("id", "datetime", "diff")
    df = df.withColumn("primary_energy", F.lit("gas"))
    out = evaluation.recipe_evaluate(df, config(scaler=scaler), S, ["diff(t-1)"])
    table = {(r["model"], r["id"]): r for r in evaluation.errors_per_id(out, S).collect()}
    assert set(table) == {(m, i) for m in ("linear", "naive") for i in ("b1", "b2")}
    for i in ("b1", "b2"):
        assert table["linear", i]["mae"] == pytest.approx(0, abs=1e-6) and table["naive", i]["mae"] == pytest.approx(6)
    labels = spark.createDataFrame([("b1", 0), ("b2", 1)], "id string, label bigint")
    both = evaluation.errors_per_cluster(out, labels, S).filter("metric = 'mae'").collect()
    assert sorted((r["label"], round(r["linear"], 6), r["naive"]) for r in both) == [(0, 0.0, 6.0), (1, 0.0, 6.0)]


def test_electricity_windows_overlap_and_leave_out_short_customers(spark):
    rows = [("long", h) for h in range(96)] + [("short", h) for h in range(3)]
    df = spark.createDataFrame([(i, at(0, h), float(h), h // 24) for i, h in rows], "id string, date timestamp_ntz, power_usage double, days_from_start bigint")
    hours = F.col("power_usage").cast("bigint")
    df = df.withColumns({"hour": hours % 24, "day_of_week": F.weekday("date"), "hours_from_start": hours, "categorical_id": F.col("id")})
    out = recipes.recipe_electricity_windows(df, 4, 2, 2, 3, 1, Series("hour", time="date", points=7, chunk=9))
    sizes = {(r["id"], r["split"]): r["count"] for r in out.groupBy("id", "split").count().collect()}
    # train has days 0 and 1, validation 1 and 2, test 2 and 3
    assert sizes == {("long", p): 45 for p in ("train", "val", "test")}
    mean, deviation = 23.5, (sum((h - 23.5) ** 2 for h in range(48)) / 48) ** 0.5
    first = out.filter("split = 'val'").orderBy("window_start").first()
    assert first["window_start"] == at(1) and first["outputs"] == pytest.approx([(h - mean) / deviation for h in (26, 27)])


def test_volatility_windows_reject_categories_train_lacks(spark):
    days = [at(d) for d in range(0, 1100, 5)]
    df = spark.createDataFrame([("x", t, float(n)) for n, t in enumerate(days)], "Symbol string, date timestamp_ntz, log_vol double")
    df = df.withColumns({"open_to_close": F.col("log_vol"), "days_from_start": F.datediff("date", F.lit("2024-01-01")), "Region": F.lit("EMEA")})
    df = df.withColumns({c: F.lit(1) for c in ("day_of_week", "day_of_month", "week_of_year")} | {"month": F.month("date")})
    s = Series("day", id="Symbol", time="date", points=90, chunk=16)
    out = recipes.recipe_volatility_windows(df, 3, 2, 2025, 2026, "2026-06-28", s)
    parts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    n = {p: sum(a <= t.year < b and t < at(909) for t in days) for p, a, b in (("train", 0, 2025), ("val", 2025, 2026), ("test", 2026, 9999))}
    assert parts == {p: k - 2 for p, k in n.items()}
    odd = df.withColumn("month", F.when(F.year("date") > 2024, 13).otherwise(F.col("month")))
    with pytest.raises(Exception, match="month was not fitted on 13"):
        recipes.recipe_volatility_windows(odd, 3, 2, 2025, 2026, "2026-06-28", s).collect()
