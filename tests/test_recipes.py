"""Variants of the training recipes on a small complete feature frame."""

import pytest
from pyspark.sql import functions as F

from heatloom import Series
from heatloom.plans import recipes
from heatloom.schema import FEATURE_SETS, RunConfig
from tests.data import series

S = Series("day", points=5, chunk=6)


@pytest.fixture(scope="module")
def features(spark):
    df = series(spark, **{f"b{k}": [(d, k + d % 5) for d in range(80) if not (k == 3 and 5 < d < 20)] for k in range(10)})
    n, d = F.substring("id", 2, 9).cast("int"), F.dayofyear("datetime")
    columns = {c: (F.lit(float(len(c))) + d % 7 + n).cast("double") for c in FEATURE_SETS[7] if c not in ("diff",)}
    columns |= {
        "typ": (n % 2).cast("string"),
        "primary_energy": F.when(n < 5, "gas").otherwise("oil"),
        "weekday": d % 7 + 1,
        "day_of_month": d,
    }
    return df.drop("value", "source").withColumns(columns).cache()


def config(**kw):
    base = {"n_in": 2, "n_out": 2, "n_future": 2, "lag_in": 2, "lag_out": 2, "train_per": 0.6, "feature_code": 10}
    return RunConfig(**{**base, **kw})


@pytest.mark.parametrize("split", ["time", "group", "date"])
@pytest.mark.parametrize("mode", ["individual", "all"])
def test_prepare(features, split, mode):
    cfg = config(split=split, scale_mode=mode, split_date="2024-03-01")
    df, names = recipes.recipe_prepare(features, cfg, S)
    # a series that is not in train has no scaler of its own
    parts = {"train"} if (split, mode) == ("group", "individual") else {"train", "val", "test"}
    assert {r["split"] for r in df.select("split").distinct().collect()} == parts
    assert {"typ_0", "primary_energy_gas", "weekday_sin", "day_of_month_cos"} <= set(names) and set(names) <= set(df.columns)
    train = df.filter("split = 'train'").agg(F.avg("diff").alias("m"), F.stddev_pop("tavg").alias("s")).collect()[0]
    assert train["m"] == pytest.approx(0, abs=1e-9) and train["s"] == pytest.approx(1)


def test_minmax_and_none(features):
    df, _ = recipes.recipe_prepare(features, config(scaler="minmax", scale_mode="all"), S)
    lo, hi = df.filter("split = 'train'").agg(F.min("diff"), F.max("diff")).collect()[0]
    assert (lo, hi) == (0, 1)
    raw, _ = recipes.recipe_prepare(features, config(scaler="none"), S)
    assert raw.agg(F.max("diff")).collect()[0][0] > 1
    with pytest.raises(ValueError):
        recipes.recipe_prepare(features, config(scale_mode="some"), S)
    with pytest.raises(ValueError):
        recipes.recipe_prepare(features, config(split="some"), S)


def test_variants(features):
    one, names = recipes.recipe_training(features, config(energy="gas", excluded_ids=("b1",)), S)
    assert {r["id"] for r in one.select("id").distinct().collect()} == {"b0", "b2", "b3", "b4"}
    assert "primary_energy_oil" not in names
    covered, _ = recipes.recipe_training(features, config(dataset="missing_data_90"), S)
    assert {r["id"] for r in covered.select("id").distinct().collect()} == {f"b{k}" for k in range(10)} - {"b3"}
    with pytest.raises(ValueError):
        recipes.recipe_training(features, config(dataset="other"), S)
    with pytest.raises(ValueError):
        recipes.recipe_training(features.drop("tavg"), config(), S)
