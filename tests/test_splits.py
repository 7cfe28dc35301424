"""Splits on series of 1 to 40 rows against plain Python."""

import pytest
from pyspark.sql import functions as F

from heatloom import Series
from heatloom.operators import frames, scaling, splits
from heatloom.schema import COLUMN_ROLES, RunConfig, check_roles, column_roles, columns_of, feature_columns, required_features
from tests.data import day_of, frame, rows_of, series

S = Series("day", points=4, chunk=5)


@pytest.fixture(scope="module")
def df(spark):
    return series(spark, **{f"n{n}": [(d, d + 1) for d in range(n)] for n in range(1, 41)}).cache()


def placed(out):
    return rows_of(out.select("id", day_of(), "split"))


@pytest.mark.parametrize("min_len", [None, 0, 1, 3])
def test_split_time(df, min_len):
    want = []
    for n in range(1, 41):
        a, b = int(n * 0.8), int(n * ((1 - 0.8) / 2 + 0.8))
        names = ["train" if k <= a else "test" if k <= b else "val" for k in range(n)]
        sizes = [names.count(x) for x in ("train", "test", "val")]
        if min_len is None or min(sizes) > min_len:
            want += [(f"n{n}", k, names[k]) for k in range(n)]
    assert placed(splits.split_time(df, 0.8, S, min_len=min_len)) == sorted(want, key=repr)
    if min_len is not None:
        kept = {w[0] for w in want}
        gone = {r["id"] for r in splits.discarded_ids(df, min_len, 0.8, S).collect()}
        assert gone == {f"n{n}" for n in range(1, 41)} - kept


def test_train_head_removal(df):
    out = splits.train_head_removal(df, 0.3, 0.8, S).filter("split = 'train'").groupBy("id").agg(F.count("*").alias("n"), F.max(F.dayofyear("datetime")).alias("last"))
    got = {r["id"]: (r["n"], r["last"]) for r in out.collect()}
    for n in range(1, 41):
        train = min(int(n * 0.8) + 1, n)
        kept = int(train * (1 - 0.3))
        assert got.get(f"n{n}", (0, None))[0] == kept
        if kept:
            assert got[f"n{n}"][1] == train


@pytest.mark.parametrize("remove", [0.0, 0.5])
def test_split_date(df, remove):
    cut, min_len, want = 20, 2, []
    for n in range(1, 41):
        before, after = [k for k in range(n) if k < cut], [k for k in range(n) if k > cut]
        last = int(len(before) * 0.9)
        train, val = [k for k in before if k <= last], [k for k in before if k > last]
        if remove:
            train = [k for k in train if k < int(len(train) * remove)]
        if before and (len(train) < min_len or len(val) < min_len):
            continue
        want += [(f"n{n}", k, "train") for k in train] + [(f"n{n}", k, "val") for k in val]
        if len(after) > min_len:
            want += [(f"n{n}", k, "test") for k in after]
    got = placed(splits.split_date(df, "2024-01-21", min_len, S, remove))
    assert got == sorted(want, key=repr)
    assert not any(k == cut for _, k, _ in got)  # the date itself is in no part


def test_split_date_only_after(spark):
    df = series(spark, a=[(d, 1) for d in range(30, 40)])
    assert {r["split"] for r in splits.split_date(df, "2024-01-21", 2, S).collect()} == {"test"}


def test_split_group_keeps_series_whole(df):
    out = splits.split_group(df, 0.8, 42, S)
    assert out.count() == df.count()
    assert out.groupBy("id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    sizes = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.countDistinct("id").alias("n")).collect()}
    assert sizes == {"train": 32, "test": 4, "val": 4}


def test_select_split_unknown(df):
    with pytest.raises(ValueError):
        splits.select_split(df, "holdout")


def test_row_index(df):
    got = rows_of(frames.row_index(df.select("id", "datetime"), S).select("id", day_of(), "b_idx", "index"))
    ordered = sorted((f"n{n}", k) for n in range(1, 41) for k in range(n))
    assert got == sorted(((i, k, k, j) for j, (i, k) in enumerate(ordered)), key=repr)


# ---- scaling ---------------------------------------------------------------------------------------------------


def test_scale_and_inverse_are_identity(spark):
    df = series(spark, **{"1": [(d, d * d) for d in range(10)], "12": [(d, 100 - d) for d in range(10)], "12-1": [(d + 20, 7) for d in range(5)]})
    rows = splits.split_time(df, 0.8, S).drop("value", "source").cache()
    scaled = scaling.standardize_per_series(rows, "diff", [], s=S)
    train = scaled.filter("split = 'train'").groupBy("base_id").agg(F.avg("diff").alias("m"), F.stddev_pop("diff").alias("s"))
    for r in train.collect():
        assert r["m"] == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(1)
    params = scaling.fit_scaler(rows.filter("split = 'train'").withColumn("base_id", F.regexp_replace("id", r"(-\d+)*$", "")), ["diff"], by="base_id")
    pred = scaled.select("id", "datetime", F.lit(0).alias("h"), F.col("diff").alias("y_hat"))
    back = scaling.inverse_scale(pred, params)
    assert rows_of(back.select("id", "datetime", F.round("y_hat", 6))) == rows_of(rows.select("id", "datetime", F.round("diff", 6)))


def test_constant_column_is_only_shifted(spark):
    df = series(spark, a=[(d, 5) for d in range(10)])
    rows = splits.split_time(df, 0.8, S)
    assert {r["diff"] for r in scaling.standardize_global(rows, ["diff"]).collect()} == {0.0}


def test_series_without_scaler_stay(spark):
    params = spark.createDataFrame([("a", 1.0, 2.0)], "base_id string, diff_shift double, diff_scale double")
    pred = spark.createDataFrame([("a-1", 3.0), ("b", 3.0)], "id string, y_hat double")
    out = scaling.inverse_scale(pred, params, by=["y_hat"])
    assert rows_of(out, "id", "y_hat") == [("a-1", 7.0), ("b", 3.0)]


def test_one_hot_has_no_limit(spark):
    out, names = scaling.one_hot(spark.range(1500), ["id"])
    assert len(names) == 1500 and out.columns == names
    assert scaling.one_hot(spark.range(5), ["id"], {"id": []})[1] == []


def test_one_hot_of_listed_values(spark):
    out, names = scaling.one_hot(spark.range(3), ["id"], {"id": ["1", "9"]})
    assert names == ["id_1", "id_9"] and rows_of(out) == [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0)]


def test_label_encode_unknown(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    assert rows_of(scaling.label_encode(df, ["c"], by="c")) == [(0,), (1,), (None,)]
    assert rows_of(scaling.label_encode(df, ["c"], by="c", unknown="unknown")) == [(0,), (1,), (2,)]


def test_codes_come_from_train(spark):
    train = spark.createDataFrame([("b",), ("d",)], "c string")
    fitted = scaling.fit_codes(train, ["c"])
    assert rows_of(scaling.label_encode(train, ["c"], by="c", fitted=fitted)) == [(0,), (1,)]
    other = spark.createDataFrame([("a",), ("d",)], "c string")
    with pytest.raises(Exception, match="was not fitted on"):
        scaling.label_encode(other, ["c"], by="c", fitted=fitted).collect()


def test_persistence_repeats_the_row_before(spark):
    df = frame(spark, [("a", d, d, d) for d in range(5)])
    got = scaling.persistence_forecast(df, ["diff"], 3, S).select("diff", "diff_n", "`diff(t+2)_n`")
    assert rows_of(got) == [(0.0, None, None)] + [(float(d), d - 1.0, d - 1.0) for d in range(1, 5)]


def test_titles_are_replaced_in_one_step(spark):
    from heatloom.operators import rows

    df = spark.createDataFrame([("t0",), ("t7",), ("x",), (None,)], "Title string")
    pairs = [(f"t{i}", f"t{i + 1}") for i in range(60)]
    out = rows.replace_titles(df, pairs)
    assert sorted(map(str, (r[0] for r in out.collect()))) == ["None", "t60", "t60", "x"]
    back = rows.replace_titles(df, [("x", "t0"), ("t0", "y"), ("y", "t7")])
    assert sorted(map(str, (r[0] for r in back.collect()))) == ["None", "t7", "t7", "t7"]


# ---- schema ----------------------------------------------------------------------------------------------------


def test_roles():
    for definition in COLUMN_ROLES.values():
        ordered = column_roles(definition)
        assert [r.role for r in ordered[:2]] == ["id", "time"]
        inputs = [r.type for r in ordered[2:]]
        assert inputs == sorted(inputs, key=["real", "categorical"].index)
    daily = COLUMN_ROLES["heat_daily"]
    assert "diff" not in columns_of(daily, "real", ("id", "time", "target"))
    with pytest.raises(ValueError):
        check_roles(daily[1:])
    with pytest.raises(ValueError):
        check_roles([*daily, daily[0]])


def test_feature_sets_and_config():
    assert feature_columns(5) == sorted(["diff", "tmax", "tsun", "wpgt", "hum_avg"])
    assert "snow" not in feature_columns(2) and "anzahlwhg" not in feature_columns(10)
    assert required_features("building", "hour", []) == feature_columns(15)
    with pytest.raises(ValueError):
        feature_columns(17)
    assert RunConfig(res="hour").lag_in == 72
    with pytest.raises(ValueError):
        RunConfig(n_in=9)
    with pytest.raises(ValueError):
        RunConfig(n_future=8)
