"""Sources, projections, filters and row-level columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.registry import query
from checks.views import Views
from heatloom.functions.tables import shared_folder
from heatloom.operators import rows
from heatloom.sources import readers, writers

READING = "id, datetime, diff, value, source"


def written(v: Views, df, fmt: str, **options) -> str:
    """Write a stand-in as the file an operator reads."""
    path = f"{shared_folder(v.spark)}/heatloom/{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(path)
    return path


@query("scan_readings", f"SELECT {READING} FROM readings WHERE source = 's0'", "readings", "diff value")
def _(v):
    path = written(v, v.readings.filter("source = 's0'").drop("source").withColumn("extra", F.lit(1)), "csv", header=True)
    return readers.scan_readings(v.spark, path, "s0")


@query("union_sources", f"SELECT {READING} FROM readings UNION ALL SELECT {READING} FROM hourly", "readings hourly", "diff value")
def _(v):
    return readers.union_sources([v.readings, v.hourly])


@query(
    "union_diagonal",
    """SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, NULL AS brand FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, NULL FROM supplier
    UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part""",
    floats="bal",
)
def _(v):
    a = v.table("customer").selectExpr("c_custkey k", "c_name name", "c_acctbal bal")
    b = v.table("supplier").selectExpr("s_suppkey k", "s_name name")
    c = v.table("part").selectExpr("p_partkey k", "p_name name", "p_brand brand")
    return readers.union_diagonal([a, b, c])


@query(
    "build_holidays",
    """SELECT state, "start", "end", type FROM holidays WHERE "end" IS NOT NULL
    UNION ALL SELECT state, "start", NULL, type FROM holidays""",
    "holidays",
)
def _(v):
    text = F.date_format("end", "dd.MM.yyyy").alias("end")
    intervals = v.holidays.filter("end is not null").select("state", "start", text, "type")
    single = v.holidays.select("state", "start", F.lit("null").alias("end"), "type")
    return readers.build_holidays(intervals, single)


@query(
    "parse_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS strict_ts,
      CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS loose FROM orders""",
)
def _(v):
    raw = v.table("orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("strict_ts"),
        F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise("null").alias("loose"),
    )
    df = readers.parse_dates(raw, ["strict_ts"])
    return readers.parse_dates(df, ["loose"], "dd.MM.yyyy", strict=False, kind="date")


@query("scan_locale_csv", "SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer", floats="bal")
def _(v):
    df = v.table("customer").selectExpr("c_custkey k", "replace(cast(c_acctbal as string), '.', ',') bal", "c_mktsegment seg")
    schema = T.StructType().add("k", "long").add("bal", "double").add("seg", "string")
    return readers.scan_locale_csv(v.spark, written(v, df, "csv", header=True, sep=";"), schema)


@query("parse_matrix_lines", 'SELECT position, "row", slot, value FROM matrix', "matrix", "value", "position row slot")
def _(v):
    return readers.parse_matrix_lines(v.traffic_lines)


@query(
    "scan_lines",
    "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS line_no, c_name AS line FROM customer",
)
def _(v):
    names = v.table("customer").orderBy("c_custkey").select("c_name").coalesce(1)
    return readers.scan_lines(v.spark, written(v, names, "text"))


@query(
    "cast_schema",
    """SELECT c_custkey AS id, abs(c_acctbal) AS heated_area, c_custkey % 7 AS anzahlwhg,
      TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c_custkey AS INTEGER)) AS datetime FROM customer""",
    floats="heated_area",
)
def _(v):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    raw = v.table("customer").select(
        F.col("c_custkey").alias("id"),
        F.abs("c_acctbal").cast("string").alias("heated_area"),
        (F.col("c_custkey") % 7).cast("string").alias("anzahlwhg"),
        F.timestamp_add("HOUR", F.col("c_custkey").cast("int"), start).cast("string").alias("datetime"),
    )
    return readers.cast_schema(raw, {"heated_area": "double", "anzahlwhg": "bigint"}, ["datetime"])


@query("write_dataset", f"SELECT {READING} FROM readings", "readings", "diff value")
def _(v):
    path = f"{shared_folder(v.spark)}/heatloom/{uuid.uuid4().hex}/{writers.dataset_name('daily')}"
    return writers.write_dataset(v.readings, path, ["source"])


@query("count_sensors", "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_sensors FROM events")
def _(v):
    return readers.count_sensors(v.table("events"), "user_id")


# ---- projections and filters ------------------------------------------------------------------------------------


@query(
    "select_rename_drop",
    "SELECT c_custkey AS id, c_name AS address, c_acctbal AS heated_area FROM customer",
    floats="heated_area",
)
def _(v):
    return rows.select_rename_drop(
        v.table("customer"),
        ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"],
        {"c_custkey": "id", "c_name": "address", "c_acctbal": "heated_area"},
        ["c_mktsegment"],
    )


@query("drop_negative", f"SELECT {READING} FROM dirty WHERE diff >= 0", "dirty", "diff value")
def _(v):
    return rows.drop_negative(v.dirty)


@query("filter_energy", "SELECT * FROM meta WHERE primary_energy = 'gas'", "meta", "heated_area")
def _(v):
    return rows.filter_energy(v.meta, "gas")


@query("require_features", "SELECT * FROM meta WHERE typ IS NOT NULL AND heated_area IS NOT NULL", "meta", "heated_area")
def _(v):
    return rows.require_features(v.meta, ["typ", "heated_area"])


@query(
    "filter_valid_rows",
    f"SELECT {READING} FROM dirty WHERE diff IS NOT NULL AND value > 0 AND id IS NOT NULL",
    "dirty",
    "diff value",
)
def _(v):
    return rows.filter_valid_rows(v.dirty, ["diff"], ["value"])


@query(
    "exclude_ids",
    f"SELECT {READING} FROM readings WHERE CAST(id AS BIGINT) NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0) AND id NOT IN ('1', '2')",
    "readings",
    "diff value",
)
def _(v):
    ids = v.table("customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    return rows.exclude_ids(rows.exclude_ids(v.readings, ids), ["1", "2"])


@query("drop_titles", "SELECT * FROM meters WHERE Title NOT IN ('T1')", "meters", "Val diff")
def _(v):
    return rows.drop_titles(v.meters, ["T1"])


@query(
    "replace_titles",
    """SELECT adresse, CASE Title WHEN 'T0' THEN 'T9' WHEN 'T1' THEN 'T9' ELSE Title END AS Title, new_id, date, Val, diff
    FROM meters""",
    "meters",
    "Val diff",
)
def _(v):
    return rows.replace_titles(v.meters, [("T0", "T1"), ("T1", "T9")])


_SUFFIXED = """SELECT id || CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN '' WHEN 1 THEN '-1' WHEN 2 THEN '-1-2' ELSE '-1-2-3' END AS id,
    datetime FROM readings"""


@query(
    "base_id",
    f"""SELECT id, datetime, regexp_replace(id, '(-\\d+)?-\\d+$', '') AS two, regexp_replace(id, '(-\\d+)*$', '') AS "all"
    FROM ({_SUFFIXED})""",
    "readings",
)
def _(v):
    n = F.col("id").cast("bigint") % 4
    tail = F.when(n == 0, "").when(n == 1, "-1").when(n == 2, "-1-2").otherwise("-1-2-3")
    df = v.readings.select(F.concat("id", tail).alias("id"), "datetime")
    return rows.base_id(rows.base_id(df, "two", out="two"), "all", out="all")


@query(
    "trim_codes",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS plz FROM customer",
)
def _(v):
    text = F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.concat(F.lit("  "), "c_nationkey", F.lit(" ")))
    return rows.trim_codes(v.table("customer").select("c_custkey", text.alias("plz")), ["plz"])


@query(
    "first_plz",
    """SELECT r.id, datetime, CASE WHEN m.id IS NULL THEN NULL WHEN CAST(m.id AS BIGINT) % 4 = 0 THEN 'a' || plz
      WHEN CAST(m.id AS BIGINT) % 4 = 1 THEN 'b' || plz WHEN CAST(m.id AS BIGINT) % 4 = 2 THEN 'c' || plz END AS plz
    FROM readings r LEFT JOIN meta m ON r.id = m.id""",
    "readings meta",
)
def _(v):
    k = F.col("id").cast("bigint") % 4
    metas = [
        v.meta.filter(k <= i).select("id", F.when(k == i, F.concat(F.lit(f" {name}"), "plz", F.lit(" "))).alias("plz"))
        for i, name in enumerate("abc")
    ]
    return rows.first_plz(v.readings.select("id", "datetime"), metas)


@query(
    "null_out_zero",
    """SELECT id, address, plz, coalesce(typ, 'Mehrfamilienhaus') AS typ, primary_energy, nullif(heated_area, 0) AS heated_area,
      CASE WHEN anzahlwhg = 0 AND coalesce(typ, 'Mehrfamilienhaus') = 'Mehrfamilienhaus' THEN NULL ELSE anzahlwhg END AS anzahlwhg
    FROM meta""",
    "meta",
    "heated_area",
)
def _(v):
    return rows.null_out_zero(v.meta)


@query("weekend_flag", "SELECT event_id, CAST(isodow(ts) > 5 AS BIGINT) AS weekend FROM events")
def _(v):
    return rows.weekend_flag(v.table("events").select("event_id", "ts"), "ts").drop("ts")


@query(
    "calendar_parts",
    """SELECT o_orderkey, isodow(o_orderdate) AS weekday, isodow(o_orderdate) - 1 AS day_of_week, day(o_orderdate) AS day_of_month,
      hour(o_orderdate) AS hour, month(o_orderdate) AS month, weekofyear(o_orderdate) AS week_of_year, year(o_orderdate) AS year
    FROM orders""",
    ints="weekday day_of_week day_of_month hour month week_of_year year",
)
def _(v):
    df = v.table("orders").select("o_orderkey", "o_orderdate")
    parts = ["weekday", "day_of_week", "day_of_month", "hour", "month", "week_of_year", "year"]
    return rows.calendar_parts(df, parts, "o_orderdate").drop("o_orderdate")


@query(
    "season",
    """SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%m%d') BETWEEN '0321' AND '0620' THEN 'Spring'
      WHEN strftime(o_orderdate, '%m%d') BETWEEN '0621' AND '0922' THEN 'Summer'
      WHEN strftime(o_orderdate, '%m%d') BETWEEN '0923' AND '1220' THEN 'Fall' ELSE 'Winter' END AS season FROM orders""",
)
def _(v):
    return rows.season(v.table("orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "elapsed_time",
    """SELECT event_id, date_diff('day', DATE '2000-01-03', CAST(ts AS DATE)) AS days_from_start,
      CAST(floor(epoch(ts - (SELECT min(ts) FROM events)) / 3600) AS BIGINT) AS hours_from_start FROM events""",
)
def _(v):
    df = rows.elapsed_time(v.table("events").select("event_id", "ts"), "day", "2000-01-03", "ts")
    return rows.elapsed_time(df, "hour", None, "ts").drop("ts")


@query(
    "cyclic_encode",
    """SELECT id, datetime, sin(2 * pi() * w / (SELECT max(isodow(datetime)) FROM readings)) AS weekday_sin,
      cos(2 * pi() * w / (SELECT max(isodow(datetime)) FROM readings)) AS weekday_cos,
      sin(2 * pi() * d / (SELECT max(day(datetime)) FROM readings)) AS day_of_month_sin,
      cos(2 * pi() * d / (SELECT max(day(datetime)) FROM readings)) AS day_of_month_cos
    FROM (SELECT id, datetime, isodow(datetime) AS w, day(datetime) AS d FROM readings)""",
    "readings",
    "weekday_sin weekday_cos day_of_month_sin day_of_month_cos",
)
def _(v):
    return rows.cyclic_encode(rows.calendar_parts(v.readings.select("id", "datetime")))


@query("log_nonzero", "SELECT Symbol, date, ln(nullif(rv5_ss, 0)) AS log_vol FROM volatility", "volatility", "log_vol")
def _(v):
    return rows.log_nonzero(v.volatility, "rv5_ss", "log_vol").select("Symbol", "date", "log_vol")


@query(
    "static_map",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'web' ELSE 'shop' END AS area FROM events",
)
def _(v):
    areas = {"click": "web", "view": "web", "error": "shop", "purchase": "shop", "signup": "shop"}
    return rows.static_map(v.table("events"), "event_type", areas, "area").select("event_id", "area")


@query(
    "composite_key",
    "SELECT l_orderkey || '_' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') || '_' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS key FROM lineitem",
)
def _(v):
    return rows.composite_key(v.table("lineitem"), ["l_orderkey", "l_suppkey", "l_linenumber"], [None, 5, 3]).select("key")
