"""Stand-ins for meter data, made from the provided tables: once for Spark, once as SQL."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom import Series
from heatloom.functions.tables import shared_folder
from heatloom.operators.forecast import to_long
from heatloom.operators.frames import lag_lead_columns

# The data spans 30 days; short slices and runs make every query cross their borders.
D = Series("day", points=7, chunk=16)
H = Series("hour", points=48, chunk=64)

TYPES = ["click", "error", "purchase", "signup", "view"]

SQL: dict[str, tuple[list[str], str]] = {
    "readings": (
        [],
        """
        SELECT id, datetime, diff, round(sum(diff) OVER (PARTITION BY id ORDER BY datetime), 2) AS value, source FROM (
          SELECT CAST(user_id AS VARCHAR) AS id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS datetime,
                 round(sum(value), 2) AS diff, CASE WHEN user_id % 2 = 0 THEN 's0' ELSE 's1' END AS source
          FROM events GROUP BY user_id, 2)""",
    ),
    "hourly": (
        [],
        """
        SELECT id, datetime, diff, round(sum(diff) OVER (PARTITION BY id ORDER BY datetime), 2) AS value, source FROM (
          SELECT event_type AS id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime,
                 round(sum(value), 2) AS diff, 's0' AS source
          FROM events GROUP BY event_type, 2)""",
    ),
    "dirty": (
        ["readings"],
        """
        SELECT id, datetime, value, source,
          CASE WHEN (u + d) % 29 = 0 THEN NULL WHEN (u + d) % 17 = 0 THEN -diff
               WHEN u % 5 = 0 AND d BETWEEN 8 AND 14 THEN 0.0 WHEN (u * 7 + d) % 53 = 0 THEN diff * 60 ELSE diff END AS diff
        FROM (SELECT *, CAST(id AS BIGINT) AS u, day(datetime) AS d FROM readings)
        WHERE NOT (u % 4 = 1 AND d BETWEEN 16 AND 24)""",
    ),
    "dirty_hourly": (
        ["hourly"],
        """
        SELECT id, datetime, value, source,
          CASE WHEN (u + h) % 29 = 0 THEN NULL WHEN (u + h) % 17 = 0 THEN -diff
               WHEN u = 5 AND h % 24 BETWEEN 8 AND 14 THEN 0.0 WHEN (u * 7 + h) % 53 = 0 THEN diff * 60 ELSE diff END AS diff
        FROM (SELECT *, length(id) AS u, day(datetime) * 24 + hour(datetime) AS h FROM hourly)
        WHERE NOT (u = 4 AND h BETWEEN 300 AND 340)""",
    ),
    "user_hours": (
        [],
        """
        SELECT CAST(user_id AS VARCHAR) AS id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime, round(sum(value), 2) AS diff
        FROM events GROUP BY 1, 2""",
    ),
    "meta": (
        [],
        """
        SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS address, CAST(c_nationkey AS BIGINT) AS plz,
          CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS typ,
          CASE c_custkey % 3 WHEN 0 THEN 'gas' WHEN 1 THEN 'district heating' ELSE 'oil' END AS primary_energy,
          CASE WHEN c_custkey % 13 = 0 THEN 0.0 ELSE abs(c_acctbal) END AS heated_area,
          c_custkey % 7 AS anzahlwhg
        FROM customer""",
    ),
    "cities": (
        [],
        """
        SELECT CAST(n_nationkey AS BIGINT) AS plz, CASE WHEN n_nationkey <> 3 THEN r_name END AS state
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "holidays": (
        [],
        """
        SELECT r_name AS state, CAST(DATE '2024-01-02' + CAST(r_regionkey * 3 AS INTEGER) AS DATE) AS "start",
          CASE WHEN r_regionkey % 2 = 0 THEN CAST(DATE '2024-01-05' + CAST(r_regionkey * 3 AS INTEGER) AS DATE) END AS "end",
          'h' || r_regionkey AS type
        FROM region WHERE r_regionkey < 4""",
    ),
    "weather": (
        [],
        """
        SELECT user_id % 25 AS plz, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime,
          avg(value) AS temp, 100 * avg(value) / (avg(value) + 50) AS rhum
        FROM events GROUP BY 1, 2""",
    ),
    "weather_daily": (
        [],
        """
        SELECT user_id % 25 AS plz, CAST(date_trunc('day', ts) AS TIMESTAMP) AS datetime,
          avg(value) AS tavg, min(value) AS tmin, max(value) AS tmax, count(*) AS prcp
        FROM events GROUP BY 1, 2""",
    ),
    "pred": (
        ["readings"],
        """
        SELECT id, datetime, h, CASE h WHEN 0 THEN a ELSE b END AS y, CASE h WHEN 0 THEN p ELSE q END AS y_hat FROM (
          SELECT id, datetime, diff AS a, lead(diff, 1) OVER w AS b, lag(diff, 2) OVER w AS p, lag(diff, 1) OVER w AS q
          FROM readings WINDOW w AS (PARTITION BY id ORDER BY datetime)), (VALUES (0), (1)) AS t(h)
        WHERE b IS NOT NULL AND p IS NOT NULL""",
    ),
    "labels_of": (["readings"], "SELECT DISTINCT id, CAST(id AS BIGINT) % 3 AS label FROM readings"),
    "meters": (
        [],
        """
        SELECT 'A' || (user_id % 20) AS adresse, 'T' || (user_id // 20 % 3) AS Title,
          'A' || (user_id % 20) || '/T' || (user_id // 20 % 3) AS new_id, CAST(ts AS DATE) AS date,
          round(sum(value), 2) AS Val, CAST(count(*) AS DOUBLE) AS diff
        FROM events GROUP BY 1, 2, 3, 4""",
    ),
    "split_rows": (
        ["readings"],
        """
        SELECT *, CASE WHEN i <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
          WHEN i <= floor(n * ((1 - CAST(0.8 AS DOUBLE)) / 2 + CAST(0.8 AS DOUBLE))) THEN 'test' ELSE 'val' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY datetime) - 1 AS i, count(*) OVER (PARTITION BY id) AS n
              FROM readings)""",
    ),
    "split_dirty": (
        ["dirty"],
        """
        SELECT *, CASE WHEN i <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
          WHEN i <= floor(n * ((1 - CAST(0.8 AS DOUBLE)) / 2 + CAST(0.8 AS DOUBLE))) THEN 'test' ELSE 'val' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY datetime) - 1 AS i, count(*) OVER (PARTITION BY id) AS n
              FROM dirty)""",
    ),
    "sales": (
        [],
        """
        SELECT CAST(o_orderdate AS TIMESTAMP) AS date, l_suppkey AS store_nbr, l_partkey AS item_nbr,
          CASE WHEN l_partkey % 50 = 0 THEN -sum(l_quantity) ELSE sum(l_quantity) END AS unit_sales,
          max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS onpromotion
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    ),
    "stores": (
        [],
        """
        SELECT s_suppkey AS store_nbr, 'C' || s_nationkey AS city, 'S' || (s_nationkey % 5) AS state FROM supplier""",
    ),
    "items": ([], "SELECT p_partkey AS item_nbr, p_type AS family, p_size AS class FROM part"),
    "oil": (
        [],
        """
        SELECT CAST(o_orderdate AS TIMESTAMP) AS date, CASE WHEN day(o_orderdate) % 5 <> 4 THEN min(o_totalprice) END AS oil
        FROM orders WHERE day(o_orderdate) % 3 <> 0 GROUP BY o_orderdate""",
    ),
    "transactions": (
        ["sales"],
        "SELECT date, store_nbr, count(*) AS transactions FROM sales WHERE store_nbr % 3 <> 0 GROUP BY 1, 2",
    ),
    "hol_events": (
        [],
        """
        SELECT CAST(o_orderdate AS TIMESTAMP) AS date,
          CASE n_nationkey % 3 WHEN 0 THEN 'National' WHEN 1 THEN 'Regional' ELSE 'Local' END AS locale,
          CASE n_nationkey % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'S' || (n_nationkey % 5) ELSE 'C' || n_nationkey END AS locale_name,
          n_name AS description, n_nationkey % 7 = 0 AS transferred
        FROM (SELECT DISTINCT o_orderdate FROM orders) JOIN nation ON day(o_orderdate) = n_nationkey""",
    ),
    "volatility": (
        [],
        """
        SELECT n_name AS Symbol, CAST(o_orderdate AS TIMESTAMP) AS date,
          CASE WHEN day(o_orderdate) % 5 = 0 THEN 0.0 ELSE max(o_totalprice) / 1000000 END AS rv5_ss,
          round(max(o_totalprice) - min(o_totalprice), 2) AS open_to_close
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderdate""",
    ),
    "quarter_hours": (
        [],
        """
        SELECT time_bucket(INTERVAL '15 minutes', ts) AS ts, event_type AS id, avg(value) AS usage
        FROM events GROUP BY 1, 2""",
    ),
    "cells": (
        [],
        """
        SELECT day(ts) - 1 AS position, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS "row",
          hour(ts) * 6 + minute(ts) // 10 AS slot, round(sum(value), 2) AS value
        FROM events GROUP BY 1, 2, 3""",
    ),
    "matrix": (
        ["cells"],
        """
        SELECT position, "row", slot, coalesce(value, 0.0) AS value
        FROM (SELECT DISTINCT position FROM cells) CROSS JOIN (SELECT unnest(range(5)) AS "row")
        CROSS JOIN (SELECT unnest(range(144)) AS slot) LEFT JOIN cells USING (position, "row", slot)""",
    ),
}


_STORED: dict[tuple[str, str, str], str] = {}


def stored(make):
    """A stand-in that is written once per application and data folder, so that a query times its own work."""

    def read(self: Views) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, make.__name__)
        if key not in _STORED:
            _STORED[key] = f"{shared_folder(self.spark)}/heatloom/views/{uuid.uuid4().hex}"
            make(self).write.parquet(_STORED[key])
        return self.spark.read.parquet(_STORED[key])

    read.__name__ = make.__name__
    return read


class Views:
    """The stand-ins as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def counters(self, key: str, unit: str, source) -> DataFrame:
        sums = (
            self.table("events")
            .groupBy(F.col(key).cast("string").alias("id"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("datetime"))
            .agg(F.round(F.sum("value"), 2).alias("diff"))
        )
        s = D if unit == "day" else H
        rows = s.running_sum(sums, "diff", "value").withColumn("value", F.round("value", 2))
        return rows.select("id", "datetime", "diff", "value", source.alias("source"))

    @cached_property
    @stored
    def readings(self) -> DataFrame:
        return self.counters("user_id", "day", F.when(F.col("id").cast("bigint") % 2 == 0, "s0").otherwise("s1"))

    @cached_property
    @stored
    def hourly(self) -> DataFrame:
        return self.counters("event_type", "hour", F.lit("s0"))

    @cached_property
    def dirty(self) -> DataFrame:
        u, d = F.col("id").cast("bigint"), F.dayofmonth("datetime")
        diff = (
            F.when((u + d) % 29 == 0, None)
            .when((u + d) % 17 == 0, -F.col("diff"))
            .when((u % 5 == 0) & d.between(8, 14), 0.0)
            .when((u * 7 + d) % 53 == 0, F.col("diff") * 60)
            .otherwise(F.col("diff"))
        )
        return self.readings.filter(~((u % 4 == 1) & d.between(16, 24))).withColumn("diff", diff)

    @cached_property
    def dirty_hourly(self) -> DataFrame:
        u, h = F.length("id"), F.dayofmonth("datetime") * 24 + F.hour("datetime")
        diff = (
            F.when((u + h) % 29 == 0, None)
            .when((u + h) % 17 == 0, -F.col("diff"))
            .when((u == 5) & (h % 24).between(8, 14), 0.0)
            .when((u * 7 + h) % 53 == 0, F.col("diff") * 60)
            .otherwise(F.col("diff"))
        )
        return self.hourly.filter(~((u == 4) & h.between(300, 340))).withColumn("diff", diff)

    @cached_property
    def user_hours(self) -> DataFrame:
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
        return self.table("events").groupBy(F.col("user_id").cast("string").alias("id"), hour.alias("datetime")).agg(
            F.round(F.sum("value"), 2).alias("diff")
        )

    @cached_property
    def meta(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.cast("string").alias("id"),
            F.col("c_name").alias("address"),
            F.col("c_nationkey").cast("bigint").alias("plz"),
            F.when(k % 11 != 0, F.col("c_mktsegment")).alias("typ"),
            F.when(k % 3 == 0, "gas").when(k % 3 == 1, "district heating").otherwise("oil").alias("primary_energy"),
            F.when(k % 13 == 0, 0.0).otherwise(F.abs("c_acctbal")).alias("heated_area"),
            (k % 7).alias("anzahlwhg"),
        )

    @cached_property
    def cities(self) -> DataFrame:
        pairs = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return pairs.select(
            F.col("n_nationkey").cast("bigint").alias("plz"),
            F.when(F.col("n_nationkey") != 3, F.col("r_name")).alias("state"),
        )

    @cached_property
    def holidays(self) -> DataFrame:
        k = F.col("r_regionkey")
        day = lambda text: F.date_add(F.lit(text).cast("date"), k * 3)
        return self.table("region").filter(k < 4).select(
            F.col("r_name").alias("state"),
            day("2024-01-02").alias("start"),
            F.when(k % 2 == 0, day("2024-01-05")).alias("end"),
            F.concat(F.lit("h"), k).alias("type"),
        )

    @cached_property
    def weather(self) -> DataFrame:
        mean = F.avg("value")
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime")
        return self.table("events").groupBy((F.col("user_id") % 25).alias("plz"), hour).agg(
            mean.alias("temp"), (100 * mean / (mean + 50)).alias("rhum")
        )

    @cached_property
    def weather_daily(self) -> DataFrame:
        day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("datetime")
        return self.table("events").groupBy((F.col("user_id") % 25).alias("plz"), day).agg(
            F.avg("value").alias("tavg"),
            F.min("value").alias("tmin"),
            F.max("value").alias("tmax"),
            F.count(F.lit(1)).alias("prcp"),
        )

    @cached_property
    @stored
    def pred(self) -> DataFrame:
        rows = lag_lead_columns(self.readings.select("id", "datetime", "diff"), 2, 2, D)
        rows = rows.dropna(subset=["diff(t-2)", "diff(t+1)"])
        c = lambda n: F.col(f"`{n}`")
        return to_long(rows, F.array("diff", c("diff(t+1)")), F.array(c("diff(t-2)"), c("diff(t-1)")), D)

    @cached_property
    def labels_of(self) -> DataFrame:
        ids = self.table("events").select(F.col("user_id").cast("string").alias("id")).distinct()
        return ids.withColumn("label", F.col("id").cast("bigint") % 3)

    @cached_property
    def meters(self) -> DataFrame:
        address = F.concat(F.lit("A"), F.col("user_id") % 20)
        title = F.concat(F.lit("T"), F.floor(F.col("user_id") / 20) % 3)
        return (
            self.table("events")
            .groupBy(
                address.alias("adresse"),
                title.alias("Title"),
                F.concat_ws("/", address, title).alias("new_id"),
                F.to_date("ts").alias("date"),
            )
            .agg(F.round(F.sum("value"), 2).alias("Val"), F.count(F.lit(1)).cast("double").alias("diff"))
        )

    @cached_property
    @stored
    def sales(self) -> DataFrame:
        lines = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        quantity = F.sum("l_quantity")
        return lines.groupBy(
            F.col("o_orderdate").alias("date"), F.col("l_suppkey").alias("store_nbr"), F.col("l_partkey").alias("item_nbr")
        ).agg(
            F.when(F.col("l_partkey") % 50 == 0, -quantity).otherwise(quantity).alias("unit_sales"),
            F.max(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("onpromotion"),
        )

    @cached_property
    def stores(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("store_nbr"),
            F.concat(F.lit("C"), "s_nationkey").alias("city"),
            F.concat(F.lit("S"), F.col("s_nationkey") % 5).alias("state"),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("item_nbr"), F.col("p_type").alias("family"), F.col("p_size").alias("class")
        )

    @cached_property
    def oil(self) -> DataFrame:
        day = F.dayofmonth("o_orderdate")
        price = F.when(day % 5 != 4, F.min("o_totalprice"))
        return (
            self.table("orders").filter(day % 3 != 0).groupBy("o_orderdate").agg(price.alias("oil"))
            .withColumnRenamed("o_orderdate", "date")
        )

    @cached_property
    def transactions(self) -> DataFrame:
        return self.sales.filter(F.col("store_nbr") % 3 != 0).groupBy("date", "store_nbr").agg(
            F.count(F.lit(1)).alias("transactions")
        )

    @cached_property
    def hol_events(self) -> DataFrame:
        n = F.col("n_nationkey")
        dates = self.table("orders").select(F.col("o_orderdate").alias("date")).distinct()
        pairs = dates.withColumn("n_nationkey", F.dayofmonth("date")).join(self.table("nation"), "n_nationkey")
        return pairs.select(
            "date",
            F.when(n % 3 == 0, "National").when(n % 3 == 1, "Regional").otherwise("Local").alias("locale"),
            F.when(n % 3 == 0, "E")
            .when(n % 3 == 1, F.concat(F.lit("S"), n % 5))
            .otherwise(F.concat(F.lit("C"), n))
            .alias("locale_name"),
            F.col("n_name").alias("description"),
            (n % 7 == 0).alias("transferred"),
        )

    @cached_property
    @stored
    def volatility(self) -> DataFrame:
        rows = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        day = F.dayofmonth("o_orderdate")
        return (
            rows.groupBy(F.col("n_name").alias("Symbol"), F.col("o_orderdate"))
            .agg(
                F.when(day % 5 == 0, 0.0).otherwise(F.max("o_totalprice") / 1000000).alias("rv5_ss"),
                F.round(F.max("o_totalprice") - F.min("o_totalprice"), 2).alias("open_to_close"),
            )
            .withColumnRenamed("o_orderdate", "date")
        )

    @cached_property
    @stored
    def quarter_hours(self) -> DataFrame:
        start = F.timestamp_seconds(F.floor(F.col("ts").cast("timestamp").cast("long") / 900) * 900)
        return (
            self.table("events")
            .groupBy(start.cast("timestamp_ntz").alias("start"), F.col("event_type").alias("id"))
            .agg(F.avg("value").alias("usage"))
            .withColumnRenamed("start", "ts")
        )

    @cached_property
    def electricity_wide(self) -> DataFrame:
        return self.quarter_hours.groupBy("ts").pivot("id", TYPES).agg(F.first("usage"))

    @cached_property
    @stored
    def traffic_lines(self) -> DataFrame:
        """One text line per day: sensors separated by ``;``, ten-minute sums by blanks."""
        slot = (F.hour("ts") * 6 + F.floor(F.minute("ts") / 10)).cast("int")
        cells = (
            self.table("events")
            .groupBy((F.dayofmonth("ts") - 1).alias("position"), "event_type", slot.alias("slot"))
            .agg(F.round(F.sum("value"), 2).alias("v"))
        )
        texts = [F.max(F.when(F.col("slot") == i, F.col("v"))) for i in range(144)]
        rows = cells.groupBy("position", "event_type").agg(F.array(*texts).alias("_v"))
        line = F.concat_ws(" ", F.transform("_v", lambda x: F.coalesce(x, F.lit(0.0)).cast("string")))
        rows = rows.select("position", "event_type", line.alias("_row"))
        sensors = [F.max(F.when(F.col("event_type") == t, F.col("_row"))) for t in TYPES]
        empty = " ".join(["0.0"] * 144)
        text = F.concat_ws(";", *[F.coalesce(c, F.lit(empty)) for c in sensors])
        return rows.groupBy("position").agg(F.concat(F.lit("["), text, F.lit("]")).alias("line"))

    def days(self) -> DataFrame:
        return self.table("events").select((F.dayofmonth("ts") - 1).cast("bigint").alias("position")).distinct()

    @cached_property
    def perm(self) -> DataFrame:
        """Shuffled position to one-based original day: the days in reverse."""
        return self.days().withColumn("value", F.lit(30) - F.col("position"))

    @cached_property
    def weekdays(self) -> DataFrame:
        return self.days().withColumn("value", (F.col("position") * 3) % 7 + 1)

    @cached_property
    def stations(self) -> DataFrame:
        types = self.table("events").select("event_type").distinct()
        place = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type"))
        return types.select((place - 1).cast("int").alias("position"), (place * 100).cast("bigint").alias("value"))
