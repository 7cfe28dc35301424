"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from heatloom.operators import joins, rows

EVENT_HOURS = """SELECT event_id AS id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime, user_id % 25 AS plz FROM events"""


def event_hours(v):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return v.table("events").select(F.col("event_id").alias("id"), hour.alias("datetime"), (F.col("user_id") % 25).alias("plz"))


@query(
    "join_meta",
    """SELECT r.id, r.datetime, r.diff, m.plz, m.typ, m.heated_area FROM readings r
    LEFT JOIN meta m ON regexp_replace(r.id, '(-\\d+)?-\\d+$', '') = m.id""",
    "readings meta",
    "diff heated_area",
)
def _(v):
    meta = v.meta.withColumnRenamed("id", "base_id")
    out = joins.join_meta(rows.base_id(v.readings), meta)
    return out.select("id", "datetime", "diff", "plz", "typ", "heated_area")


@query(
    "join_weather",
    f"SELECT e.id, e.datetime, e.plz, w.temp, w.rhum FROM ({EVENT_HOURS}) e LEFT JOIN (SELECT * FROM weather WHERE hour(datetime) % 5 <> 0) w ON e.datetime = w.datetime AND e.plz = w.plz",
    "weather",
    "temp rhum",
)
def _(v):
    return joins.join_weather(event_hours(v), v.weather.filter(F.hour("datetime") % 5 != 0))


@query(
    "join_meta_lod",
    """SELECT m.id, m.address, m.typ, round(l.c_acctbal * 2, 2) AS heated_area_lod, l.c_custkey % 9 AS storeys
    FROM meta m JOIN customer l ON m.address = l.c_name WHERE l.c_custkey % 4 <> 0""",
    "meta",
    "heated_area_lod",
)
def _(v):
    lod = v.table("customer").filter("c_custkey % 4 <> 0").select(
        F.col("c_name").alias("address"),
        F.col("c_custkey").cast("string").alias("id"),
        F.lit("x").alias("typ"),
        F.lit("town").alias("city"),
        F.round(F.col("c_acctbal") * 2, 2).alias("heated_area"),
        (F.col("c_custkey") % 9).alias("storeys"),
    )
    return joins.join_meta_lod(v.meta.select("id", "address", "typ"), lod, ("city",))


@query(
    "join_state",
    f"SELECT e.*, c.state FROM ({EVENT_HOURS}) e JOIN cities c ON e.plz = c.plz WHERE c.state IS NOT NULL",
    "cities",
)
def _(v):
    return joins.join_state(event_hours(v), v.cities, by="id")


_FLAG = f"""SELECT e.id, e.datetime, e.plz, c.state, CAST(EXISTS (SELECT 1 FROM holidays h WHERE h.state = c.state
      AND {{test}}) AS BIGINT) AS holiday
    FROM ({EVENT_HOURS}) e JOIN cities c ON e.plz = c.plz WHERE c.state IS NOT NULL"""


@query(
    "holiday_flag",
    _FLAG.format(test='CAST(e.datetime AS DATE) BETWEEN h."start" AND coalesce(h."end", h."start")'),
    "cities holidays",
)
def _(v):
    return joins.holiday_flag(joins.join_state(event_hours(v), v.cities, by="id"), v.holidays)


@query(
    "holiday_flag_midnight",
    _FLAG.format(test='hour(e.datetime) = 0 AND CAST(e.datetime AS DATE) BETWEEN h."start" AND h."end"'),
    "cities holidays",
)
def _(v):
    return joins.holiday_flag(joins.join_state(event_hours(v), v.cities, by="id"), v.holidays, "midnight")


@query(
    "join_group_mean",
    "SELECT id, datetime, diff, avg(diff) OVER (PARTITION BY id) AS daily_avg FROM dirty",
    "dirty",
    "diff daily_avg",
)
def _(v):
    return joins.join_group_mean(v.dirty.select("id", "datetime", "diff"), "id")


@query(
    "semi_ids",
    "SELECT * FROM readings WHERE id IN (SELECT id FROM meta WHERE primary_energy = 'gas')",
    "readings meta",
    "diff value",
)
def _(v):
    return joins.semi_ids(v.readings, v.meta.filter("primary_energy = 'gas'"))


@query(
    "anti_ids",
    "SELECT * FROM readings WHERE id NOT IN (SELECT id FROM meta WHERE primary_energy = 'gas')",
    "readings meta",
    "diff value",
)
def _(v):
    return joins.anti_ids(v.readings, v.meta.filter("primary_energy = 'gas'"))


@query("ids_in_both", "SELECT id FROM readings INTERSECT SELECT id FROM meta WHERE typ IS NULL", "readings meta")
def _(v):
    return joins.ids_in_both(v.readings, v.meta.filter("typ is null"))


@query(
    "asof_ffill_join",
    """SELECT s.date, s.store_nbr, s.item_nbr, coalesce(d.oil, -1) AS oil FROM sales s JOIN (
      SELECT date, last_value(oil IGNORE NULLS) OVER (ORDER BY date) AS oil
      FROM (SELECT DISTINCT date FROM sales) LEFT JOIN oil USING (date)) d ON s.date = d.date""",
    "sales oil",
    "oil",
)
def _(v):
    return joins.asof_ffill_join(v.sales.select("date", "store_nbr", "item_nbr"), v.oil, by=["store_nbr", "item_nbr"])


@query(
    "star_enrich",
    """SELECT s.date, s.store_nbr, s.item_nbr, s.unit_sales, city, state, family, class, coalesce(t.transactions, -1) AS transactions
    FROM sales s LEFT JOIN stores USING (store_nbr) LEFT JOIN items USING (item_nbr) LEFT JOIN transactions t USING (date, store_nbr)""",
    "sales stores items transactions",
    "unit_sales",
    "class transactions",
)
def _(v):
    return joins.star_enrich(v.sales.drop("onpromotion"), v.stores, v.items, v.transactions)


@query(
    "scoped_holidays",
    """SELECT s.date, s.store_nbr, s.item_nbr, t.state, t.city,
      coalesce((SELECT min(description) FROM hol_events h WHERE NOT transferred AND locale = 'National' AND h.date = s.date), '') AS national_hol,
      coalesce((SELECT min(description) FROM hol_events h WHERE NOT transferred AND locale = 'Regional' AND h.date = s.date AND h.locale_name = t.state), '') AS regional_hol,
      coalesce((SELECT min(description) FROM hol_events h WHERE NOT transferred AND locale = 'Local' AND h.date = s.date AND h.locale_name = t.city), '') AS local_hol
    FROM sales s JOIN stores t USING (store_nbr)""",
    "sales stores hol_events",
)
def _(v):
    df = v.sales.join(v.stores, "store_nbr").select("date", "store_nbr", "item_nbr", "state", "city")
    return joins.scoped_holidays(df, v.hol_events)


@query(
    "sum_meters",
    """SELECT * FROM meters WHERE adresse <> 'A1' UNION ALL
    SELECT a.adresse, 'Total', a.new_id, a.date, a.Val + b.Val, a.diff FROM (SELECT * FROM meters WHERE adresse = 'A1' AND Title = 'T0') a
    LEFT JOIN (SELECT * FROM meters WHERE adresse = 'A1' AND Title = 'T1') b ON a.date = b.date""",
    "meters",
    "Val diff",
)
def _(v):
    return joins.sum_meters(v.meters, "A1", "T0", "T1", "Total")


@query(
    "subtract_meter",
    """WITH m AS (SELECT * FROM meters WHERE new_id NOT IN ('A1/T0', 'A1/T1') OR day(date) IN (SELECT day(date) FROM meters WHERE new_id = 'A1/T0'
      INTERSECT SELECT day(date) FROM meters WHERE new_id = 'A1/T1'))
    SELECT * FROM m WHERE new_id <> 'A1/T0' UNION ALL
    SELECT a.adresse, 'Rest', a.new_id, a.date, a.Val, a.diff - b.diff FROM (SELECT * FROM m WHERE new_id = 'A1/T0') a
    LEFT JOIN (SELECT * FROM m WHERE new_id = 'A1/T1') b ON a.date = b.date""",
    "meters",
    "Val diff",
)
def _(v):
    first, second = (v.meters.filter(F.col("new_id") == m) for m in ("A1/T0", "A1/T1"))
    both = first.select("date").intersect(second.select("date"))  # only the two meters are cut to common dates
    pair = first.unionByName(second).join(both, "date", "left_semi").select(v.meters.columns)
    others = v.meters.filter(~F.col("new_id").isin("A1/T0", "A1/T1"))
    return joins.subtract_meter(others.unionByName(pair), "A1/T0", "A1/T1", "Rest")


@query(
    "reorder_by_permutation",
    'SELECT 29 - position AS day, "row", slot, value FROM matrix',
    "matrix",
    "value",
    "day row slot",
)
def _(v):
    from heatloom.sources.readers import parse_matrix_lines

    cells = parse_matrix_lines(v.traffic_lines).select("row", "slot", "value", "position")
    return joins.reorder_by_permutation(cells, v.perm).drop("position")
