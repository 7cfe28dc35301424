"""Run registered queries and compare them with their SQL: ``python -m checks.verify [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

from checks import load
from heatloom.session import session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def table(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].replace(".", "").isdigit() else "0.01"
    folder = f"/root/testdata/sf{sf}"
    queries, oracles = load()
    names = args or list(queries)
    spark = session("verify", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        begin = time.time()
        try:
            df = queries[name](spark, folder)
            got = table(df.columns, [tuple(r) for r in df.collect()])
            spent = time.time() - begin
            if name not in oracles:
                print(f"rows {name}: {len(got)} rows, {spent:.1f}s", flush=True)
                continue
            rel = con.sql(oracles[name])
            want = table(rel.columns, rel.fetchall())
            if sorted(df.columns) != sorted(rel.columns):
                verdict = f"COLUMNS {sorted(df.columns)} vs {sorted(rel.columns)}"
            elif got != want:
                a, b = {repr(r) for r in got}, {repr(r) for r in want}
                only = sorted(a - b)[:2], sorted(b - a)[:2]
                verdict = f"DIFFER {len(got)} vs {len(want)} rows\n   spark {only[0]}\n   sql   {only[1]}"
            else:
                kinds = {c: t for c, t in zip(rel.columns, map(str, rel.types), strict=True)}
                odd = [f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes if not same_type(t, kinds[c])]
                verdict = "ok" + (f" TYPES {odd}" if odd else "")
        except Exception as e:  # noqa: BLE001
            spent = time.time() - begin
            verdict = "ERROR " + "".join(traceback.format_exception_only(e))[:1500]
        bad += not verdict.startswith("ok")
        n = len(got) if verdict.startswith("ok") else "-"
        print(f"{verdict} {name}: {n} rows, {spent:.1f}s", flush=True)
    print("failed", bad, "of", len(names))
    return bad


TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def same_type(spark: str, sql: str) -> bool:
    return TYPE.get(spark, spark) == sql


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
