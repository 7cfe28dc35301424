"""Ranks and running totals that never sort a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that one task adds up; and rows that a bucket holds on average.
FAN = 4096


def with_totals_before(counts: DataFrame, by: list[str], bucket: str, n: str, name: str) -> DataFrame:
    """Adds the sum of ``n`` over all smaller buckets of the same group, in two levels of at most ``FAN`` buckets a step."""
    fine = counts.withColumn("_top", F.floor(F.col(bucket) / FAN))
    top = fine.groupBy(*by, "_top").agg(F.sum(n).alias("_sum"))
    above = Window.partitionBy(*by).orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select(*by, "_top", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*by, "_top").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_top"]]
    return fine.alias("a").join(top.alias("b"), same).select(
        *[F.col(f"a.{c}") for c in counts.columns], (F.col("b._above") + F.col("a._inside")).alias(name)
    )


def positions(df: DataFrame, by: list[str], key: Column, low: float, high: float, rows: int, ties: list[str], name: str) -> DataFrame:
    """Adds each row's position from 0 in its group by ascending ``key`` (a number from ``low`` to below ``high``), then ``ties``.

    Rows are dealt to buckets of equal key ranges; a bucket is sorted in one task, and the rows of smaller buckets are
    added up from counts. So keys must be spread evenly over their range, as hashes and fractional ranks are.
    """
    n = max(1, rows // FAN)
    place = F.least(F.greatest(F.floor((key - F.lit(low)) / F.lit((high - low) / n)), F.lit(0)), F.lit(n - 1)).cast("long")
    dealt = df.withColumn("_bucket", place).withColumn("_key", key)
    counts = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = with_totals_before(counts, by, "_bucket", "_n", "_before").drop("_n")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "_bucket"]]
    ranked = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_key", *ties)))
    return ranked.alias("r").join(before.alias("c"), same).select(
        *[F.col(f"r.`{c}`") for c in df.columns], (F.col("c._before") + F.col("r._row") - 1).alias(name)
    )
