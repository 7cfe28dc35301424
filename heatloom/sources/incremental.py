"""A stored dataset that takes in new readings by rewriting only the time slices they touch.

``<path>/rows`` holds the readings with their consumption, ``<path>/seam`` the last reading of every series and slice, both partitioned by
source and slice. A reading changes its own consumption and that of the next reading of its series, so new rows touch their slices and, per
series, the next slice that has any. Those partitions are read, merged and replaced; what comes before them is known from the seam. The result is that of
one run over all readings, whatever the batches, and running a batch again changes nothing, which is how a broken run is mended.

Defined results: a reading that comes again replaces the one of the same series and time; rows without source, series or time are an error.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatloom.functions.series import DAILY, SLICE, Series
from heatloom.functions.tables import drop_stored, materialize, stored_paths

PART = ["source", "slice"]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).withColumn("source", F.col("source").cast("string"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition() or e):
            return None
        raise


def _among(parts: dict[str, list[int]]) -> Column:
    """Filter on partitions, which the scan prunes by."""
    out = F.lit(False)
    for source, slices in parts.items():
        out = out | ((F.col("source") == source) & F.col("slice").isin(slices))
    return out


def _replace(df: DataFrame, path: str) -> None:
    df.write.partitionBy(*PART).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def ingest(new: DataFrame, path: str, s: Series = DAILY, counter: str = "value", out: str = "diff") -> dict[str, list[int]]:
    """Takes the readings ``new`` (``source``, id, time, ``counter``) into the dataset at ``path``; the slices rewritten, by source.

    ``out`` is the step of the counter since the previous reading of the series, null at its first one.
    """
    spark, since = new.sparkSession, stored_paths()
    key = ["source", s.id]
    missing = F.col("source").isNull() | F.col(s.id).isNull() | F.col(s.time).isNull()
    named = F.when(missing, F.raise_error(F.lit("a reading without source, series or time")).cast("string")).otherwise(F.col("source").cast("string"))
    fresh = s.sliced(new.select(named.alias("source"), s.id, s.time, counter)).withColumnRenamed(SLICE, "slice")
    fresh = materialize(fresh.groupBy(*key, "slice", s.time).agg(F.max(counter).alias(counter)))
    rows, seam = _read(spark, f"{path}/rows"), _read(spark, f"{path}/seam")
    hit = fresh.select(*key, "slice").distinct()
    if seam is not None:  # the next slice that a touched series has
        mine = seam.select(*key, F.col("slice").alias("_at"))
        later = hit.join(mine, key).filter(F.col("_at") > F.col("slice")).groupBy(*key, "slice").agg(F.min("_at").alias("_at"))
        hit = hit.unionAll(later.select(*key, F.col("_at").alias("slice")))
    parts: dict[str, list[int]] = {}
    for r in hit.select(*PART).distinct().orderBy(*PART).collect():  # partitions that are rewritten
        parts.setdefault(r["source"], []).append(r["slice"])
    if not parts:
        return parts
    merged = fresh
    if rows is not None:
        old = rows.filter(_among(parts)).select(fresh.columns)
        merged = merged.unionByName(old.join(fresh, [*key, s.time], "left_anti").select(fresh.columns))
    merged = materialize(merged)
    ends = merged.groupBy(*key, "slice").agg(F.max(s.time).alias("last"), F.max_by(counter, s.time).alias("reading"))
    known = ends if seam is None else ends.unionByName(seam.filter(~_among(parts)).select(ends.columns).join(merged.select(*key).distinct(), key, "left_semi"))
    before = known.select(*key, "slice", F.lag("reading").over(Window.partitionBy(*key).orderBy("slice")).alias("_before"))
    inside = F.lag(counter).over(Window.partitionBy(*key, "slice").orderBy(s.time))
    first = F.row_number().over(Window.partitionBy(*key, "slice").orderBy(s.time)) == 1
    done = merged.withColumns({"_inside": inside, "_first": first}).join(before, [*key, "slice"])
    step = F.col(counter) - F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_inside"))
    _replace(materialize(done.select(s.id, s.time, counter, step.alias(out), *PART)), f"{path}/rows")
    _replace(materialize(ends.select(s.id, "last", "reading", *PART)), f"{path}/seam")
    drop_stored(spark, [p for p in stored_paths() if p not in since])
    return parts


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """The readings of the dataset with their consumption."""
    rows = _read(spark, f"{path}/rows")
    if rows is None:
        raise ValueError(f"there is no dataset at {path}")
    return rows.drop("slice")
