"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, one inside the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages").rstrip("/")


#: Setting that removes the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths handed out and not yet deleted; names of the bucketed tables among them.
_PATHS: list[str] = []
_TABLES: dict[str, str] = {}


def _on_store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession) -> str:
    """An unused path in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_folder(spark)}/heatloom/{uuid.uuid4().hex}"
    store, at = _on_store(spark, path)
    store.deleteOnExit(at)
    _PATHS.append(path)
    return path


def stored_paths() -> list[str]:
    """Paths of the stored tables that are still there, oldest first."""
    return list(_PATHS)


def drop_stored(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables; results that read them must have been written before."""
    for path in paths:
        if path in _PATHS:
            store, at = _on_store(spark, path)
            if path in _TABLES:
                spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
            store.delete(at, True)
            _PATHS.remove(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage between heavy stages: later stages scan the pruned columns of a replicated table instead of
    recomputing their inputs, also after an executor is lost. The table is deleted when the session ends, the shuffle
    files that made it as soon as it is there.
    """
    spark = df.sparkSession
    path = new_path(spark)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def store_buckets(df: DataFrame, keys: list[str], order: list[str], buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """``df`` stored in the shared folder in ``buckets`` files by a hash of ``keys``, each sorted by ``order``.

    Spark knows how such a table is dealt out, so windows, aggregates and joins by ``keys`` do not shuffle its rows. The number of buckets
    is that of shuffle partitions if none is given. ``dealt`` rows come from a shuffle by ``keys`` into as many partitions already and are not
    shuffled again. The table is deleted like other stored tables.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    path = new_path(spark)
    name = f"stored_{path.rsplit('/', 1)[-1]}"
    with _shuffles_removed(spark):
        rows = df if dealt else df.repartition(n, *keys)
        rows.write.bucketBy(n, *keys).sortBy(*order).format("parquet").option("path", path).saveAsTable(name)
    _TABLES[path] = name
    return spark.table(name)
