"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dataset_name(res: str, interpolate: bool = False, features: bool = False) -> str:
    """Name under which a stage of the dataset is stored."""
    return f"dataset_{'interpolate_' if interpolate else ''}{res}{'_feat' if features else ''}"


def write_dataset(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` as parquet, one folder per value of ``partition_by``, and return it as read back."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
