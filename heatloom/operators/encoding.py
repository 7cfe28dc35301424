"""Fitted encoders as stored tables, and rows as sparse vectors.

An ``Encoder`` is what one job learns from train and another applies: the place of every category, means and deviations of
numbers. Categories are tables and joins from the scan to the vector; their number has no bound, none is collected and
none becomes a column. A vector is ``size``, ``indices`` (ascending) and ``values``: first the numbers as z-scores, then one
place per category, column after column in alphabetical order, then the columns that stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.functions.order import sorted_offset
from heatloom.functions.skew import spread_join
from heatloom.functions.tables import materialize
from heatloom.operators.scaling import apply_scaler, fit_scaler


@dataclass(frozen=True)
class Encoder:
    """``codes``: ``column``, ``category``, ``place`` among all categories; ``params``: shift and scale of each number."""

    num: tuple[str, ...]
    cat: tuple[str, ...]
    kept: tuple[str, ...]
    target: str | None
    codes: DataFrame
    params: DataFrame
    n_categories: int

    @property
    def size(self) -> int:
        return len(self.num) + self.n_categories + len(self.kept)

    @classmethod
    def fit(cls, train: DataFrame, num: Sequence[str], cat: Sequence[str], kept: Sequence[str] = (), target: str | None = None) -> Encoder:
        """Learned from ``train``: its categories (not null) and the moments of its numbers and of the target."""
        schema = "column string, category string"
        known = train.sparkSession.createDataFrame([], schema)
        if cat:
            pairs = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("category")) for i, c in enumerate(cat)])
            known = train.select(F.inline(pairs)).filter(F.col("category").isNotNull()).distinct()
            known = sorted_offset(known, ["_i", "category"], F.lit(1).cast("long"), "place").select("column", "category", "place")
        else:
            known = known.withColumn("place", F.lit(0).cast("bigint"))
        codes = materialize(known)
        numbers = [*num, *([target] if target else [])]
        params = materialize(fit_scaler(train, numbers)) if numbers else codes.limit(0).select("place")
        return cls(tuple(num), tuple(cat), tuple(kept), target, codes, params, codes.count())

    def save(self, path: str) -> None:
        """Written as tables below ``path``, which must not hold an encoder yet."""
        spark = self.codes.sparkSession
        self.codes.write.parquet(f"{path}/codes")
        self.params.write.parquet(f"{path}/params")
        row = (list(self.num), list(self.cat), list(self.kept), self.target, self.n_categories)
        about = spark.createDataFrame([row], "num array<string>, cat array<string>, kept array<string>, target string, n_categories bigint")
        about.write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoder:
        about = spark.read.parquet(f"{path}/about").first()
        codes, params = spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/params")
        return cls(tuple(about.num), tuple(about.cat), tuple(about.kept), about.target, codes, params, about.n_categories)

    def transform(self, df: DataFrame, by: Sequence[str] | str = "datetime") -> DataFrame:
        """``df`` with ``size``, ``indices``, ``values``, and the target scaled. Unseen and null categories have no entry, null numbers neither.

        ``by`` are columns that vary among rows of one category, which they are spread by.
        """
        own = {f"_raw{i}": F.col(f"`{c}`") for i, c in enumerate((*self.num, *self.kept))}
        rows = df.withColumns(own) if own else df
        numbers = [*self.num, *([self.target] if self.target else [])]
        rows = apply_scaler(rows, self.params, numbers) if numbers else rows
        places = []
        for i, c in enumerate(self.cat):
            mine = self.codes.filter(F.col("column") == c).select(F.col("category").alias("_cat"), F.col("place").alias(f"_place{i}"))
            rows = spread_join(rows.withColumn("_cat", F.col(f"`{c}`").cast("string")), mine, "_cat", by=by).drop("_cat")
            places.append(f"_place{i}")
        first, last = len(self.num), len(self.num) + self.n_categories
        entry = lambda index, value: F.when(index.isNotNull() & value.isNotNull(), F.struct(index.cast("bigint").alias("i"), value.cast("double").alias("v")))
        entries = [entry(F.lit(i), F.col(f"`{c}`")) for i, c in enumerate(self.num)]
        entries += [entry(F.col(p) + first, F.lit(1.0)) for p in places]
        entries += [entry(F.lit(last + i), F.col(f"_raw{len(self.num) + i}")) for i in range(len(self.kept))]
        rows = rows.withColumn("_entries", F.array_compact(F.array(*entries)))
        rows = rows.withColumns({c: F.col(f"_raw{i}") for i, c in enumerate(self.num)} if self.num else {"_entries": F.col("_entries")})
        rows = rows.withColumns(
            {"size": F.lit(self.size).cast("bigint"), "indices": F.transform("_entries", lambda e: e["i"]), "values": F.transform("_entries", lambda e: e["v"])}
        )
        return rows.select(*df.columns, "size", "indices", "values")

    def inverse(self, pred: DataFrame, cols: Sequence[str] = ("y_hat",)) -> DataFrame:
        """Predictions of the scaled target in its own units."""
        if not self.target:
            raise ValueError("the encoder was fitted without a target")
        return apply_scaler(pred, self.params, cols, inverse=True, params_of=self.target)
