"""Shards that match the mixture: proportional stratified interleaving, DataFrame functions only.

Rows of each source are ranked in a seeded random order. A row's fractional rank (rank + start) / rows of the source, with ranks from 0 and
a start between 0 and 1 that a hash gives each source, says how far through its source it is; sorted by it, all sources run out evenly, and a
cut into equal parts gives every shard its share of every source, within one row or two, and row counts that are at most one apart (law ``rows``).
The starts keep rows of the same rank in many small sources (hosts with one page) apart, which would share one key otherwise.

Neither the ranks nor the sort put a source or the table into one task: rows are dealt to buckets of equal key ranges, only
counts of buckets are added up, and a bucket of some thousand rows is ordered by itself (see ``order.positions``).

Defined results: a null text has no bytes; a null source is a source of its own; repeated rows get places next to each
other in the order of their source, in any order among themselves; texts of any length count whole; an empty table gives an empty table. Only ``doc_id``,
``text`` and ``source`` are read, so other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions.tables import materialize
from heatloom.llm.order import positions

SHARDS, SEED, ROW_BYTES = 24, 11, 8


def fractional_rank(seed: int = SEED) -> Column:
    """How far through its source a row is, from its ``source_rank`` and the number of rows ``of_source``."""
    start = (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return (F.col("source_rank") + start) / F.col("of_source")


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``text_crc32``, ``source_rank``, ``shard``, ``slot`` in the shard."""
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    key = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "text_crc32").cast("double")
    total = rows.count()
    ties = ["doc_id", "text_crc32", "size"]
    sizes = rows.groupBy("source").agg(F.count("*").alias("of_source"))
    ranked = positions(rows, ["source"], key, -(2.0**63), 2.0**63, total, ties, "source_rank")
    ranked = ranked.alias("r").join(sizes.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.of_source")
    placed = positions(ranked, [], fractional_rank(seed), 0.0, 1.0, total, ["source", "source_rank"], "place")
    # whole numbers only, so that no rounding moves a border
    shard = F.expr(f"cast(place * {shards} div {max(1, total)} as int)")
    first = f"((shard * {total}L + {shards - 1}) div {shards})"
    return placed.withColumn("shard", shard).withColumn("slot", F.expr(f"place - {first}")).drop("place", "of_source")


def sharding_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: size, crc, law ``rows``, shard, slot."""
    return interleaved(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "source_rank"
    )


def mixture(sharded: DataFrame) -> DataFrame:
    """Rows of each source in each shard, and its share of the shard."""
    n = sharded.groupBy("shard", "source").agg(F.count("*").alias("rows"))
    return n.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("shard")))
