"""A corpus pipeline in five stages: quality rules, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes each result as Parquet to the shared folder and reads it again for the next stage.
A stage deletes what the stage before it has stored for itself, since that stage's result has been written by then.

1. quality: documents that fail the adaptive quality rules go.
2. near_duplicates: of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays.
3. decontamination: documents that contain a ten-word window of a benchmark item go.
4. mixing: nothing goes; rows are sorted into the order of the Pfair schedule, which the files keep.
5. tokens: the texts are encoded in the order of the files, and the token files are read back, one row per document.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.functions.tables import drop_stored, materialize, new_path, stored_paths
from heatloom.llm import decontamination, mixing, near_copies, quality, token_store
from heatloom.llm.places import scan

TOKENIZER = "word_bpe_49k.json"
_OF_LAST_STAGE: list[str] = []


def stage(function):
    """Deletes what the last stage stored, and notes what this one stores."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stored(spark, _OF_LAST_STAGE)
        before = set(stored_paths())
        out = function(spark, docs, sf_dir)
        _OF_LAST_STAGE[:] = [p for p in stored_paths() if p not in before]
        return out

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Order: file after file (their names are numbered), row after row, as the mixing stage sorted them."""
    stored = scan(docs).select(
        "doc_id", "text", F.length("_metadata.file_name").alias("name_length"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("row_index")
    )
    path = new_path(spark)
    token_store.write_store(stored, path, public_tokenizers.path(TOKENIZER), ["name_length", "name", "row_index"])
    return token_store.read_documents(spark, path)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL cannot express fingerprints, components or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, function in STAGES[:-1]:
        docs, read = materialize(function(spark, docs, sf_dir)), before
        before = stored_paths()[-1:]
        drop_stored(spark, read)
    return STAGES[-1][1](spark, docs, sf_dir)
