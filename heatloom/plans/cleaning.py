"""Cleaning chains over rows that are laid out once by series and slice, so that steps shuffle seams and counts, never rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.series import DAILY, SLICE, Series
from heatloom.functions.tables import drop_stored, stored_paths
from heatloom.operators.cleaning import (
    drop_flat_lines,
    drop_positive_jumps,
    drop_reconnect_spikes,
    interpolate_linear,
    iqr_filter,
    split_at_gaps,
)
from heatloom.operators.rows import drop_negative
from heatloom.schema import SPLIT_GAP

COLUMNS = ["id", "datetime", "diff", "value", "source"]


def _basic(df: DataFrame, s: Series, flat_lines: int | None) -> DataFrame:
    df = s.laid_out(drop_reconnect_spikes(s.sliced(drop_negative(df)), s), dealt=True)
    return drop_flat_lines(iqr_filter(df, s), s, flat_lines)


def clean_basic(df: DataFrame, s: Series = DAILY, flat_lines: int | None = None) -> DataFrame:
    """Negatives, first readings after gaps, outliers and flat lines, in that order."""
    return _basic(df, s, flat_lines).drop(SLICE)


def clean_interpolated(
    df: DataFrame, s: Series = DAILY, flat_lines: int | None = None, min_gap: int | None = None
) -> DataFrame:
    """Basic cleaning, split at long gaps, fill short ones, clean again, split at what that removed.

    No consumption is negative in the result; the query fails if one is. Three tables are stored one after the other, each deleted when the
    next is there: the rows without negatives and first readings after gaps, those of the basic cleaning (both written where they lie, without a
    shuffle of their own), and the filled parts, whose ids and rows are new.
    """
    min_gap = SPLIT_GAP[s.step] if min_gap is None else min_gap
    since = stored_paths()

    def next_table(rows: DataFrame, dealt: bool = False) -> DataFrame:
        out = s.laid_out(rows, dealt)
        drop_stored(out.sparkSession, [p for p in stored_paths()[:-1] if p not in since])
        return out

    df = next_table(_basic(df, s, flat_lines), dealt=True)
    df = next_table(drop_negative(interpolate_linear(split_at_gaps(df, s, min_gap), s)))
    df = split_at_gaps(drop_positive_jumps(df, s), s, 1).drop(SLICE)
    bad = F.raise_error(F.lit("negative consumption after cleaning")).cast("double")
    return df.withColumn("diff", F.when(F.col("diff") < 0, bad).otherwise(F.col("diff")))
