"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix patterns of split series (fixed values): at most two suffixes, or all of them.
SUFFIX = {"two": r"(-\d+)?-\d+$", "all": r"(-\d+)*$"}


def base_of(id_col: Column | str, mode: str = "two") -> Column:
    """Id of the series a split part comes from."""
    if mode not in SUFFIX:
        raise ValueError(f"mode must be one of {sorted(SUFFIX)}")
    return F.regexp_replace(id_col, SUFFIX[mode], "")


def weekend(time: Column | str) -> Column:
    """1 on Saturday and Sunday, else 0."""
    return (F.weekday(time) > 4).cast("bigint")


def season_of(time: Column | str) -> Column:
    """Astronomical season; the boundaries are 21 March, 21 June, 23 September and 21 December."""
    day = F.month(time) * 100 + F.dayofmonth(time)
    return (
        F.when(day.between(321, 620), "Spring")
        .when(day.between(621, 922), "Summer")
        .when(day.between(923, 1220), "Fall")
        .otherwise("Winter")
    )


CALENDAR = {
    "weekday": lambda t: F.weekday(t) + 1,  # ISO, Monday is 1
    "day_of_week": lambda t: F.weekday(t),  # Monday is 0
    "day_of_month": lambda t: F.dayofmonth(t),
    "hour": lambda t: F.hour(t),
    "month": lambda t: F.month(t),
    "week_of_year": lambda t: F.weekofyear(t),
    "year": lambda t: F.year(t),
}


def padded(col: Column | str, width: int) -> Column:
    """Number as text with leading zeros; a number that needs more digits is an error."""
    text = F.col(col).cast("string") if isinstance(col, str) else col.cast("string")
    too_long = F.raise_error(F.concat(F.lit(f"more than {width} digits: "), text)).cast("string")
    return F.when(F.length(text) > width, too_long).otherwise(F.lpad(text, width, "0"))
