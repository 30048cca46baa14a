"""Quality flags of responses and the filtered set."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.scalars import all_missing, answered_flag, as_flag, flag_before


def flag_all_missing(df: DataFrame, groups: Mapping[str, list[str]]) -> DataFrame:
    """``{group}_missing`` = 1 if every column of the group is null, else 0."""
    return df.withColumns({f"{q}_missing": as_flag(all_missing(names)) for q, names in groups.items()})


def quality_flags(
    df: DataFrame, end_col: str, first_day: str, age_col: str, groups: Mapping[str, list[str]], max_age: int = 99
) -> DataFrame:
    """Flags ``test``, ``missing_all``, ``bad``, ``exclude`` and ``screenout``.

    Three-valued logic: an unknown age with answered questions leaves ``bad`` and ``exclude`` null.
    """
    missing_all = F.lit(True)
    for names in groups.values():
        missing_all = missing_all & all_missing(names)
    bad = (F.col(age_col) > max_age) | missing_all
    flagged = df.withColumns({
        "test": flag_before(end_col, first_day), "missing_all": as_flag(missing_all), "bad": as_flag(bad)})
    exclude = (F.col("test") == 1) | (F.col("bad") == 1)
    return flagged.withColumns({"exclude": as_flag(exclude), "screenout": as_flag(~exclude)})


def valid_responses(df: DataFrame) -> DataFrame:
    """Rows to analyse, without the flag columns; an unknown flag drops the row."""
    return df.where(F.col("exclude") == 0).drop("exclude", "screenout")


def answered_flags(df: DataFrame, groups: Mapping[str, list[str]], keep: list[str]) -> DataFrame:
    """One column per question group, 1 if answered and null if not, in one projection."""
    return df.select(*keep, *[answered_flag(names).alias(q) for q, names in groups.items()])
