"""Populations and samples side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators.tabulate import share


def population(df: DataFrame, keys: list[str], value: str = "values") -> DataFrame:
    """Sum by keys after remapping; rows with a null key drop out."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value)).na.drop("any", subset=keys)


def coarsen_share(df: DataFrame, value: str, within: list[str], keys: list[str]) -> DataFrame:
    """Share of ``value`` within ``within``, added up to coarser keys."""
    return share(df, value, within).groupBy(*keys).agg(F.sum("share").alias("share"))


def compare_to_population(sample: DataFrame, pop: DataFrame, by: str, category: str, n: str = "n",
                          value: str = "values") -> DataFrame:
    """Sample and population shares per group × category, also where only one side has the category."""
    left = share(sample.na.drop("any", subset=[by, category]), n, [by]).select(
        by, category, F.col("share").alias("sample_share"))
    counted = pop.groupBy(by, category).agg(F.sum(value).alias(value))
    right = share(counted, value, [by]).select(by, category, F.col("share").alias("population_share"))
    return left.join(right, [by, category], "full_outer").withColumn(
        "difference",
        F.coalesce(F.col("sample_share"), F.lit(0.0)) - F.coalesce(F.col("population_share"), F.lit(0.0)))
