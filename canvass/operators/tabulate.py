"""Counts, percentages and rates.

Respondent rows are read once and counted with map-side partial aggregation; percentages, totals and
"all groups" rows are made from the counted rows. Totals are joined back instead of taken by a window,
so that no task has to hold all answers of a group; both sides reuse the same shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions.scalars import answered_flag, any_answered
from canvass.operators.codebook import lookup
from canvass.operators.reshape import with_totals


def with_total(df: DataFrame, value: str, by: list[str], name: str = "total") -> DataFrame:
    """Attach the sum of ``value`` over the rows that share ``by`` (over all rows if empty)."""
    if not by:
        return df.withColumn(name, df.agg(F.sum(value)).scalar())
    totals = df.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.sum(value).alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
    return df.join(totals, same, "left").select(*df.columns, name)


def _known(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows without nulls in the columns.

    Plain null tests rather than ``na.drop``: Spark merges and places them alike wherever a branch
    repeats, which keeps repeated branches equal and their shuffle shared.
    """
    for n in names:
        df = df.where(F.col(n).isNotNull())
    return df


def share(df: DataFrame, value: str, by: list[str], name: str = "share") -> DataFrame:
    """``value`` divided by its sum within ``by``."""
    return with_total(df, value, by, "_total").withColumn(
        name, F.col(value).cast("double") / F.col("_total").cast("double")).drop("_total")


def with_all(counts: DataFrame, by: str, keys: list[str], token: str, value: str = "n") -> DataFrame:
    """Add the group of all rows next to each group, from counted rows; a group named like the token stays apart."""
    return with_totals(counts, by, keys, value, token)


def crosstab(df: DataFrame, by: list[str], question: str, all_token: str | None = None) -> DataFrame:
    """Counts of answers per group; rows with a null group or answer are dropped."""
    counts = df.groupBy(*by, question).agg(F.count(F.lit(1)).alias("n"))
    if all_token is not None:
        counts = with_all(counts, by[0], [*by[1:], question], all_token)
    return _known(counts, [*by, question])


def freq(df: DataFrame, question: str) -> DataFrame:
    """Counts and percent of answers of one question."""
    return pct_overall(crosstab(df, [], question))


def pct_within(counts: DataFrame, by: list[str], value: str = "n", name: str = "pct") -> DataFrame:
    """Percent within each group."""
    return with_total(counts, value, by, "_total").withColumn(
        name, F.col(value) * F.lit(100.0) / F.col("_total")).drop("_total")


def pct_overall(counts: DataFrame, value: str = "n", name: str = "pct") -> DataFrame:
    """Percent of the total over all groups."""
    return pct_within(counts, [], value, name)


def tally(df: DataFrame, by: list[str], questions: Mapping[str, list[str]], all_token: str | None = None,
          items: bool = False, mark: str | None = None) -> DataFrame:
    """Count many questions in one pass over the respondents.

    ``questions`` maps a question to its column(s). Returns the keys, ``question``, ``value``, ``n``,
    the respondents who ``answered`` the question and its ``responses`` (ticks); with ``items``
    also the column as ``item``. With ``all_token`` and ``mark`` a column of that name is true in the
    totals, which tells them from a group that bears the token.

    A question with several columns contributes one more entry per respondent who answered any of
    them, so numerator and denominator come out of the same aggregate.
    """
    of = {c: q for q, names in questions.items() for c in names}
    bases = {f"_base_{q}": names for q, names in questions.items() if len(names) > 1}
    if all_token is None:
        df = _known(df, by)
    # An array of entries rather than unpivot: Spark does not recognise two equal expansions as the
    # same, so the branches below would not share their shuffle.
    entry = lambda name, value: F.struct(F.lit(name).alias("_item"), value.alias("value"))
    entries = df.select(*by, F.inline(F.array(
        *[entry(c, F.col(c).cast("string")) for c in of],
        *[entry(b, F.when(any_answered(names), F.lit(""))) for b, names in bases.items()],
    ))).where(F.col("value").isNotNull())
    cells = entries.groupBy(*by, "_item", "value").agg(F.count(F.lit(1)).alias("n"))
    if all_token is not None:
        cells = _known(with_totals(cells, by[0], [*by[1:], "_item", "value"], label=all_token, mark="_all"), by)
    names, by = by, [*by, "_all"] if all_token is not None else by

    question = lookup(F.col("_item"), {**of, **{f"_base_{q}": q for q in questions}})
    kept = [*by, "question", *(["_item"] if items else []), "value"]
    # The marker is an aggregate, not a key: a filter on it stays above the shuffle that both
    # branches below share.
    counts = (
        cells.withColumn("question", question).groupBy(*kept)
        .agg(F.sum(F.when(~F.col("_item").startswith("_base_"), F.col("n"))).alias("n"),
             F.sum(F.when(F.col("_item").startswith("_base_"), F.col("n"))).alias("_base"))
    )
    totals = counts.groupBy(*[F.col(k).alias(f"_{k}") for k in [*by, "question"]]).agg(
        F.coalesce(F.sum("_base"), F.sum("n")).alias("answered"), F.sum("n").alias("responses"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*by, "question"]]
    out = counts.where(F.col("n").isNotNull()).join(totals, same)
    item = [F.col("_item").alias("item")] if items else []
    marked = [F.col("_all").alias(mark)] if mark and all_token is not None else []
    return out.select(*names, *marked, "question", *item, "value", "n", "answered", "responses")


def multi_freq(df: DataFrame, by: list[str], names: list[str], base: str | None = None,
               all_token: str | None = None) -> DataFrame:
    """Counts of the options of a multi-response question per group.

    ``base="cases"``: percent of respondents who answered the question (adds up to more than 100).
    ``base="responses"``: percent of ticks.
    """
    counts = tally(df, by, {"_q": list(names)}, all_token).drop("question")
    if base is None:
        return counts.drop("answered", "responses")
    column = {"cases": "answered", "responses": "responses"}[base]
    return counts.select(*by, "value", "n", F.col(column).alias("base"),
                         (F.col("n") * F.lit(100.0) / F.col(column)).alias("pct"))


def battery(df: DataFrame, by: list[str], items: Mapping[str, str], all_token: str | None = None) -> DataFrame:
    """Counts of item × answer per group, percent of respondents who answered the battery."""
    counts = tally(df, by, {"_q": list(items)}, all_token, items=True)
    return counts.select(
        *by, F.coalesce(lookup(F.col("item"), items), F.col("item")).alias("item"), "value", "n",
        F.col("answered").alias("base"), (F.col("n") * F.lit(100.0) / F.col("answered")).alias("pct"))


def answered_counts(df: DataFrame, by: list[str], groups: Mapping[str, list[str]]) -> DataFrame:
    """Respondents who answered each question, per group, in one aggregate."""
    return df.groupBy(*by).agg(*[F.count(answered_flag(names)).alias(q) for q, names in groups.items()])


def response_rate(df: DataFrame, by: list[str], groups: Mapping[str, list[str]]) -> DataFrame:
    """Percent of respondents who answered each question, per group, in one aggregate."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(*[
        (F.count(answered_flag(names)) * F.lit(100.0) / n).alias(q) for q, names in groups.items()])


def sample_size(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def with_denominator(counts: DataFrame, answered: DataFrame, key: str, group: str, name: str = "base") -> DataFrame:
    """Attach each group's number of respondents to the counts of a question, with its percent."""
    den = answered.select(F.col(key).alias("_key"), F.col(group).alias(name))
    return (
        counts.join(den, F.col(key) == F.col("_key"), "left").drop("_key")
        .withColumn("pct", F.col("n") * F.lit(100.0) / F.col(name))
    )


def number_within(counts: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Number the answers of each group of a counted table (a legend index).

    One row per answer of a question, so the window stays short; use ``number_rows`` for
    respondent-sized groups.
    """
    return counts.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def cumulative_share(counts: DataFrame, by: list[str], order: list[str], value: str = "n",
                     name: str = "cum_share") -> DataFrame:
    """Running share over the ordered answers of each group of a counted table."""
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    return counts.withColumn(
        name, F.sum(value).over(running).cast("double") / F.sum(value).over(whole).cast("double"))
