"""Report queries: compositions of the operators, each reading the respondents once per table family."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.columns import rename_map
from canvass.functions.scalars import age, age_band, decade, n_label, pct_label, row_total
from canvass.operators import codebook as cb
from canvass.operators import quality, reshape
from canvass.operators.compare import coarsen_share, compare_to_population
from canvass.operators.filters import (
    SurveyParams, answered_any, answered_text, apply_params, drop_test_answers, keep_in, split_tag,
)
from canvass.operators.numeric import density, histogram, mean_by, mean_positive_by, spend_summary
from canvass.operators.tabulate import crosstab, pct_overall, sample_size, tally
from canvass.operators.text import attach_by_id
from canvass.plans.instruments import Instrument


def wrangle(
    df: DataFrame, tag_col: str, tags: Mapping, names: Mapping[str, str], recodes: Mapping, recode_sources: list[str],
    levels: Mapping, first_day: str, groups: Mapping[str, list[str]], reference_year: int = 2024,
) -> DataFrame:
    """Conform → harmonise → derive → flag, as one lazy projection over the combined source."""
    df = rename_map(split_tag(df, tag_col, tags), names)
    df = cb.harmonize_all(df, recodes, "source", recode_sources)
    df = cb.harmonize_all(df, levels)
    df = df.withColumn("age", age("birth_year", reference_year))
    df = df.withColumn("age_group", age_band("age", "seven"))
    return quality.quality_flags(df, "end_date", first_day, "age", groups)


def crosstab_tables(df: DataFrame, by: str, questions: Mapping[str, list[str]], levels: list[str],
                    total: str | None = "Total") -> DataFrame:
    """All cross-tabs of a report in one table: a row per question and answer, a column per group.

    With ``total`` a last column adds the groups up, followed by " (all)" if a group has its name. Absent
    cells are 0.
    """
    counts = tally(keep_in(df, by, levels), [by], questions)
    columns = list(levels)
    if total is not None:
        while total in columns:
            total += " (all)"
        counts = reshape.with_totals(counts, by, ["question", "value"], label=total)
        columns.append(total)
    return reshape.fill_absent(reshape.to_wide(counts, ["question", "value"], by, "n", columns), names=columns)


def city_report(df: DataFrame, by: str, cities: list[str], questions: Mapping[str, list[str]],
                spend: list[str]) -> dict[str, DataFrame]:
    """The tables of a report for the chosen cities."""
    chosen = keep_in(df, by, cities)
    return {
        "answers": crosstab_tables(chosen, by, questions, cities, total=None),
        "mean_spend": mean_by(chosen, by, spend),
        "mean_positive_spend": mean_positive_by(chosen, by, spend),
    }


def venue_tables(df: DataFrame, by: str, questions: Mapping[str, list[str]], year: str, levels: list[str]) -> DataFrame:
    """Cross-tabs of the venue surveys, with founding years grouped into decades."""
    with_decade = df.withColumn("decade", decade(year))
    return crosstab_tables(with_decade, by, {**questions, "decade": ["decade"]}, levels, total=None)


def venue_report(df: DataFrame, instrument: Instrument, cities: list[str], clean: bool = True) -> DataFrame:
    """The city tables of a venue survey: a row per question and answer, a column per chosen city.

    Test answers go first, unless ``clean`` is off; questions that the table lacks are skipped; founding
    years are grouped into decades.
    """
    df = df.withColumnsRenamed({k: v for k, v in instrument.renames.items() if k in df.columns})
    if clean:
        df = drop_test_answers(df, *instrument.live, instrument.names, *instrument.tests)
    years = [q for q in instrument.years if q in df.columns]
    df = df.withColumns({q: decade(q) for q in years})
    questions = {**instrument.single_questions(df), **{q: [q] for q in years}, **instrument.questions(df, instrument.groups)}
    return crosstab_tables(df, instrument.group, questions, cities, total=None)


def venue_options(df: DataFrame, instrument: Instrument, col: str, levels: tuple[str, ...]) -> DataFrame:
    """Options of a delimited answer of a venue survey per city, in the order of ``levels`` by ``option_ord``."""
    df = df.withColumnsRenamed({k: v for k, v in instrument.renames.items() if k in df.columns})
    options = raw_option_data(df, instrument.group, col, instrument.live, instrument.names, *instrument.tests)
    return cb.with_order(options, "option", list(levels))


def venue_plot_data(df: DataFrame, by: str, questions: Mapping[str, list[str]]) -> DataFrame:
    """Counts per group with percent of the question's total over all groups."""
    counts = tally(df, [by], questions)
    totals = counts.groupBy(F.col("question").alias("_q")).agg(F.sum("n").alias("_total"))
    return counts.join(totals, F.col("question") == F.col("_q")).select(
        by, "question", "value", "n", (F.col("n") * F.lit(100.0) / F.col("_total")).alias("pct"))


def raw_option_data(df: DataFrame, by: str, col: str, status: tuple[str, str], name: str, pattern: str,
                    deny: list[str]) -> DataFrame:
    """Options of a delimited answer per group, test answers removed, percent of all ticks."""
    live = drop_test_answers(df, status[0], status[1], name, pattern, deny)
    options = reshape.explode_options(live.select(by, col), col, paren_aware=True, name="option")
    return pct_overall(crosstab(options, [by], "option"))


def answer_table(df: DataFrame, by: str, groups: Mapping[str, list[str]], levels: list[str]) -> DataFrame:
    """Answers and response rate per question and city, with the sample sizes as last row.

    One aggregate over the respondents; the rest works on one row per city.
    """
    chosen = keep_in(df, by, levels)
    n = F.count(F.lit(1))
    flags = {q: F.count(F.when(F.coalesce(*names).isNotNull(), 1)) for q, names in groups.items()}
    wide = chosen.groupBy(by).agg(
        n.alias("Sample Size_n"), F.lit(None).cast("double").alias("Sample Size_%"),
        *[c.alias(f"{q}_n") for q, c in flags.items()], *[(c * F.lit(100.0) / n).alias(f"{q}_%") for q, c in flags.items()])
    long = reshape.to_long_measures(wide, [by], ["n", "%"])
    return reshape.to_wide_measures(long, ["question"], by, {"n": "n", "%": "%"}, levels)


def population_report(sample: DataFrame, population: DataFrame, mapping: DataFrame, dataset: str, by: str,
                      category: str, value: str) -> DataFrame:
    """Remap the population to survey categories and set it beside the sample."""
    mapped = cb.remap(population, mapping, dataset, [category])
    counts = crosstab(cb.remap(sample, mapping, dataset, [category]), [by], category)
    return compare_to_population(counts, mapped, by, category, "n", value)


def dashboard_answers(df: DataFrame, params: SurveyParams, questions: Mapping[str, list[str]], all_token: str) -> DataFrame:
    """Every percentage table and bar chart of the dashboard, from one pass over the respondents.

    ``pct_cases`` is the percent of respondents who answered the question, ``pct_responses`` that of
    its ticks; they agree for single-choice questions.
    """
    wanted = df.where(F.col(params.gender_col).isin(params.gender_list()))
    counts = tally(wanted, [params.group_col], questions, all_token)
    shown = keep_in(counts, params.group_col, params.groups)
    return shown.select(
        params.group_col, "question", "value", "n", (F.col("n") * F.lit(100.0) / F.col("answered")).alias("pct_cases"),
        (F.col("n") * F.lit(100.0) / F.col("responses")).alias("pct_responses"),
        pct_label("n", "answered").alias("label"), n_label(params.group_col, "answered").alias("facet"))


def dashboard_totals(df: DataFrame, params: SurveyParams, spend: list[str], strict: bool = True) -> DataFrame:
    """Spending totals of the wanted genders, in all groups."""
    wanted = df.where(F.col(params.gender_col).isin(params.gender_list()))
    if not strict:
        wanted = answered_any(wanted, spend)
    return wanted.select(params.group_col, row_total(spend, strict).alias("total")).na.drop()


def dashboard_spending(df: DataFrame, params: SurveyParams, spend: list[str], all_token: str,
                       strict: bool = True) -> DataFrame:
    """Spending table: mean and median of the totals per chosen group."""
    totals = dashboard_totals(df, params, spend, strict)
    return keep_in(spend_summary(totals, params.group_col, "total", all_token), params.group_col, params.groups)


def dashboard_distribution(df: DataFrame, params: SurveyParams, spend: list[str], all_token: str, strict: bool = True,
                           curve: bool = False, **options) -> DataFrame:
    """Histogram (or density curve) of the totals per chosen group, over a shared range."""
    group = params.group_col
    totals = reshape.explode_all(dashboard_totals(df, params, spend, strict), group, all_token)
    shown = keep_in(totals, group, params.groups)
    keys = [group, "_all"]
    if curve:
        return density(shown, keys, "total", **options).drop("_all")
    return histogram(shown, keys, "total", **{"bins": 20, "density": True, **options}).drop("_all")


def statistic_series(values: DataFrame, codes: DataFrame, coded: list[str], keep: Mapping[str, list[str]]) -> DataFrame:
    """A coded public table with labels instead of codes, filtered by label."""
    labelled = cb.label_codes(values, codes, coded)
    for col, wanted in keep.items():
        labelled = keep_in(labelled, col, wanted)
    return labelled


def open_answers(df: DataFrame, results: DataFrame, key: str, answer: str, demographics: list[str]) -> DataFrame:
    """Filled open answers with demographics and the result of their enrichment, joined by key."""
    filled = answered_text(df, answer).select(key, *demographics, answer)
    return attach_by_id(filled, results, key)


def gender_shares(df: DataFrame, by: str, col: str, keep: list[str]) -> DataFrame:
    """Share of the kept answers per group."""
    return coarsen_share(crosstab(keep_in(df, col, keep), [by], col), "n", [by], [by, col])


def report(df: DataFrame, cities: list[str], questions: Mapping[str, list[str]], spend: list[str],
           by: str = "city") -> dict[str, DataFrame]:
    """The whole city report for another list of cities."""
    tables = city_report(df, by, cities, questions, spend)
    tables["sample"] = sample_size(keep_in(df, by, cities), [by])
    return tables
