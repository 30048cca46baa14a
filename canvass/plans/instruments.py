"""Questionnaires as parameters: which columns are single choice, multi-response, battery, spending or text.

A report needs an instrument and a table; column groups that a table lacks are skipped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.columns import cols, question_groups
from canvass.functions.scalars import row_total
from canvass.operators.codebook import lookup
from canvass.operators.filters import SurveyParams, answered_any, keep_in
from canvass.operators.numeric import spend_summary
from canvass.operators.tabulate import answered_counts, tally, with_all


@dataclass(frozen=True)
class Instrument:
    """One questionnaire: group and gender columns, question lists and spending totals."""

    group: str
    all_token: str
    gender: str | None = None
    genders: tuple[str, ...] = ()
    singles: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    batteries: tuple[str, ...] = ()
    amounts: tuple[str, ...] = ()
    free_text: tuple[str, ...] = ()
    spending: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    strict_totals: bool = False
    # Totals in which a respondent without any amount counts as 0 instead of dropping out.
    empty_as_zero: tuple[str, ...] = ()
    # Years that are shown as decades, raw names of columns, and what tells test answers: the column and value of
    # the status of live ones, the column of the venue's name, and the pattern and list of names of tests.
    years: tuple[str, ...] = ()
    renames: Mapping[str, str] = field(default_factory=dict)
    live: tuple[str, str] = ("Status", "IP Address")
    names: str | None = None
    tests: tuple[str, tuple[str, ...]] = ("test", ())

    def params(self, groups: tuple[str, ...], genders: tuple[str, ...] = ("total",)) -> SurveyParams:
        ignore = () if self.gender else ("gender",)
        return SurveyParams(groups, genders, self.genders, self.group, self.gender or "", ignore=ignore)

    def questions(self, df: DataFrame, which: tuple[str, ...]) -> dict[str, list[str]]:
        return question_groups(df, which, drop=self.free_text)

    def amount_columns(self, df: DataFrame, kind: str | Sequence[str]) -> list[str]:
        """Columns of a named total, or of the questions and columns that are listed, as far as the table has them."""
        stems = self.spending[kind] if isinstance(kind, str) else kind
        return list(dict.fromkeys(n for s in stems for n in cols(df).group(s).minus(*self.free_text)))

    def single_questions(self, df: DataFrame) -> dict[str, list[str]]:
        return {q: [q] for q in self.singles if q in df.columns}


# The day, option orders, test names, genders and question lists of the four questionnaires.
SNAPSHOT_DAY = "2024-10-11"
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "Everyday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December", "All year round")
TEST_NAMES_PRE = ("c", "x", "f", "asdads", "moi", "Testclub", "-", "bn")
TEST_NAMES_POST = ("a", "Testplace", "asdsadas", "cdcd", "Chalmuns Cantina", "d", "sasda", "rm", "Тест")

CENSUS = Instrument(
    group="City", all_token="All Cities", gender="Q2", genders=("Male", "Female", "Another gender identity"),
    singles=("Q2", "Age_group", "Q4", "Q5", "Q7", "Q9", "Q11", "Q13", "Q14", "Q16"),
    groups=("Q8", "Q12", "Q15", "Q17"), free_text=("Q18",),
    spending={
        "total": ("Q6_1", "Q6_2", "Q6_3", "Q6_4", "Q6_5"), "Ticket/entry": ("Q6_1",), "Transportation": ("Q6_2",),
        "Food/drink": ("Q6_3",), "Merchandise": ("Q6_4",), "Accommodation": ("Q6_5",)},
    strict_totals=True)
PRE_SNAPSHOT = Instrument(
    group="City", all_token="All Cities",
    singles=("Q4", "Q6", "Q10", "Q11", "Q13", "Q15_1", "Q15_2", "Q15_3", "Q18"),
    groups=("Q8", "Q9", "Q12", "Q14"), free_text=("Q14_15_TEXT", "Q16", "Q17"),
    years=("Q7",), names="Q21_1", tests=("test", TEST_NAMES_PRE))
POST_SNAPSHOT = Instrument(
    group="City", all_token="All Cities", singles=("Q1", "Q2", "Q4", "Q6", "Q7", "Q10", "Q13"),
    groups=("Q8", "Q9", "Q12", "Q14"), free_text=("Q31", "Q32"),
    renames={"Q34": "City"}, names="Q30_1", tests=("test", TEST_NAMES_POST))
PARTICIPATION = Instrument(
    group="S0", all_token="All Countries", gender="S3",
    genders=("Male", "Female", "Another gender identity", "Don't want to say"),
    singles=("S3", "SREC_Age", "S9", "S10", "M11", "M12", "M13", "M14_1t", "M15", "M16", "M17", "M18_2t", "M20", "M23",
             "M27", "M28", "M32", "M40", "M41", "M48", "M52", "M53", "M58", "M59", "M60", "M64", "M68", "M75", "M76",
             "M77", "M78"),
    batteries=("S6", "S7", "S8", "M22", "M24", "M25", "M26", "M31", "M33", "M35", "M38", "M39", "M42", "M43", "M44",
               "M45", "M46", "M47", "M49", "M50", "M51", "M54", "M56", "M57", "M61", "M62", "M63", "M70", "M74", "M79"),
    amounts=("M14", "M18", "M29", "M34", "M36", "M37", "M55", "M69", "M71", "M73"),
    free_text=("M31_6t", "S8_9t", "M22_9t", "M42_11", "M42_11t", "M44_6", "M44_6t", "M70_21t"),
    spending={
        "last event": ("M18_1t_eur_mvr", "M19_1t_eur_mvr", "M19_2t_eur_mvr", "M19_3t_eur_mvr", "M19_4t_eur_mvr",
                       "M19_5t_eur_mvr", "M19_6t_eur_mvr", "M21_1t_eur_mvr", "M21_2t_eur_mvr"),
        "events per month": ("M29_1t", "M29_2t", "M29_3t"), "listening per month": ("M37_1t", "M37_2t", "M37_3t", "M37_4t"),
        "studies": ("M55",), "instruments per year": ("M69",), "income per year": ("M71",), "total income": ("M73",)},
    empty_as_zero=("events per month",))


def grid_names(stem: str = "M34", media: int = 8, places: int = 3) -> dict[str, str]:
    """Raw names of the two-level grid, numbered straight through, → ``{stem}_{medium}_{place}``."""
    return {f"{stem}_{i + 1}t": f"{stem}_{i // places + 1}_{i % places + 1}" for i in range(media * places)}


def dashboard(df: DataFrame, instrument: Instrument, groups: tuple[str, ...], genders: tuple[str, ...] = ("total",),
              item_texts: Mapping[str, str] | None = None) -> DataFrame:
    """Every answer table of an instrument in one pass: singles, multi-response groups and batteries.

    Columns: group, question, item (batteries only), value, n, percent of cases and of responses.
    """
    params = instrument.params(groups, genders)
    if instrument.gender:
        df = df.where(F.col(instrument.gender).isin(params.gender_list()))
    single = instrument.single_questions(df)
    batteries = instrument.questions(df, instrument.batteries)
    questions = {**single, **instrument.questions(df, instrument.groups), **batteries}
    counts = tally(df, [instrument.group], questions, instrument.all_token, items=True, mark="_all")
    is_item = F.col("question").isin(list(batteries))
    item = F.coalesce(lookup(F.col("item"), dict(item_texts or {})), F.col("item"))
    # Options of a multi-response group are told apart by their label, items of a battery by their column.
    rows = counts.withColumn("item", F.when(is_item, item)).groupBy(
        instrument.group, "_all", "question", "item", "value", "answered", "responses").agg(F.sum("n").alias("n"))
    return keep_in(rows, instrument.group, groups).select(
        instrument.group, "question", "item", "value", "n",
        (F.col("n") * F.lit(100.0) / F.col("answered")).alias("pct_cases"),
        (F.col("n") * F.lit(100.0) / F.col("responses")).alias("pct_responses"))


def spending_table(df: DataFrame, instrument: Instrument, kind: str | Sequence[str], groups: tuple[str, ...],
                   genders: tuple[str, ...] = ("total",)) -> DataFrame:
    """Number, mean and median of one spending total per group.

    ``kind`` names a total of the instrument, or lists the questions or columns to add up. One column of a
    place or grid gives the amounts there.
    """
    names = instrument.amount_columns(df, kind)
    if not names:
        raise ValueError(f"the table has no column of {kind!r}")
    params = instrument.params(groups, genders)
    if instrument.gender:
        df = df.where(F.col(instrument.gender).isin(params.gender_list()))
    if not instrument.strict_totals and kind not in instrument.empty_as_zero:
        df = answered_any(df, names)
    totals = df.select(instrument.group, row_total(names, instrument.strict_totals).alias("total")).na.drop()
    return keep_in(spend_summary(totals, instrument.group, "total", instrument.all_token), instrument.group, groups)


def answered_bases(df: DataFrame, instrument: Instrument, groups: tuple[str, ...],
                   genders: tuple[str, ...] = ("total",)) -> DataFrame:
    """Respondents who answered each multi-response group, battery and amount question, per group, in one pass."""
    if instrument.gender:
        df = df.where(F.col(instrument.gender).isin(instrument.params(groups, genders).gender_list()))
    questions = instrument.questions(df, (*instrument.groups, *instrument.batteries, *instrument.amounts))
    wide = answered_counts(df, [instrument.group], questions)
    counts = wide.unpivot(instrument.group, list(questions), "question", "answered")
    return keep_in(with_all(counts, instrument.group, ["question"], instrument.all_token, "answered"), instrument.group, groups)
