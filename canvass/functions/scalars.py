"""Derived columns: ages, bands, flags, totals, labels. All stay inside generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The age bands of the questionnaire reports. (from, to, label), both ends included;
# None leaves the end open.
AGE_BANDS = {
    "seven": [
        (None, 17, "0-17"), (18, 29, "18-29"), (30, 39, "30-39"), (40, 49, "40-49"),
        (50, 59, "50-59"), (60, 69, "60-69"), (70, None, "70+"),
    ],
    "adults": [
        (18, 29, "18-29"), (30, 39, "30-39"), (40, 49, "40-49"),
        (50, 59, "50-59"), (60, 69, "60-69"), (70, None, "70+"),
    ],
    "broad": [
        (None, 17, "<18"), (18, 29, "18-29"), (30, 49, "30-49"), (50, 64, "50-64"), (65, None, ">64"),
    ],
}


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age(birth_year: Column | str, reference_year: int) -> Column:
    return F.lit(reference_year) - as_column(birth_year).cast("int")


def band(value: Column | str, bands: list[tuple]) -> Column:
    """Label of the band that holds the value; null outside every band."""
    v = as_column(value)
    chain = None
    for lo, hi, label in bands:
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (v >= lo)
        if hi is not None:
            inside = inside & (v <= hi)
        chain = F.when(inside, label) if chain is None else chain.when(inside, label)
    return chain


def age_band(value: Column | str, scheme: str = "seven") -> Column:
    return band(value, AGE_BANDS[scheme])


def decade(year: Column | str) -> Column:
    """``1994`` → ``"1990-1999"``."""
    start = (F.floor(as_column(year) / 10) * 10).cast("int")
    return F.concat(start.cast("string"), F.lit("-"), (start + 9).cast("string"))


def flag_before(moment: Column | str, day: str) -> Column:
    """1 if the date lies before ``day``, 0 if not, null if unknown."""
    return (F.to_date(as_column(moment)) < F.lit(day).cast("date")).cast("int")


def as_flag(condition: Column) -> Column:
    """1, 0 or null, following three-valued logic."""
    return condition.cast("int")


def any_answered(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])


def all_missing(names: list[str]) -> Column:
    return ~any_answered(names)


def answered_flag(names: list[str]) -> Column:
    """1 if any column of the group is answered, else null."""
    return F.when(any_answered(names), F.lit(1))


def row_total(names: list[str], strict: bool = True) -> Column:
    """Sum across columns. Strict: null if any part is null. Lenient: null parts count as 0."""
    parts = [F.col(n) if strict else F.coalesce(F.col(n), F.lit(0)) for n in names]
    return reduce(lambda a, b: a + b, parts)


def percent_tenths(n: Column | str, total: Column | str) -> Column:
    """Percent in whole tenths, rounded half up with integer arithmetic."""
    n, total = as_column(n).cast("bigint"), as_column(total).cast("bigint")
    return F.call_function("div", n * 2000 + total, total * 2)


def pct_label(n: Column | str, total: Column | str) -> Column:
    """``"12 (34.5%)"``; a whole percent is printed without a decimal."""
    tenths = percent_tenths(n, total)
    whole = F.call_function("div", tenths, F.lit(10)).cast("string")
    shown = F.when(tenths % 10 == 0, whole).otherwise(
        F.concat(whole, F.lit("."), (tenths % 10).cast("string")))
    return F.concat(as_column(n).cast("string"), F.lit(" ("), shown, F.lit("%)"))


def n_label(group: Column | str, n: Column | str) -> Column:
    """Facet label: the group, a line break and its base."""
    return F.concat(as_column(group), F.lit("\nN = "), as_column(n).cast("string"))


def classify(text: Column | str, patterns: dict[str, str]) -> Column:
    """Label of the first pattern found in the text; null if there is none."""
    chain = None
    for label, pattern in patterns.items():
        hit = as_column(text).rlike(pattern)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def logistic_density(x: Column, mu: Column, sigma: Column) -> Column:
    """Density of the logistic distribution."""
    e = F.exp(-F.abs((x - mu) / sigma))
    return e / (sigma * (F.lit(1.0) + e) * (F.lit(1.0) + e))


def logit(p: Column) -> Column:
    """Log odds; null at 0 and 1."""
    return F.when((p > 0) & (p < 1), F.log(p / (F.lit(1.0) - p)))
