"""Column groups of a survey table, resolved from the schema without running a job."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ColumnSet:
    """An ordered set of column names that can be narrowed, joined and reduced."""

    def __init__(self, names: Iterable[str]):
        self.names = list(dict.fromkeys(names))

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def __or__(self, other: Iterable[str]) -> ColumnSet:
        return ColumnSet([*self.names, *other])

    def _keep(self, test: Callable[[str], bool]) -> ColumnSet:
        return ColumnSet(n for n in self.names if test(n))

    def prefix(self, *starts: str) -> ColumnSet:
        return self._keep(lambda n: n.startswith(starts))

    def suffix(self, *ends: str) -> ColumnSet:
        return self._keep(lambda n: n.endswith(ends))

    def contains(self, part: str) -> ColumnSet:
        return self._keep(lambda n: part in n)

    def matches(self, pattern: str) -> ColumnSet:
        return self._keep(lambda n: re.search(pattern, n) is not None)

    def group(self, question: str) -> ColumnSet:
        """The question's own columns: ``Q3`` takes ``Q3`` and ``Q3_2`` but not ``Q30_1``."""
        return self.matches(rf"^{re.escape(question)}(_|$)")

    def numbered(self, stem: str, first: int, last: int) -> ColumnSet:
        """``numbered("Q", 1, 30)`` takes Q1 … Q30 in numeric order, as far as they exist."""
        have = set(self.names)
        return ColumnSet(n for n in (f"{stem}{i}" for i in range(first, last + 1)) if n in have)

    def minus(self, *drop: str) -> ColumnSet:
        return self._keep(lambda n: n not in drop)


def cols(df: DataFrame) -> ColumnSet:
    return ColumnSet(df.columns)


def question_groups(df: DataFrame, questions: Iterable[str], drop: Iterable[str] = ()) -> dict[str, list[str]]:
    """``{question: its columns}`` for the questions that have columns."""
    found = {q: cols(df).group(q).minus(*drop).names for q in questions}
    return {q: names for q, names in found.items() if names}


# -- renaming ---------------------------------------------------------------------------------

def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by old name → new name; names that are absent are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def rename_all(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename by position."""
    return df.toDF(*names)


def suffix_columns(df: DataFrame, suffix: str, keep: Iterable[str]) -> DataFrame:
    """Add a suffix to every column but the keys."""
    keys = set(keep)
    return df.toDF(*[c if c in keys else c + suffix for c in df.columns])


def rename_regex(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Rewrite column names by regular expression."""
    return df.toDF(*[re.sub(pattern, replacement, c) for c in df.columns])


def names_glue(template: str, **parts: str) -> str:
    """A column name from a template such as ``"{City}_{measure}"``."""
    return template.format(**parts)


def drop_columns(df: DataFrame, names: Iterable[str] = (), contains: str | None = None) -> DataFrame:
    """Drop administrative columns by name or by a part of the name; absent names are ignored."""
    extra = cols(df).contains(contains).names if contains else []
    return df.drop(*names, *extra)


# -- schema-driven projections ----------------------------------------------------------------

def cast_where(df: DataFrame, test: Callable[[T.DataType], bool], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to every column whose type passes ``test``, in one projection."""
    return df.select(*[
        fn(F.col(f"`{f.name}`")).alias(f.name) if test(f.dataType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def true_or_null(df: DataFrame) -> DataFrame:
    """Logical columns become 1 where true and null elsewhere."""
    return cast_where(df, lambda t: isinstance(t, T.BooleanType), lambda c: F.when(c, F.lit(1)))


def round_where(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every fractional column."""
    return cast_where(df, lambda t: isinstance(t, T.FractionalType), lambda c: F.round(c, digits))
