"""Codebook tables and everything driven by them: decoding, harmonising, recoding, captions.

Labels are not a Spark type. They live in dictionary tables; a labelled variable is a code column plus
its rows in the dictionary. Dictionaries of a questionnaire are small and become literal expressions
inside one projection. Mappings that come as a table of unknown size are joined, and adaptive
execution broadcasts them only if they measure small.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.session import materialize

SHEETS = {
    "crosswalk": "raw string, clean string",
    "recodes": "variable string, `from` string, `to` string, value int",
    "questions": "variable string, label string",
    "levels": "variable string, `from` string, `to` string, value int",
    "population": "dataset string, variable string, original string, mapped string",
    "captions": "survey string, question string, caption string",
}


def small_rows(df: DataFrame, limit: int) -> list:
    """Rows of a table on the driver; refuses a table beyond the limit."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} dictionary rows; join the table instead")
    return rows


@dataclass
class Codebook:
    """The sheets of a codebook as tables."""

    tables: dict[str, DataFrame]

    @classmethod
    def load(cls, spark: SparkSession, folder: str, fmt: str = "csv") -> Codebook:
        """Read one file or directory per sheet below ``folder``."""
        tables = {}
        for sheet, schema in SHEETS.items():
            reader = spark.read.schema(schema)
            if fmt == "csv":
                reader = reader.option("header", "true")
            tables[sheet] = reader.format(fmt).load(f"{folder.rstrip('/')}/{sheet}")
        return cls(tables)

    @classmethod
    def from_rows(cls, spark: SparkSession, **rows: list[tuple]) -> Codebook:
        return cls({sheet: spark.createDataFrame(rows.get(sheet, []), schema) for sheet, schema in SHEETS.items()})

    def save(self, folder: str, fmt: str = "csv") -> None:
        for sheet, table in self.tables.items():
            writer = table.write.mode("errorifexists")
            if fmt == "csv":
                writer = writer.option("header", "true")
            writer.format(fmt).save(f"{folder.rstrip('/')}/{sheet}")

    def __getitem__(self, sheet: str) -> DataFrame:
        return self.tables[sheet]

    def _rows(self, sheet: str, key: str, names: Iterable[str] | None) -> list:
        """Rows of a sheet whose key is among the names, usually a table's columns; all rows without names."""
        table = self[sheet]
        return (table if names is None else table.where(F.col(key).isin(list(names)))).collect()

    def crosswalk(self, names: Iterable[str] | None = None) -> dict[str, str]:
        return {r.raw: r.clean for r in self._rows("crosswalk", "raw", names)}

    def changes(self, sheet: str, names: Iterable[str] | None = None) -> dict[str, list[tuple[str, str, int]]]:
        """``{variable: [(from, to, value)]}`` of the recode or level sheet, for short scales; :func:`harmonize_sheet` joins long ones."""
        found: dict[str, list] = {}
        for r in self._rows(sheet, "variable", names):
            found.setdefault(r["variable"], []).append((r["from"], r["to"], r["value"]))
        return found

    def questions(self, names: Iterable[str] | None = None) -> dict[str, str]:
        return {r.variable: r.label for r in self._rows("questions", "variable", names)}


def lookup(value: Column, pairs: Mapping) -> Column:
    """Value of a literal dictionary; null if the key is absent."""
    if not pairs:
        return F.lit(None).cast("string")
    flat = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.create_map(*flat)[value]


def rename_crosswalk(df: DataFrame, codebook: Codebook) -> DataFrame:
    """Rename raw column names to the shared ones."""
    return df.withColumnsRenamed({k: v for k, v in codebook.crosswalk(df.columns).items()})


def harmonize_values(
    df: DataFrame, variable: str, changes: list[tuple[str, str, int]],
    source_col: str | None = None, sources: Iterable[str] | None = None,
) -> DataFrame:
    """Replace the ``from`` labels of one variable by ``to`` and add the numeric code.

    With ``sources``, rows of other sources keep label and stay without a code from this step.
    """
    return _harmonize(df, {variable: changes}, source_col, sources)


def harmonize_all(
    df: DataFrame, changes: Mapping[str, list[tuple[str, str, int]]],
    source_col: str | None = None, sources: Iterable[str] | None = None,
) -> DataFrame:
    """All variables of a change table in one projection."""
    return _harmonize(df, changes, source_col, sources)


def _harmonize(df, changes, source_col, sources):
    applies = F.col(source_col).isin(list(sources)) if sources is not None else F.lit(True)
    new = {}
    for variable, rows in changes.items():
        if variable not in df.columns:
            continue
        old = F.col(variable).cast("string")
        label = lookup(old, {a: b for a, b, _ in rows})
        code = lookup(old, {a: c for a, _, c in rows})
        new[variable] = F.when(applies, F.coalesce(label, old)).otherwise(old)
        code = F.when(applies, code)
        kept = f"{variable}_code"
        new[kept] = F.coalesce(code, F.col(kept)) if kept in df.columns else code
    return df.withColumns(new)


def label_variables(df: DataFrame, questions: Mapping[str, str]) -> DataFrame:
    """Attach question texts as column metadata, a convenience copy of the dictionary."""
    return df.select(*[
        F.col(c).alias(c, metadata={"label": questions[c]}) if c in questions else F.col(c) for c in df.columns
    ])


def variable_labels(df: DataFrame) -> DataFrame:
    """Dictionary rows ``(variable, label)`` of the labels a table carries; null if it has none."""
    rows = [(f.name, f.metadata.get("label")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "variable string, label string")


def decode(df: DataFrame, labels: Mapping[str, Mapping], names: Iterable[str] | None = None) -> DataFrame:
    """Codes → labels; codes without a label stay as text. A code list that is a table is for :func:`label_codes`."""
    chosen = [n for n in (names if names is not None else labels) if n in df.columns]
    return df.withColumns({
        n: F.coalesce(
            lookup(F.col(n).cast("string"), {str(k): v for k, v in labels.get(n, {}).items()}),
            F.col(n).cast("string"))
        for n in chosen
    })


def attach_entries(df: DataFrame, entries: DataFrame, names: list[str]) -> DataFrame:
    """Add ``_m0``, ``_m1``, … with the entry ``mapped`` of (``variable``, ``original``) for the columns ``names``.

    The dictionary is joined once, however many columns there are, to their distinct combinations, whose
    entries are packed side by side; the rows are joined to their combination, nulls included. No literal
    grows with the dictionary, and an entry that is listed twice takes its smallest form and repeats no row.
    """
    keys = [f"_k{i}" for i in range(len(names))]
    clean = entries.where(F.col("variable").isin(names)).groupBy("variable", F.col("original").cast("string").alias("original")).agg(F.min("mapped").alias("mapped"))
    text = [F.col(f"`{n}`").cast("string") for n in names]
    combos = materialize(df.select(*[t.alias(k) for t, k in zip(text, keys, strict=True)]).distinct().withColumn("_combo", F.monotonically_increasing_id()), "combinations")
    pairs = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(k).alias("original")) for n, k in zip(names, keys, strict=True)])
    long = combos.select("_combo", F.explode(pairs).alias("t")).select("_combo", "t.*").where("original IS NOT NULL")
    packed = long.join(clean, ["variable", "original"]).groupBy("_combo").agg(*[F.max(F.when(F.col("variable") == n, F.col("mapped"))).alias(f"_m{i}") for i, n in enumerate(names)])
    table = materialize(combos.join(packed, "_combo").drop("_combo"), "entries")
    same = [t.eqNullSafe(F.col(k)) for t, k in zip(text, keys, strict=True)]
    return df.join(table, same, "left").drop(*keys)


def _replaced(df: DataFrame, entries: DataFrame, names: Iterable[str], as_text: bool) -> DataFrame:
    names = list(names)
    found = attach_entries(df, entries, names)
    own = lambda n: F.col(f"`{n}`").cast("string") if as_text else F.col(f"`{n}`")
    return found.withColumns({n: F.coalesce(f"_m{i}", own(n)) for i, n in enumerate(names)}).drop(*[f"_m{i}" for i in range(len(names))])


def label_codes(df: DataFrame, codes: DataFrame, names: Iterable[str]) -> DataFrame:
    """Codes → labels in several columns from one code list ``(variable, code, label)``; codes without a label stay as text.

    A code that is listed twice takes its first label in text order.
    """
    entries = codes.select("variable", F.col("code").alias("original"), F.col("label").alias("mapped"))
    return _replaced(df, entries, names, True)


def remap(df: DataFrame, mapping: DataFrame, dataset: str, names: Iterable[str]) -> DataFrame:
    """Replace values through the mapping sheet; values without an entry stay as they are, one with several takes the first in text order."""
    return _replaced(df, mapping.where(F.col("dataset") == dataset).select("variable", "original", "mapped"), names, False)


def harmonize_sheet(df: DataFrame, sheet: DataFrame, source_col: str | None = None, sources: Iterable[str] | None = None) -> DataFrame:
    """:func:`harmonize_all` from a change sheet of any length, by join."""
    wanted = {r["variable"] for r in sheet.where(F.col("variable").isin(df.columns)).select("variable").distinct().collect()}
    names = [c for c in df.columns if c in wanted]
    if not names:
        return df
    found = attach_entries(df, sheet.select("variable", F.col("from").alias("original"), F.struct("to", "value").alias("mapped")), names)
    applies = F.col(source_col).isin(list(sources)) if sources is not None else F.lit(True)
    new = {}
    for i, n in enumerate(names):
        old, code, kept = F.col(f"`{n}`").cast("string"), F.when(applies, F.col(f"_m{i}.value")), f"{n}_code"
        new[n] = F.when(applies, F.coalesce(F.col(f"_m{i}.to"), old)).otherwise(old)
        new[kept] = F.coalesce(code, F.col(kept)) if kept in df.columns else code
    return found.withColumns(new).drop(*[f"_m{i}" for i in range(len(names))])


def recode_items(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Item codes → item texts; others unchanged."""
    return df.withColumn(col, F.coalesce(lookup(F.col(col), mapping), F.col(col)))


relabel = recode_items


def with_order(df: DataFrame, col: str, levels: list[str], name: str | None = None) -> DataFrame:
    """Add the position of the label among its levels, from 1; null for other labels."""
    return df.withColumn(name or f"{col}_ord", lookup(F.col(col), {v: i for i, v in enumerate(levels, 1)}))


def order_keys(levels: Mapping[str, list[str]], *names: str) -> list[Column]:
    """Sort keys: level order where a column has levels, else its value."""
    return [lookup(F.col(n), {v: i for i, v in enumerate(levels[n], 1)}) if n in levels else F.col(n) for n in names]


def ordered(df: DataFrame, levels: Mapping[str, list[str]], *names: str) -> DataFrame:
    """Sort by level order where a column has levels, else by value."""
    return df.orderBy(*order_keys(levels, *names))


def with_caption(df: DataFrame, captions: DataFrame, question: str = "question") -> DataFrame:
    """Attach the caption of each row's question, by join; a question that is listed twice takes its first caption in text order."""
    texts = captions.groupBy(F.col("question").alias("_question")).agg(F.min("caption").alias("caption"))
    return df.join(texts, F.col(question) == F.col("_question"), "left").select(*[F.col(f"`{c}`") for c in df.columns if c != "caption"], "caption")
