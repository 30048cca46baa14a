"""Readers for survey files, codebooks and result tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.operators.codebook import Codebook, label_codes, label_variables


@dataclass
class LabelledSurvey:
    """A survey table with its question texts and value labels."""

    data: DataFrame
    questions: dict[str, str]
    codes: DataFrame | None = None

    @property
    def levels(self) -> dict[str, dict[str, str]]:
        """Labels by variable and code, for looking at; decoding joins the code list."""
        found: dict[str, dict[str, str]] = {}
        for r in self.codes.where(F.col("variable").isin(self.data.columns)).collect() if self.codes is not None else []:
            found.setdefault(r["variable"], {})[str(r["code"])] = r["label"]
        return found

    def decoded(self) -> DataFrame:
        """Codes replaced by labels."""
        if self.codes is None:
            return self.data
        listed = self.codes.where(F.col("variable").isin(self.data.columns)).select("variable").distinct().collect()
        return label_codes(self.data, self.codes, [r["variable"] for r in listed])


def read_survey(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None,
                codebook: Codebook | None = None, levels: DataFrame | None = None) -> LabelledSurvey:
    """Load a survey with its dictionary; csv needs a schema, so that files are not read to guess one.

    ``levels`` has ``variable``, ``code`` and ``label``.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        if schema is None:
            raise ValueError("csv surveys need a schema")
        reader = reader.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    data = reader.load(path)
    questions = codebook.questions(data.columns) if codebook else {}
    return LabelledSurvey(label_variables(data, questions), questions, levels)


def read_surveys(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, pattern: str = "*",
                 name: str = "source") -> DataFrame:
    """All surveys of a folder as one table, tagged with the survey's name without extension.

    A survey is a file, or a directory of files, directly below ``path``.
    """
    base = path.rstrip("/")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.load(f"{base}/{pattern}")
    stem = F.regexp_extract(F.col("_metadata.file_path"), rf"/\Q{base.rsplit('/', 1)[-1]}\E/([^/.]+)", 1)
    return df.select("*", stem.alias(name))


def read_survey_files(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet",
                      columns: Mapping[str, Mapping[str, str]] | None = None, name: str = "source") -> DataFrame:
    """Files with different columns, one per source: renamed to shared columns, tagged and stacked.

    ``columns`` maps a source to ``{raw name: shared name}``; other columns of that source are not read.
    """
    parts = []
    for source, path in paths.items():
        df = spark.read.format(fmt).load(path)
        if columns and source in columns:
            df = df.select(*[F.col(raw).alias(clean) for raw, clean in columns[source].items()])
        parts.append(df.withColumn(name, F.lit(source)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_two_header(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """An export whose line 1 holds the names and line 2 the question texts: ``(data, labels)``.

    Every file of the export repeats both lines. The label line is read once; rows equal to it in
    every column are taken out of the data, which stays a plain distributed scan.
    """
    raw = spark.read.option("header", "true").option("multiLine", str(multiline).lower()).csv(path)
    first = raw.first()
    if first is None:
        raise ValueError(f"no label line in {path}")
    is_label = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.lit(first[c])) for c in raw.columns])
    labels = spark.createDataFrame([(c, first[c]) for c in raw.columns], "variable string, label string")
    return raw.where(~is_label), labels


def read_csv_renamed(spark: SparkSession, path: str, schema: str, mapping: Mapping[str, str]) -> DataFrame:
    """Read a csv with plain column names and give the columns their display names."""
    df = spark.read.option("header", "true").schema(schema).csv(path)
    return df.withColumnsRenamed(dict(mapping))
