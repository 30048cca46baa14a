"""Writers for extracts, intermediate tables, codebooks and questionnaires."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators.dictionary import questionnaire_blocks
from canvass.operators.filters import SurveyParams, apply_params


def write_csv(df: DataFrame, path: str, null_value: str = "") -> None:
    """Csv with a header; nulls become ``null_value``, empty strings stay empty."""
    (df.write.option("header", "true").option("nullValue", null_value).option("emptyValue", "").csv(path))


def export_extract(df: DataFrame, params: SurveyParams, path: str) -> DataFrame:
    """Write the respondents of the current parameters; returns the extract."""
    extract = apply_params(df, params)
    write_csv(extract, path)
    return extract


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """One directory per named table; returns the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        writer = df.write
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.format(fmt).save(paths[name])
    return paths


def codebook_elements(profile: DataFrame, categories: DataFrame, questions: Mapping[str, str]) -> DataFrame:
    """Variable descriptions as nested elements: label, summary statistics, categories with frequencies."""
    texts = profile.sparkSession.createDataFrame(
        [(k, v) for k, v in questions.items()], "variable string, _text string")
    cats = categories.groupBy("variable").agg(F.sort_array(F.collect_list(F.struct(
        F.col("code").alias("catValu"), F.col("label").alias("labl"),
        F.struct(F.lit("freq").alias("_type"), F.col("n").alias("_VALUE")).alias("catStat")))).alias("catgry"))

    def stat(kind: str, value: str):
        return F.struct(F.lit(kind).alias("_type"), F.col(value).cast("string").alias("_VALUE"))

    kinds = [("vald", "valid"), ("invd", "missing"), ("min", "min"), ("max", "max"), ("mean", "mean"), ("stdev", "sd")]
    stats = F.filter(F.array(*[stat(k, v) for k, v in kinds]), lambda s: s["_VALUE"].isNotNull())
    return profile.join(texts, "variable", "left").join(cats, "variable", "left").select(
        F.col("variable").alias("_name"), F.coalesce("_text", "variable").alias("labl"),
        stats.alias("sumStat"), "catgry", F.struct(F.col("type").alias("_type")).alias("varFormat"))


def write_codebook_xml(elements: DataFrame, path: str) -> None:
    """Write variable descriptions as xml, one element per variable."""
    elements.write.format("xml").option("rootTag", "dataDscr").option("rowTag", "var").save(path)


def write_questionnaire(spec: DataFrame, path: str) -> None:
    """Questionnaire text: a title, then one block per variable in order.

    A questionnaire has one row per variable, so one output file holds it.
    """
    blocks = questionnaire_blocks(spec).select("position", "block")
    title = spec.sparkSession.createDataFrame([(-1, "# Questionnaire\n")], "position int, block string")
    title.unionByName(blocks).coalesce(1).sortWithinPartitions("position").select("block").write.text(path)
