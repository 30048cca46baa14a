"""Data dictionary: variable profiles, question types, option strings, questionnaire text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def profile(df: DataFrame) -> DataFrame:
    """One row per variable: type, valid and missing answers, and numeric statistics.

    All variables are profiled in one aggregate over the table.
    """
    rows = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        numeric = isinstance(f.dataType, NUMERIC)
        d = c.cast("double") if numeric else F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(f.name).alias("variable"), F.lit("numeric" if numeric else "character").alias("type"),
            F.count(c).alias("valid"), F.sum(c.isNull().cast("bigint")).alias("missing"),
            F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd")))
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def profile_categories(df: DataFrame, levels: DataFrame, names: list[str]) -> DataFrame:
    """Counts per category of the labelled variables, with labels; listed categories without answers count 0.

    ``levels`` has ``variable``, ``code`` and ``label``.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    counts = (
        text.unpivot([], names, "variable", "code").where(F.col("code").isNotNull())
        .groupBy("variable", "code").agg(F.count(F.lit(1)).alias("n"))
    )
    listed = levels.where(F.col("variable").isin(names)).select(
        "variable", F.col("code").cast("string").alias("code"), "label")
    return listed.join(counts, ["variable", "code"], "full_outer").withColumn(
        "n", F.coalesce(F.col("n"), F.lit(0).cast("bigint")))


def infer_qtype(df: DataFrame, levels: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Question type per variable from its number of value labels and its values."""
    fields = [f for f in df.schema.fields if names is None or f.name in names]
    rows = [F.struct(
        F.lit(f.name).alias("variable"), F.lit(isinstance(f.dataType, NUMERIC)).alias("numeric"),
        F.lit(isinstance(f.dataType, T.StringType)).alias("text"),
        F.coalesce(
            F.bool_and(F.col(f"`{f.name}`").cast("double").isin(0.0, 1.0)) if isinstance(f.dataType, NUMERIC)
            else F.lit(False), F.lit(True)).alias("binary"),
    ) for f in fields]
    facts = df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))
    labels = levels.groupBy("variable").agg(F.count(F.lit(1)).alias("labels"))
    n = F.coalesce(F.col("labels"), F.lit(0))
    qtype = (
        F.when(n > 1, "single choice")
        .when(F.col("numeric") & (n == 1) & F.col("binary"), "multiple (dichotomous)")
        .when(F.col("numeric") & (n == 0), "numeric/open")
        .when(F.col("text"), "text")
        .otherwise("unknown")
    )
    return facts.join(labels, "variable", "left").select("variable", qtype.alias("qtype"))


def option_lists(levels: DataFrame) -> DataFrame:
    """``option_list``: the texts "label [code]" of each variable, in code order."""
    pair = F.struct(F.col("code"), F.concat("label", F.lit(" ["), F.col("code").cast("string"), F.lit("]")).alias("text"))
    return levels.groupBy("variable").agg(
        F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["text"]).alias("option_list"))


def options_string(levels: DataFrame) -> DataFrame:
    """``"label [code] | label [code]"`` per variable, in code order, for display."""
    return option_lists(levels).select("variable", F.array_join("option_list", " | ").alias("options"))


def questionnaire(df: DataFrame, questions: Mapping[str, str], levels: DataFrame) -> DataFrame:
    """Variable, question text, type and options, one row per variable; texts default to the name.

    Options come as a list, and joined for display; labels may hold the separator.
    """
    spec = infer_qtype(df, levels)
    texts = df.sparkSession.createDataFrame(
        [(c, i, questions.get(c) or c) for i, c in enumerate(df.columns)],
        "variable string, position int, question string")
    return spec.join(texts, "variable").join(option_lists(levels), "variable", "left").select(
        "position", "variable", "question", "qtype", F.array_join("option_list", " | ").alias("options"), "option_list")


def group_by_question(spec: DataFrame) -> DataFrame:
    """Number questions with the same text, list their variables and flag multiple-choice groups.

    A specification has one row per variable of a questionnaire, so the window stays short.
    """
    groups = spec.groupBy("question").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "variable"))),
                                 lambda v: v["variable"]), ", ").alias("variables_in_group"),
        F.bool_or(F.col("qtype").rlike("multiple|dichotomous")).alias("has_multiple"))
    groups = groups.withColumn("group_id", F.dense_rank().over(Window.orderBy("question")))
    return spec.join(groups, "question")


def questionnaire_blocks(spec: DataFrame) -> DataFrame:
    """One markdown block per variable, in questionnaire order."""
    # Headings and marks of a block.
    bullets = F.concat(F.lit("**Options:**\n- "), F.array_join("option_list", "\n- "))
    block = F.concat(
        F.lit("## "), F.col("variable"), F.lit("\n**Question:** "), F.col("question"),
        F.lit("\n**Type:** "), F.col("qtype"), F.lit("\n"), F.coalesce(bullets, F.lit("")), F.lit("\n\n---\n"))
    return spec.select("position", "variable", block.alias("block"))
