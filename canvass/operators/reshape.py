"""Long and wide forms, exploded options, totals rows and grids."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_long(df: DataFrame, key: list[str], names: Iterable[str], name: str = "question", value: str = "value") -> DataFrame:
    """Wide → long. Nulls stay; columns of different types become text."""
    names = list(names)
    types = {f.name: f.dataType for f in df.schema.fields}
    if len({types[n].simpleString() for n in names}) > 1:
        df = df.withColumns({n: F.col(f"`{n}`").cast("string") for n in names})
    return df.unpivot(key, [F.col(f"`{n}`") for n in names], name, value)


def to_long_measures(df: DataFrame, key: list[str], measures: list[str], sep: str = "_", name: str = "question") -> DataFrame:
    """Columns ``Q1_perc, Q1_count, …`` → rows ``(question, perc, count)``."""
    questions = list(dict.fromkeys(
        c[: -len(sep + m)] for c in df.columns for m in measures if c.endswith(sep + m) and c not in key))
    rows = [F.struct(F.lit(q).alias(name), *[F.col(f"{q}{sep}{m}").alias(m) for m in measures]) for q in questions]
    return df.select(*key, F.inline(F.array(*rows)))


def to_wide(df: DataFrame, index: list[str], names: str, values: str, levels: list[str], agg=F.sum) -> DataFrame:
    """Long → wide with the given levels as columns; absent cells are null."""
    return df.groupBy(*index).pivot(names, levels).agg(agg(values))


def to_wide_measures(df: DataFrame, index: list[str], names: str, measures: Mapping[str, str], levels: list[str]) -> DataFrame:
    """Long → wide with several measures per level, columns interleaved as ``{level}_{measure}``."""
    aggs = [F.first(src, ignorenulls=True).alias(out) for out, src in measures.items()]
    wide = df.groupBy(*index).pivot(names, levels).agg(*aggs)
    if len(aggs) == 1:
        wide = wide.withColumnsRenamed({lv: f"{lv}_{out}" for lv in levels for out in measures})
    return wide


def transpose(df: DataFrame, index: str, rows: list[str], name: str = "name") -> DataFrame:
    """Swap the rows and columns of a result table; ``rows`` lists the index values to keep as columns."""
    others = [c for c in df.columns if c != index]
    return to_wide(to_long(df, [index], others, name, "_value"), [name], index, "_value", rows, F.first)


def _depths(tokens: Column, opening: str, closing: str) -> Column:
    """How many parentheses are open at each token, counted from the front; one that closes nothing is text."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("all"))

    def step(s: Column, t: Column) -> Column:
        depth = F.when(t == opening, s["depth"] + 1).when(t == closing, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.concat(s["all"], F.array(depth)).alias("all"))

    return F.aggregate(tokens, start, step, lambda s: s["all"])


def split_outside(text: Column, sep: str = ",") -> Column:
    """The parts of a text between separators that lie in no pair of parentheses, however deep they are nested.

    A separator lies in a pair if a parenthesis is open before it and one is closed behind it, so
    parentheses without partner are text. Null stays null, an empty text is one empty part.
    """
    quoted = f"\\Q{sep}\\E"
    tokens = F.regexp_extract_all(text, F.lit(f"(?s){quoted}|[()]|(?:(?!{quoted})[^()])+"), F.lit(0))
    back = F.reverse(_depths(F.reverse(tokens), ")", "("))
    marked = F.arrays_zip(tokens.alias("t"), _depths(tokens, "(", ")").alias("l"), back.alias("r"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, m: Column) -> Column:
        cut = (m["t"] == sep) & (F.least(m["l"], m["r"]) == 0)
        return F.struct(F.when(cut, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
                        F.when(cut, "").otherwise(F.concat(s["open"], m["t"])).alias("open"))

    folded = F.aggregate(marked, start, step, lambda s: F.concat(s["done"], F.array(s["open"])))
    # Pairs that are complete and not nested, as in most answers, need no counting: a pattern finds the same separators.
    flat = text.rlike(r"^[^()]*+(?:\([^()]*+\)[^()]*+)*+\z")
    return F.when(flat, F.split(text, quoted + r"(?![^()]*\))")).otherwise(folded)


def explode_options(df: DataFrame, col: str, sep: str = ",", paren_aware: bool = False, name: str | None = None) -> DataFrame:
    """One row per option of a delimited answer; a null answer stays as one null row."""
    parts = split_outside(F.col(col), sep) if paren_aware else F.split(F.col(col), f"\\Q{sep}\\E")
    return df.withColumn(name or col, F.explode_outer(parts))


def explode_all(df: DataFrame, by: str, token: str, mark: str = "_all") -> DataFrame:
    """Repeat each row under the token, next to its own group; ``mark`` tells the repetition from a group of that name."""
    own, every = F.struct(F.col(by).alias("by"), F.lit(False).alias("all")), F.struct(F.lit(token).alias("by"), F.lit(True).alias("all"))
    return df.withColumn(mark, F.explode(F.array(own, every))).withColumns({by: F.col(f"{mark}.by"), mark: F.col(f"{mark}.all")})


def with_totals(counts: DataFrame, by: str, keys: list[str], value: str = "n", label: str = "Total",
                mark: str | None = None) -> DataFrame:
    """Add the total over ``by`` for every combination of the keys.

    Works on counted rows, so the repetition costs nothing next to the count itself. A null group is
    its own group and never mistaken for the total, nor is a group that bears the label; ``mark`` names
    a column that is true in the totals.
    """
    out = explode_all(counts, by, label).groupBy(by, "_all", *keys).agg(F.sum(value).alias(value))
    return out.withColumnRenamed("_all", mark) if mark else out.drop("_all")


def fill_absent(df: DataFrame, value: float = 0, names: list[str] | None = None) -> DataFrame:
    """Absent cells of a cross-tab become a number."""
    return df.na.fill(value, subset=names)


def append_sample_row(table: DataFrame, sizes: DataFrame, by: str, levels: list[str], name: str = "question",
                      measure: str = "n", label: str = "Sample Size") -> DataFrame:
    """Append the group sizes as a last row below a table with ``{level}_{measure}`` columns."""
    row = (
        sizes.groupBy(F.lit(label).alias(name)).pivot(by, levels).agg(F.sum("n"))
        .withColumnsRenamed({lv: f"{lv}_{measure}" for lv in levels})
    )
    return table.unionByName(row, allowMissingColumns=True)


def grid(spark: SparkSession, levels: Mapping[str, list]) -> DataFrame:
    """All combinations of the given values."""
    df = spark.range(1)
    for name, values in levels.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df.drop("id")


def complete_grid(df: DataFrame, levels: Mapping[str, list], fill: Mapping[str, float]) -> DataFrame:
    """Add the missing combinations to a counted table, with fill values."""
    full = grid(df.sparkSession, levels)
    return full.join(df, list(levels), "left").na.fill(dict(fill))


def expand_seq(df: DataFrame, lo: float, hi: float, n: int, name: str = "x") -> DataFrame:
    """Repeat each row for n equally spaced numbers from lo to hi."""
    step = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i")
    x: Column = F.lit(float(lo)) + F.col("_i") * ((float(hi) - float(lo)) / (n - 1))
    return df.select("*", step).withColumn(name, x).drop("_i")


def grid_cell(df: DataFrame, medium, place, medium_col: str = "medium", place_col: str = "place") -> DataFrame:
    """Answers of one cell of a two-level grid kept in long form."""
    return df.where((F.col(medium_col) == medium) & (F.col(place_col) == place))


def grid_to_long(df: DataFrame, key: list[str], stem: str, media: Iterable, places: Iterable) -> DataFrame:
    """Columns ``{stem}_{medium}_{place}`` → rows ``(medium, place, value)``; unanswered cells drop."""
    have = set(df.columns)
    cells = [(m, p) for m in media for p in places if f"{stem}_{m}_{p}" in have]
    rows = [F.struct(F.lit(m).alias("medium"), F.lit(p).alias("place"), F.col(f"{stem}_{m}_{p}").alias("value"))
            for m, p in cells]
    return df.select(*key, F.inline(F.array(*rows))).where(F.col("value").isNotNull())


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def rbind(*frames: DataFrame) -> DataFrame:
    """Union by position."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def first_rows(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The first n rows in key order, found without sorting the whole table."""
    return df.orderBy(*key).limit(n)


def distinct_values(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names).distinct()
