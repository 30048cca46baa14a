"""Mixing sources to target weights by Poisson replication.

Each document is repeated a number of times that follows a Poisson distribution whose mean is the rate
of its source: the source's share of the target mixture over its share of the corpus. The number is
found by inverting the distribution at a uniform value taken from a hash of seed and id, so it depends
on nothing else: not on partitions, retries or other documents.

Rates above ``PART`` are split into equal parts with a value each, since the sum of independent
Poisson numbers is one again; so tables of the distribution stay short whatever the rate. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.ranking import number_rows
from canvass.llm.common import col, free
from canvass.session import materialize

# Largest mean of one Poisson number, and the bits of a uniform value.
PART = 64
BITS = 52


def uniform(*key: Column) -> Column:
    """A value between 0 and 1, neither included, from the hash of the key; a null counts as its own text."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("\\N")) for k in key])
    drawn = F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")
    return (drawn.cast("double") + F.lit(0.5)) / F.lit(float(2**BITS))


def distribution(rate: Column) -> Column:
    """P(X <= k) of a Poisson number for k = 0, 1, …, until what is left is below any uniform value."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), last), start,
        lambda acc, k: F.struct(
            (acc["term"] * rate / k).alias("term"),
            F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["term"] * rate / k)).alias("sums")),
        lambda acc: acc["sums"])


def rates(docs: DataFrame, targets: DataFrame | None = None, source_col: str = "source", text_col: str = "text",
          budget: float = 1.0) -> DataFrame:
    """Per source: characters, rate, parts and the distribution of one part.

    ``targets`` has columns source and weight; without it all sources weigh the same. Sources that it
    does not name get weight 0, as do negative and null weights; weights of a repeated source are
    added; a null source is a source of its own. The mixture has ``budget`` times the characters of
    the corpus. Where the texts of a source are all empty, no rate gives it its share: it gets 0.
    """
    have = docs.groupBy(col(source_col).alias("mix_source")).agg(
        F.sum(F.coalesce(F.char_length(col(text_col)), F.lit(0)).cast("bigint")).alias("chars"))
    if targets is None:
        weighed = have.withColumn("weight", F.lit(1.0))
    else:
        wanted = targets.groupBy(F.col("source").alias("of")).agg(
            F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        weighed = have.join(wanted, F.col("mix_source").eqNullSafe(F.col("of")), "left").drop("of").fillna(0.0, ["weight"])
    weighed = materialize(weighed, "weights")
    corpus = weighed.agg(F.sum("chars")).first()[0] or 0
    weighed = weighed.where("weight > 0 AND chars > 0")
    weights = weighed.agg(F.sum("weight")).first()[0] or 1.0
    rate = F.col("weight") / F.lit(weights) * (F.lit(float(budget)) * F.lit(corpus) / F.col("chars"))
    # Rates are few and written down, so that the planner sees the size of what it joins.
    return materialize(
        weighed.select("mix_source", "chars", rate.alias("rate"))
        .withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
        .withColumn("sums", distribution(F.col("rate") / F.col("parts"))), "rates")


def copies(id_column: Column, seed: int) -> Column:
    """How often a document is repeated, by the joined ``parts`` and ``sums`` of its source."""
    def one(part: Column) -> Column:
        u = uniform(F.lit(seed), id_column, part)
        return F.size(F.filter("sums", lambda p: p < u))
    return F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + one(part))


def replicate(docs: DataFrame, targets: DataFrame | None = None, seed: int = 0, id_col: str = "doc_id",
              source_col: str = "source", text_col: str = "text", budget: float = 1.0, keep: list[str] | None = None,
              copy_name: str = "_mix_copy", key_name: str = "_mix_key") -> DataFrame:
    """The documents, each as often as drawn, with ``copy_name`` counted from 1 and the key of the order, ``key_name``.

    Rows with the same id are drawn alike, a null id like any other one. Documents with a null or
    empty text are drawn with the rate of their source. Columns of the two names are replaced, others
    may have any names. An empty table gives an empty one.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (copy_name.lower(), key_name.lower())]
    by_source = rates(docs, targets, source_col, text_col, budget)
    # The row travels as one column, so its names cannot meet those of the rates.
    packed = docs.select(F.struct(*map(col, kept)).alias("row"), col(id_col).alias("id"), col(source_col).alias("source"))
    drawn = packed.join(by_source.select("mix_source", "parts", "sums"), F.col("source").eqNullSafe(F.col("mix_source")))
    times = drawn.withColumn("times", copies(F.col("id"), seed)).where("times > 0")
    copied = times.select("row", "id", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col("id").cast("string"), F.lit("\\N")), "copy"))
    return copied.select("row.*", F.col("copy").alias(copy_name), key.alias(key_name))


def mix(docs: DataFrame, targets: DataFrame | None = None, **how) -> DataFrame:
    """The mixture in a global random order, with the columns of the documents.

    The order is that of a hash of seed, id and copy, cut into ranges: one shuffle, in which no copy
    of a document is nearer to its sister than chance has it. For nulls, repeated rows and empty
    tables see ``replicate``; all columns come through, whatever their names.
    """
    copy, key = free(docs, "_mix_copy"), free(docs, "_mix_key")
    drawn = replicate(docs, targets, copy_name=copy, key_name=key, **how)
    return drawn.repartitionByRange(col(key)).sortWithinPartitions(col(key)).drop(copy, key)


def mixture(docs: DataFrame, targets: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The mixture without its texts: id, source, copy and the place in the global order, from 1; see ``replicate`` for edge cases."""
    drawn = replicate(docs, targets, id_col=id_col, source_col=source_col, keep=[id_col, source_col], **how)
    narrow = drawn.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), F.col("_mix_copy").alias("copy"), "_mix_key")
    return number_rows(narrow, [], ["_mix_key", "doc_id", "copy"], "position").drop("_mix_key")
