"""Row numbers and group ids over whole tables, without one task holding a whole group.

A window over a large group sorts the group in one task. Here the rows are range-partitioned and
sorted by (group, order), so a hot group spreads over many partitions. A row's number is its place in
its partition plus the group's rows in earlier partitions; only one count per group and partition is
shuffled for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.session import materialize

# Fixed value: monotonically_increasing_id keeps the partition above bit 33, the place below it.
PLACE_BITS = 33


def number_rows(df: DataFrame, by: list[str], order: list[str], name: str = "row", keep: list[str] | None = None) -> DataFrame:
    """Number rows from 1 within ``by`` in the given order.

    ``by + order`` should identify a row, otherwise ties are numbered arbitrarily. Partition and
    place are written down once, so a lost executor cannot renumber rows halfway. With ``keep`` only
    ``by`` and these columns are written and returned, so wide columns can order rows and stay out.
    """
    place = F.monotonically_increasing_id()
    columns = df.columns if keep is None else [*by, *keep]
    placed = materialize(
        df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).select(*columns, place.alias("_place")), "numbered"
    ).withColumn("_part", F.shiftright("_place", PLACE_BITS))
    sizes = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Written down so that the planner sees how few they are and does not shuffle the rows for them.
    offsets = materialize(sizes.select(
        *[F.col(k).alias(f"_of{i}") for i, k in enumerate([*by, "_part"])],
        (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")), "offsets")
    same = [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate([*by, "_part"])]
    return placed.join(offsets, same, "left").select(*columns, (F.col("_place") + F.col("_shift")).alias(name))


def group_ids(df: DataFrame, col: str, name: str = "group_id") -> DataFrame:
    """Give rows with the same text the same number, counted in text order from 1; a null stays without.

    Distinct texts are sorted; rows meet their number by a digest of the text, so no text is written and
    only digests are joined. That no two texts share a digest is checked. Rows without a text have keys
    of their own and are not drawn together.
    """
    digest = F.unhex(F.sha2(F.col(col).cast("string"), 256))
    texts = df.where(F.col(col).isNotNull()).groupBy(digest.alias("_digest")).agg(F.min(col).alias("_text"), (F.min(col) == F.max(col)).alias("_one"))
    numbers = materialize(number_rows(texts, [], ["_text"], name, keep=["_digest", "_one"]), "numbers")
    if not numbers.where("NOT _one").isEmpty():
        raise ValueError(f"two texts of {col!r} share a digest")
    own = F.to_binary(F.concat(F.lit("-"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string")), F.lit("utf-8"))
    return df.withColumn("_key", F.coalesce(digest, own)).join(
        numbers.select(F.col("_digest").alias("_key"), name), "_key", "left").drop("_key")
