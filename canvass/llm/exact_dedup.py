"""Exact deduplication by deterministic block naming.

A text without white space is cut into blocks of a fixed number of characters. All distinct blocks of
the corpus are sorted and numbered; equal blocks share a number, different ones never do. Then
adjacent numbers are paired, the distinct pairs sorted and numbered again, level by level, until one
number is left per document. Two documents have the same (level, number) exactly if their texts are
equal: no step relies on a hash being free of collisions.

Blocks travel once, as the distinct ones are found and sorted. To bring the numbers back to the
documents without shuffling all texts again, blocks are addressed by a 128-bit digest. That the digest
tells the corpus's blocks apart is checked on the distinct blocks themselves; if it ever fails, it is
salted anew and the step repeated.

Only DataFrame functions are used. Every level is a map-side combined grouping on (row, position) and
a join on numbers, so a text that occurs millions of times spreads over its rows; the join on a very
frequent block is one that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import SPACE, col, free
from canvass.session import materialize

Digest = Callable[[Column, int], list[Column]]


def normalized(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def two_hashes(block: Column, salt: int) -> list[Column]:
    return [F.xxhash64(F.lit(salt), block), F.xxhash64(block, F.lit(salt))]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2048,
             digest: Digest = two_hashes) -> DataFrame:
    """One row per input row: its id, characters, digest of the normalised text and identity (level, number).

    Equal normalised texts, and only those, have equal identities. Null and empty texts and texts of
    white space are equal to each other (level -1). Null ids and repeated rows keep their own rows.
    An empty table gives an empty table. Columns other than the two named ones are not read.
    """
    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    clean = normalized(F.col("text"))
    blocks = F.regexp_extract_all(clean, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    rows, names = None, None
    for salt in range(64):
        rows = materialize(source.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.char_length("text").alias("chars"),
            F.sha2(clean, 256).alias("text_sha256"),
            F.transform(blocks, lambda b: F.struct(*[d.alias(f"d{i}") for i, d in enumerate(digest(b, salt))])).alias("blocks"),
        ), "rows")
        distinct = source.select(F.explode(blocks).alias("block")).distinct()
        keys = [d.alias(f"d{i}") for i, d in enumerate(digest(F.col("block"), salt))]
        # Sorted within the partitions of the grouping: the number holds partition and place.
        names = materialize(
            distinct.sortWithinPartitions("block").select(*keys, F.monotonically_increasing_id().alias("name")), "names")
        on = [c for c in names.columns if c != "name"]
        if names.groupBy(*on).count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no salt tells the blocks apart")
    rows = rows.withColumn("size", F.size("blocks"))
    longest = rows.agg(F.max("size")).first()[0] or 0
    parts = rows.select("row", "size", F.posexplode("blocks").alias("pos", "b")).select("row", "size", "pos", "b.*")
    current = parts.join(names, on).select("row", "size", "pos", "name")
    done, level = [], 0
    while longest > 1:
        done.append(current.where("size = 1").select("row", F.lit(level).alias("level"), "name"))
        pairs = materialize(
            current.where("size > 1").groupBy("row", "size", F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")), "pairs")
        names = materialize(
            pairs.select("left", "right").distinct().sortWithinPartitions("left", "right")
            .withColumn("name", F.monotonically_increasing_id()), "names")
        current = pairs.join(names, ["left", "right"]).select(
            "row", F.shiftright(F.col("size") + 1, 1).alias("size"), "pos", "name")
        longest, level = (longest + 1) // 2, level + 1
    named = current.select("row", F.lit(level).alias("level"), "name")
    for part in done:
        named = named.unionByName(part)
    return rows.join(named, "row", "left").select(
        "doc_id", "chars", "text_sha256", F.coalesce("level", F.lit(-1)).alias("level"),
        F.coalesce("name", F.lit(-1)).alias("name"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most characters stays, then the smallest id; null ids come last.
    Rows that repeat id and text count in ``group_size`` and are all marked as the row that stays is.
    """
    ids = materialize(identify(docs, id_col, text_col, **how), "identities")
    order = F.struct((-F.col("chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    groups = ids.groupBy("level", "name").agg(F.min(order)["c"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return ids.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that stay, with all their columns; ids are taken to identify documents.

    If several rows that stay have the same id and text, one of them is kept. An empty table gives an
    empty one; all columns come through, whatever their names.
    """
    name, times = free(docs, "_kept_id"), free(docs, "_kept_rows")
    kept = materialize(
        exact_groups(docs, id_col, text_col, **how).where("kept").groupBy(F.col("doc_id").alias(name))
        .agg(F.count(F.lit(1)).alias(times)), "kept")
    stay = docs.join(kept, col(id_col).eqNullSafe(F.col(name)), "left_semi")
    repeated = kept.where(F.col(times) > 1)
    if repeated.isEmpty():
        return stay
    again = col(id_col).eqNullSafe(F.col(name))
    return stay.join(repeated, again, "left_anti").unionByName(
        stay.join(repeated, again, "left_semi").dropDuplicates([id_col, text_col]))
