"""Shards along a Hilbert curve over metadata columns.

Every metadata column is quantised to 2**bits levels by its own quantiles, so a skewed column uses all
levels. The levels are the coordinates of a cell on a Hilbert curve; documents are sorted by the place
of their cell on the curve and the sorted run is cut into shards of equal row counts. Neighbours on
the curve are neighbours in every column, so the files of a shard span narrow ranges of all columns
and a filter on any of them skips most files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.quantiles import exact_quantiles, weighted_values
from canvass.functions.ranking import number_rows
from canvass.llm.common import col
from canvass.session import materialize


def hilbert_place(cell: tuple[int, ...], bits: int) -> int:
    """Place of a grid cell on the Hilbert curve (Gray-code walk through nested, rotated orthants)."""
    dims = len(cell)
    mask = (1 << dims) - 1
    entry, direction, place = 0, 0, 0
    turn = lambda v, by: ((v >> by) | (v << (dims - by))) & mask
    for level in reversed(range(bits)):
        corner = sum(((x >> level) & 1) << d for d, x in enumerate(cell))
        gray = turn(corner ^ entry, (direction + 1) % dims)
        rank, shift = gray, 1
        while shift < dims:
            rank ^= rank >> shift
            shift *= 2
        place = (place << dims) | rank
        start = 0 if rank == 0 else (2 * ((rank - 1) // 2)) ^ ((2 * ((rank - 1) // 2)) >> 1)
        entry ^= turn(start, (dims - (direction + 1) % dims) % dims)
        low = rank if rank % 2 else rank - 1
        ones = 0 if rank == 0 else (~low & (low + 1)).bit_length() - 1
        direction = (direction + ones + 1) % dims
    return place


def curve(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """Cell number and place on the curve of every cell of the grid: 2**(dims * bits) rows, whatever the data."""
    def cells(batches):
        import pandas as pd
        for batch in batches:
            at = [tuple((int(c) >> (bits * (dims - 1 - d))) & ((1 << bits) - 1) for d in range(dims)) for c in batch["id"]]
            yield pd.DataFrame({"cell": batch["id"], "hilbert": [hilbert_place(a, bits) for a in at]})
    return spark.range(1 << (dims * bits)).mapInPandas(cells, "cell long, hilbert long")


def ordinals(docs: DataFrame, dims: list[str]) -> dict[str, Column]:
    """An order-preserving value per column: numbers and dates as doubles, strings as they are."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    out = {}
    for d in dims:
        if isinstance(kinds[d], T.StringType):
            out[d] = col(d)
        elif isinstance(kinds[d], (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[d] = F.unix_micros(col(d).cast("timestamp")).cast("double")
        else:
            out[d] = col(d).cast("double")
    return out


def string_cuts(values: DataFrame, column: str, parts: int) -> list[str]:
    """The strings that cut the column's rows into equal parts, by the ranks of its distinct values; at most parts - 1.

    Distinct values are counted where they lie and ranked over all partitions; quantiles of the ranks,
    each as often as its value, are exact however skewed the values are.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = materialize(number_rows(counted, [], ["value"], "rank"), "ranks")
    found = exact_quantiles(weighted_values(ranked, [], "rank", "n"), [], [k / parts for k in range(1, parts)]).first()
    wanted = sorted({int(q) for q in found["quantiles"]}) if found else []
    return [r["value"] for r in ranked.where(F.col("rank").isin(wanted)).orderBy("rank").collect()] if wanted else []


def assign(docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 4,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the dimensions' place ``hilbert``, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: counts of two shards differ by one at most; slots of a shard are numbered
    from 0 without gaps in curve order. Ties within a cell are ordered by checksum and id, so equal
    texts of a cell lie side by side; those that differ in a dimension may be in different shards. Repeated rows take neighbouring places. A null in a dimension is
    on the lowest level. A null text has size 16 and the checksum of the empty text. With fewer rows
    than shards some shards are empty; an empty table gives an empty table.
    """
    value = ordinals(docs, list(dims))
    text = F.coalesce(col(text_col), F.lit(""))
    narrow = materialize(docs.select(
        col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), *[value[d].alias(f"d{i}") for i, d in enumerate(dims)]), "metadata")
    steps = [k / 2**bits for k in range(1, 2**bits)]
    texts = [i for i in range(len(dims)) if isinstance(narrow.schema[f"d{i}"].dataType, T.StringType)]
    numbers = [i for i in range(len(dims)) if i not in texts]
    cuts = dict(zip(numbers, narrow.agg(F.lit(0), *[F.percentile_approx(f"d{i}", steps, 10_000) for i in numbers]).first()[1:], strict=True))
    cuts |= {i: string_cuts(narrow, f"d{i}", 2**bits) for i in texts}
    cell = F.lit(0).cast("bigint")
    for i in range(len(dims)):
        level = sum((F.when(F.col(f"d{i}") > c, 1).otherwise(0) for c in sorted(set(cuts[i] or []))), F.lit(0))
        cell = cell * 2**bits + level
    placed = narrow.withColumn("cell", cell).join(F.broadcast(curve(docs.sparkSession, len(dims), bits)), "cell")
    total = narrow.count()
    at = number_rows(placed.select("doc_id", "size", "text_crc32", "hilbert"), [], ["hilbert", "text_crc32", "doc_id"], "at")
    zero = F.col("at") - 1
    shard = F.floor(zero * shards / F.lit(max(total, 1)).cast("bigint")) if total * shards < 2**52 else F.floor(
        (zero.cast("decimal(20,0)") * shards) / total)
    first = F.floor((shard.cast("decimal(20,0)") * total + shards - 1) / shards)
    return at.select(
        "doc_id", "size", "text_crc32", "hilbert", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (zero - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **how) -> None:
    """Write the documents as one folder per shard, in curve order; ids are taken to identify documents.

    Rows go to their shards by one range shuffle, so a shard may consist of several files, each of
    them a run of the curve.
    """
    place = materialize(assign(docs, id_col=id_col, **how).select(
        F.col("doc_id").alias("_of"), F.col("shard").alias("shard"), F.col("slot").alias("slot")).dropDuplicates(["_of"]), "places")
    plain = docs.select(*[col(c) for c in docs.columns if c not in ("shard", "slot")])
    (plain.join(place, col(id_col).eqNullSafe(F.col("_of"))).drop("_of")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
