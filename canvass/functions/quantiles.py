"""Exact quantiles of very large groups.

The built-in exact percentile gathers every distinct value of a group in one task. Here a first pass
counts values, map-side, into buckets by sign, power of two and 4 096 equal parts of each power. A
second pass takes only the values of the buckets that hold the wanted ranks. Among those, 65 536 equal
parts narrow the search again, so that at most about 2^24 different doubles are ranked by value in one
place. No shuffle carries more than a histogram or the values of the found buckets.

The found buckets and their values are written to the shared folder. The planner then knows their real
size and broadcasts the buckets if they are small; an estimate from the source would make it shuffle
all values instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.session import materialize

PARTS_OF_POWER = 4_096
PARTS_OF_BUCKET = 65_536
WEIGHT = "decimal(28,9)"


def weighted_values(df: DataFrame, by: list[str], col: str, weight: str | None = None) -> DataFrame:
    """Keys, value ``_v`` and how often it counts, ``_n``; null values and weights that are null or not positive drop out.

    Whole weights stay whole. Others are taken to nine decimals, whose sums are exact in any order; where the
    largest is very small or very large, all are first multiplied by a power of ten, which ``_n`` keeps as metadata.
    """
    whole = weight is None or isinstance(df.schema[weight].dataType, T.IntegralType)
    n, power = (F.col(weight) if weight else F.lit(1)), 0
    if not whole:
        peak = df.agg(F.max(F.col(weight).cast("double"))).first()[0] or 0.0
        if 0 < peak < 1e-3 or 1e12 < peak < float("inf"):
            power = -math.floor(math.log10(peak))
            n = n.cast("double") * F.lit(10.0 ** power)
    n = n.cast("bigint" if whole else WEIGHT)
    values = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_v"), n.alias("_n", metadata={"power": power}))
    return values.where(F.col("_n") > 0) if weight else values


def exact_quantiles(values: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Interpolated quantiles (the default rule of R) per group of :func:`weighted_values`.

    Returns the keys, ``n`` and ``quantiles``, an array in the order of ``probs``. With fractional
    weights ranks are cumulative weights: a quantile is the value whose span of them holds that part
    of the sum, and nothing is interpolated.
    """
    kind = values.schema["_n"].dataType
    whole = isinstance(kind, T.IntegralType)
    keys = [f"_k{i}" for i in range(len(by))]
    keyed = values.select(
        *[F.col(k).alias(a) for k, a in zip(by, keys, strict=True)], "_v", "_n",
        _magnitude(F.col("_v")).alias("_b0"))
    if whole:
        low = [F.floor((F.col("n") - 1) * p).cast("bigint") for p in probs]
        high = [F.least(r + 1, F.col("n") - 1) for r in low]
    else:
        last_rank = (F.col("n") - F.lit("1e-9").cast(WEIGHT)).cast(WEIGHT)
        low = high = [F.least((F.col("n").cast("double") * p).cast(WEIGHT), last_rank) for p in probs]
    wanted = F.array_distinct(F.array(*low, *high))

    n, lowest, highest = F.sum("_n").cast(kind).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    histogram = (
        keyed.groupBy(*keys, "_b0").agg(n, lowest, highest)
        .withColumn("n", F.sum("_n").over(Window.partitionBy(*keys)).cast(kind))
        .withColumns({"_ranks": wanted, "_base": F.lit(0).cast(kind)})
    )
    picked = materialize(_locate(histogram, keys, "_b0"), "buckets")

    kept = [F.first(c).alias(c) for c in ("_lo", "_hi", "n", "_ranks", "_base")]
    near = materialize(
        _members(keyed, picked, [*keys, "_b0"]).groupBy(*keys, "_b0", "_v").agg(n, *kept)
        .withColumn("_b1", _part(F.col("_v"), F.col("_lo"), F.col("_hi"))), "values")

    path = [*keys, "_b0", "_b1"]
    picked = _locate(near.groupBy(*path).agg(n, *kept), path[:-1], "_b1")
    last = _members(near.select(*path, "_v", "_n"), picked, path)
    found = (
        _locate(last, path, "_v")
        .select(*keys, "n", "_v", F.explode("_ranks").alias("_rank"))
        .groupBy(*keys, "n")
        .agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    )
    at = F.col("_at")
    quantiles = []
    for p, r, s in zip(probs, low, high, strict=True):
        below, above = at[r], at[s]
        part = (F.col("n") - 1) * p - r if whole else F.lit(0.0)
        # Between equal or infinite neighbours there is nothing to interpolate.
        inner = (part > 0) & (below != above) & ((below != float("-inf")) | (above == float("inf")))
        quantiles.append(F.when(inner, below + part * (above - below)).otherwise(below))
    power = values.schema["_n"].metadata.get("power", 0)
    total = F.col("n").cast("double") / F.lit(10.0 ** power) if power else F.col("n")
    return found.select(
        *[F.col(a).alias(k) for k, a in zip(by, keys, strict=True)], total.alias("n"),
        F.array(*quantiles).alias("quantiles"))


def _magnitude(v: Column) -> Column:
    """Ordered bucket number of a double: sign, power of two, equal part of the power."""
    power = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)))
    part = F.floor((F.abs(v) / F.pow(F.lit(2.0), power) - 1) * PARTS_OF_POWER)
    bucket = (power + 1200) * (2 * PARTS_OF_POWER) + part + 1
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, bucket).otherwise(-bucket)


def _part(v: Column, lo: Column, hi: Column) -> Column:
    """Bucket number of the value among equal parts of its enclosing bucket."""
    return F.when(hi > lo, F.floor((v - lo) / (hi - lo) * PARTS_OF_BUCKET)).otherwise(F.lit(0).cast("bigint"))


def _locate(buckets: DataFrame, within: list[str], order: str) -> DataFrame:
    """Keep the buckets that hold wanted ranks, with those ranks and the bucket's first rank.

    ``_base`` is the rank at which the enclosing bucket starts.
    """
    earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start, end = F.col("_base"), F.col("_base") + F.col("_n")
    kind = buckets.schema["_base"].dataType
    return (
        buckets.withColumn("_base", (F.col("_base") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).cast(kind))
        .withColumn("_ranks", F.filter("_ranks", lambda r: (r >= start) & (r < end)))
        .where(F.size("_ranks") > 0)
        .drop("_n")
    )


def _members(values: DataFrame, picked: DataFrame, path: list[str]) -> DataFrame:
    """Values inside the picked buckets, with what is known of the bucket."""
    target = picked.withColumnsRenamed({k: f"_t{k}" for k in path})
    same = [F.col(k).eqNullSafe(F.col(f"_t{k}")) for k in path]
    return values.join(target, same, "inner").drop(*[f"_t{k}" for k in path])
