"""Amounts: totals, means, medians, histograms, density curves, economic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.quantiles import exact_quantiles, weighted_values
from canvass.operators.reshape import explode_all
from canvass.session import materialize


def spend_summary(df: DataFrame, by: str, total: str, all_token: str | None = None,
                  approximate: bool = False) -> DataFrame:
    """Number, mean and median of a total per group, and over all groups under the token.

    The median is exact; no task holds a whole group. ``approximate`` takes it from a bounded sketch
    in one pass. For the exact one, groups and totals are written down, two columns, so that the source
    is read once.
    """
    rows = df.select(by, total).where(F.col(total).isNotNull())
    if not approximate:
        rows = materialize(rows, "totals")
    keys = [by] if all_token is None else [by, "_all"]
    rows = (explode_all(rows, by, all_token) if all_token is not None else rows).where(F.col(by).isNotNull())
    if approximate:
        return rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.avg(total).alias("mean"),
            F.percentile_approx(total, 0.5).alias("median")).select(by, "n", "mean", "median")
    means = rows.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.avg(total).alias("mean"))
    middle = exact_quantiles(weighted_values(rows, keys, total), keys, [0.5])
    return middle.join(means, [F.col(k) == F.col(f"_of_{k}") for k in keys]).select(
        by, "n", "mean", F.col("quantiles")[0].alias("median"))


def mean_by(df: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Mean of several columns per group, nulls ignored, in one aggregate."""
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in names])


def mean_positive_by(df: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Mean over positive amounts only."""
    return df.groupBy(by).agg(*[F.avg(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in names])


def histogram(df: DataFrame, by: list[str], col: str, bins: int = 20, lo: float | None = None,
              hi: float | None = None, density: bool = False, weight: str | None = None) -> DataFrame:
    """Equal-width histogram per group over a range that all groups share.

    Bins are closed on the right and centred on multiples of the width, so the first and the last
    bin reach half a width beyond the data. With ``lo`` and ``hi`` values outside are left out.
    ``weight`` counts values that are already counted. Returns every bin, also empty ones.
    """
    x = F.col(col).cast("double")
    values = df.where(x.isNotNull()).select(*by, x.alias("_x"), *([F.col(weight).alias("_w")] if weight else []))
    if lo is not None:
        values = values.where(F.col("_x") >= lo)
    if hi is not None:
        values = values.where(F.col("_x") <= hi)
    layout = (
        values.agg((F.lit(float(lo)) if lo is not None else F.min("_x")).alias("lo"),
                   (F.lit(float(hi)) if hi is not None else F.max("_x")).alias("hi"))
        .withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / (bins - 1)).otherwise(0.1))
        .select(F.struct("width", (
            F.col("width") / 2 + F.floor((F.col("lo") - F.col("width") / 2) / F.col("width")) * F.col("width")
        ).alias("origin"))).scalar()
    )
    width, origin = layout["width"], layout["origin"]

    # Whole weights stay whole; fractional ones are summed as they are.
    kind = "double" if weight and not isinstance(df.schema[weight].dataType, T.IntegralType) else "bigint"
    amount = F.sum(F.col("_w").cast(kind)) if weight else F.count(F.lit(1))
    placed = F.greatest(F.ceil((F.col("_x") - origin) / width - 1e-8) - 1, F.lit(0)).cast("int")
    counts = values.groupBy(*by, placed.alias("_bin")).agg(amount.alias("_n"))
    frame = (
        counts.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.sum("_n").alias("_total"))
        .withColumns({"_width": width, "_origin": origin})
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    )
    width, origin = F.col("_width"), F.col("_origin")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] + [F.col("bin") == F.col("_bin")]
    n = F.coalesce(F.col("_n"), F.lit(0).cast(kind))
    out = [*[F.col(f"_{k}").alias(k) for k in by], F.col("bin"),
           (origin + F.col("bin") * width).alias("xmin"), (origin + (F.col("bin") + 1) * width).alias("xmax"),
           n.alias("n")]
    if density:
        out.append((n / (F.col("_total") * width)).alias("density"))
    return frame.join(counts, same, "left").select(*out)


#: Cells to a bandwidth, and the bandwidths beyond which the kernel is zero in double precision.
FINE, REACH = 64, 39


def _bandwidth(sd: Column, iqr: Column, n: Column) -> Column:
    """Rule-of-thumb bandwidth of a Gaussian kernel: 0.9 · min(sd, iqr / 1.34) · n^(-1/5)."""
    spread = F.least(sd, iqr / 1.34)
    spread = F.when(spread > 0, spread).when(sd > 0, sd).otherwise(F.lit(1.0))
    return F.lit(0.9) * spread * F.pow(n.cast("double"), F.lit(-0.2))


def _bandwidths(values: DataFrame, by: list[str], bandwidth: float | None) -> DataFrame:
    """Keys of the groups, each with an underscore before its name, with ``n`` and ``bw``."""
    names = [f"_{k}" for k in by]
    stats = values.groupBy(*[F.col(k).alias(a) for k, a in zip(by, names, strict=True)]).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("_sd"))
    if bandwidth is None:
        spread = exact_quantiles(weighted_values(values, by, "_x"), by, [0.25, 0.75]).select(
            *[F.col(k).alias(f"_{a}") for k, a in zip(by, names, strict=True)],
            (F.col("quantiles")[1] - F.col("quantiles")[0]).alias("_iqr"))
        same = [F.col(a).eqNullSafe(F.col(f"_{a}")) for a in names]
        stats = stats.join(spread, same)
        width = _bandwidth(F.col("_sd"), F.col("_iqr"), F.col("n"))
    else:
        width = F.lit(float(bandwidth))
    return stats.select(*names, "n", width.alias("bw"))


def _density_by_bandwidth(values: DataFrame, by: list[str], layout: Column, points: int, bandwidth: float | None) -> DataFrame:
    """Density on cells of each group's own width."""
    names = [f"_{k}" for k in by]
    # Written down: one row per group, which is joined twice.
    stats = materialize(_bandwidths(values, by, bandwidth).withColumns({"_low": layout["lo"], "_pace": layout["pace"]}), "bandwidths")
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(by, names, strict=True)]
    place = (F.col("_x") - F.col("_low")) / (F.col("bw") / FINE)
    placed = values.join(stats, same).withColumn("_place", place).withColumn("_cell", F.floor("_place"))
    cell = placed.groupBy(*names, "bw", "_low", "_pace", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_place") - F.col("_cell")).alias("_up"))
    first = lambda side: F.when(F.col("_pace") > 0, side / F.col("_pace")).otherwise(0.0)
    left = F.greatest(F.ceil(first(F.col("_cell") * F.col("bw") / FINE - REACH * F.col("bw"))), F.lit(0)).cast("int")
    right = F.least(F.floor(first((F.col("_cell") + 1) * F.col("bw") / FINE + REACH * F.col("bw"))), F.lit(points - 1)).cast("int")
    right = F.when(F.col("_pace") > 0, right).otherwise(points - 1)
    met = cell.withColumns({"_from": left, "_to": right}).where("_from <= _to").withColumn("_point", F.explode(F.sequence("_from", "_to")))
    kernel = lambda c: F.exp(-0.5 * F.pow((F.col("_point") * F.col("_pace") - c * F.col("bw") / FINE) / F.col("bw"), F.lit(2.0)))
    weight = (F.col("_n") - F.col("_up")) * kernel(F.col("_cell")) + F.col("_up") * kernel(F.col("_cell") + 1)
    sums = met.groupBy(*[F.col(a).alias(f"_{a}") for a in names], "_point").agg(F.sum(weight).alias("_sum"))
    frame = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    again = [F.col(a).eqNullSafe(F.col(f"_{a}")) for a in names] + [F.col("point") == F.col("_point")]
    root = (2 * 3.141592653589793) ** 0.5
    return frame.join(sums, again, "left").select(
        *[F.col(a).alias(k) for k, a in zip(by, names, strict=True)], "point", (F.col("_low") + F.col("point") * F.col("_pace")).alias("x"),
        (F.coalesce("_sum", F.lit(0.0)) / (F.col("n") * F.col("bw") * root)).alias("density"))


def density(df: DataFrame, by: list[str], col: str, points: int = 512, cells: int | None = None,
            bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density per group on equally spaced points over the range of all groups.

    Each value is shared between its two neighbours on a fine grid of cells, ``FINE`` to a bandwidth of its
    group, and the kernel is summed over the occupied cells, in rows: a sum leaves out no point at which
    the kernel is not zero in double precision. With ``cells`` given, all groups share so many cells over the
    joint range instead, which are too wide for a group whose bandwidth they exceed. Keys and values are
    written down, so that the source is read once.
    """
    if not by:
        return density(df.withColumn("_all", F.lit(0)), ["_all"], col, points, cells, bandwidth).drop("_all")
    x = F.col(col).cast("double")
    values = materialize(df.where(x.isNotNull()).select(*by, x.alias("_x")), "values")
    span = F.col("hi") - F.col("lo")
    layout = values.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).select(F.struct(
        "lo", F.when(span > 0, span / (cells or 1)).otherwise(1.0).alias("step"), (span / (points - 1)).alias("pace"))).scalar()
    low, step = layout["lo"], layout["step"]
    if cells is None:
        return _density_by_bandwidth(values, by, layout, points, bandwidth)

    place = (F.col("_x") - low) / step
    cell = F.least(F.floor(place), F.lit(cells - 1)).cast("int")
    placed = values.select(*by, cell.alias("_cell"), (place - cell).alias("_part"))
    weights = placed.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum("_part").alias("_up"))
    packed = weights.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("_cell", "_n", "_up"))).alias("_cells"))

    names = [f"_{k}" for k in by]
    stats = _bandwidths(values, by, bandwidth).withColumns({"_low": low, "_step": step, "_pace": layout["pace"]})

    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(by, names, strict=True)]
    at = F.col("_low") + F.col("point") * F.col("_pace")
    centre = lambda c: F.col("_low") + c * F.col("_step")
    kernel = lambda c: F.exp(F.lit(-0.5) * F.pow((F.col("x") - c) / F.col("bw"), F.lit(2.0)))
    total = F.aggregate("_cells", F.lit(0.0), lambda acc, w: acc
                        + (w["_n"] - w["_up"]) * kernel(centre(w["_cell"]))
                        + w["_up"] * kernel(centre(w["_cell"] + 1)))
    root = (2 * 3.141592653589793) ** 0.5
    return (
        packed.join(stats, same)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", at)
        .select(*by, "point", "x", (total / (F.col("n") * F.col("bw") * root)).alias("density"))
    )


def economic_table(df: DataFrame, country: str, expense: str, visits: str, yearly: str) -> DataFrame:
    """Each row with its country total of the yearly expenditure and the gap expense × visits − yearly."""
    totals = df.groupBy(F.col(country).alias("_country")).agg(F.sum(yearly).alias("country_total"))
    return (
        df.join(totals, F.col(country) == F.col("_country"), "left").drop("_country")
        .withColumn("gap", F.col(expense) * F.col(visits) - F.col(yearly))
    )
