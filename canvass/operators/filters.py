"""Row filters with the null rules of survey work."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.ranking import number_rows
from canvass.functions.scalars import any_answered
from canvass.session import materialize


def keep_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Keep the listed values; null is dropped."""
    return df.where(F.col(col).isin(list(values)))


def drop_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Drop the listed values; null is kept."""
    return df.where(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def drop_matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Drop texts that match the pattern; null is kept."""
    return df.where(~F.coalesce(F.col(col).rlike(pattern), F.lit(False)))


def drop_test_answers(
    df: DataFrame, status_col: str, status: str, name_col: str, pattern: str, deny: Iterable[str]
) -> DataFrame:
    """Keep rows with the live status whose name neither looks like a test nor is on the deny list."""
    live = df.where(F.col(status_col) == status)
    return drop_in(drop_matching(live, name_col, pattern), name_col, deny)


def answered_text(df: DataFrame, col: str) -> DataFrame:
    """Keep filled open answers; blank and null are dropped."""
    return df.where(F.col(col) != "")


def blank_as_missing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Blank open answers become null, so that counts and rates take them as not answered."""
    return df.withColumns({n: F.nullif(F.col(n), F.lit("")) for n in names})


def complete_cases(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop rows that are null in any of the columns."""
    return df.na.drop("any", subset=names)


def answered_any(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop rows that are null in all of the columns."""
    return df.where(any_answered(names))


@dataclass(frozen=True)
class SurveyParams:
    """Respondent filter of one report: groups (cities, countries) × genders.

    ``total`` among the genders stands for ``all_genders``. Either way a null gender drops out.
    """

    groups: tuple[str, ...]
    genders: tuple[str, ...] = ("total",)
    all_genders: tuple[str, ...] = ()
    group_col: str = "city"
    gender_col: str = "gender"
    total_token: str = "total"
    ignore: tuple[str, ...] = field(default=())

    def gender_list(self) -> list[str]:
        return list(self.all_genders if self.total_token in self.genders else self.genders)

    def condition(self) -> Column:
        keep = F.lit(True)
        if "group" not in self.ignore:
            keep = keep & F.col(self.group_col).isin(list(self.groups))
        if "gender" not in self.ignore:
            keep = keep & F.col(self.gender_col).isin(self.gender_list())
        return keep


def apply_params(df: DataFrame, params: SurveyParams) -> DataFrame:
    return df.where(params.condition())


def filter_or_all(df: DataFrame, col: str, chosen: Iterable[str], all_token: str) -> DataFrame:
    """The whole table if the token is among the choices, else the chosen rows."""
    chosen = list(chosen)
    return df if all_token in chosen else keep_in(df, col, chosen)


def split_tag(df: DataFrame, col: str, tags: Mapping, name: str = "source", keep_others: bool = False) -> DataFrame:
    """Tag rows of a combined file by the value that tells its parts apart."""
    chain = None
    for value, tag in tags.items():
        chain = F.when(F.col(col) == value, tag) if chain is None else chain.when(F.col(col) == value, tag)
    tagged = df.withColumn(name, chain)
    return tagged if keep_others else tagged.where(F.col(name).isNotNull())


def band_join(df: DataFrame, col: str, bands: DataFrame, lo: str, hi: str, width: float | None = None,
              sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Attach every band whose [lo, hi] holds the value, or nulls if none does; null ends are open.

    A sweep over the sorted values and ends gives each its place on one line; values count once, however
    often they occur. A band is cut into the few aligned runs of places (of 1, 2, 4, ... of them) that it
    consists of, and a value looks for its run of each length that occurs. So the range condition is an
    equality, no band is repeated for what lies within it, and neither bands nor ends are gathered:
    any number of overlapping bands of any width may be given. ``width`` is not needed any more.

    With ``sums``, columns over the bands by name, a value gets their sums over all bands that hold it, and
    each row comes once. Equal bands are added up before they are cut and the bands of a run before values
    look for it, so no row is made per value and band.
    """
    added = [F.sum(n).alias(n) for n in sums or {}]
    sound = bands.where(F.coalesce(F.col(lo) <= F.col(hi), F.lit(True)))
    if sums:
        sound = materialize(sound.groupBy(lo, hi).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "bands")
    # A lower end comes before equal values, an upper one behind them.
    line = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_x"), F.lit(1).alias("_side")).distinct().unionAll(
        sound.where(F.col(lo).isNotNull()).select(F.col(lo).alias("_x"), F.lit(0).alias("_side")).distinct()).unionAll(
        sound.where(F.col(hi).isNotNull()).select(F.col(hi).alias("_x"), F.lit(2).alias("_side")).distinct())
    places = materialize(number_rows(line, [], ["_x", "_side"], "_place"), "places")
    end = lambda side, name: places.where(F.col("_side") == side).select(F.col("_x").alias(f"_{name}"), F.col("_place").alias(name))
    last = places.agg(F.coalesce(F.max("_place"), F.lit(0)).alias("last")).first()[0]
    cut = sound.join(end(0, "_from"), F.col(lo) == F.col("__from"), "left").join(end(2, "_to"), F.col(hi) == F.col("__to"), "left")
    cut = cut.withColumns({"_from": F.coalesce("_from", F.lit(0)).cast("long"), "_to": F.coalesce("_to", F.lit(last + 1)).cast("long")})
    # Between the ends, a length adds the run behind the lower end's if that is the first of a pair, and the one before the
    # upper end's if that is the second, up to the length at which both ends are one pair: below the first bit they differ in.
    apart = F.col("_from").bitwiseXOR(F.col("_to"))
    own = [*sums] if sums else bands.columns
    cut = cut.where(apart > 1).select(*own, "_from", "_to", F.explode(F.sequence(F.lit(0), F.length(F.bin(apart)) - 2)).alias("_length"))
    lower, upper = F.expr("shiftright(_from, _length)"), F.expr("shiftright(_to, _length)")
    runs = F.array(F.when(lower % 2 == 0, lower + 1), F.when(upper % 2 == 1, upper - 1))
    keyed = cut.select(*own, "_length", F.explode(runs).alias("_run")).where("_run IS NOT NULL")
    keyed = materialize(keyed.groupBy("_length", "_run").agg(*added) if sums else keyed, "runs")
    # At most as many lengths as a place has bits.
    lengths = sorted(r[0] for r in keyed.select("_length").distinct().collect())
    none = F.array().cast("array<struct<_length:int,_run:bigint>>")
    at = F.array(*[F.struct(F.lit(k).alias("_length"), F.shiftright("_place", k).alias("_run")) for k in lengths]) if lengths else none
    matched = places.where("_side = 1").select("_x", F.inline(at)).join(keyed, ["_length", "_run"]).drop("_length", "_run")
    matched = (matched.groupBy("_x").agg(*added) if sums else matched).withColumn("_spread", F.lit(0))
    # Unknown values have no partner and are spread by their rows.
    spread = F.when(F.col(col).isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).otherwise(F.lit(0))
    values = df.withColumn("_spread", spread)
    return values.join(materialize(matched, "matched").withColumnRenamed("_spread", "_none"), (F.col(col) == F.col("_x")) & (F.col("_spread") == F.col("_none")), "left").drop("_x", "_spread", "_none")
