"""Ordinal answers: cell counts, cumulative logits, draws, curves, and regression on cells.

Respondents are read once, into counts per combination of covariate levels and answer. Everything
after that works on those cells, whose number depends on the questionnaire and not on the respondents.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.scalars import classify, logistic_density, logit
from canvass.operators.codebook import small_rows
from canvass.operators.reshape import expand_seq, to_long, to_wide
from canvass.operators.tabulate import cumulative_share
from canvass.functions.quantiles import exact_quantiles, weighted_values
from canvass.session import materialize

# Prior means of the four thresholds of a five-point answer (equal probabilities).
THRESHOLD_PRIOR = (-1.39, -0.41, 0.41, 1.39)


def ordinal_cells(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Counts per covariate combination and answer; incomplete rows drop out."""
    return df.na.drop("any", subset=[y, *xs]).groupBy(*xs, y).agg(F.count(F.lit(1)).alias("n"))


def cumulative_logits(df: DataFrame, y: str, by: list[str]) -> DataFrame:
    """Cumulative share of each answer and its log odds, per group; null at the last answer."""
    shares = cumulative_share(ordinal_cells(df, y, by), by, [y])
    return shares.withColumn("logit", logit(F.col("cum_share")))


def summarise_draws(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and the 2.5, 25, 75 and 97.5 percent points of the draws per group."""
    draws = materialize(draws.select(*keys, value), "draws")
    points = exact_quantiles(weighted_values(draws, keys, value), keys, [0.025, 0.25, 0.75, 0.975])
    means = draws.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.avg(value).alias("est"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    q = F.col("quantiles")
    return points.join(means, same).select(
        *keys, "est", q[0].alias("lwr95"), q[1].alias("lwr50"), q[2].alias("upr50"), q[3].alias("upr95"))


def mean_category(draws: DataFrame, keys: list[str], category: str, p: str) -> DataFrame:
    """Expected category per draw: sum of category number × probability."""
    return draws.groupBy(*keys).agg(F.sum(F.col(category).cast("double") * F.col(p)).alias("mean_cat"))


def reshape_draws(wide: DataFrame, names: list[str], kinds: Mapping[str, str], group_pattern: str) -> DataFrame:
    """Wide draw columns → mean per group and kind of effect, one column per kind.

    ``kinds`` maps a kind to the pattern of its column names; the first match counts.
    """
    # Averages per column first: the long form then has one row per column instead of per draw.
    means = wide.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in names])
    long = to_long(means, [], names, "term", "value")
    tagged = long.withColumns({"kind": classify("term", dict(kinds)), "grp": F.regexp_extract("term", group_pattern, 1)})
    return to_wide(tagged, ["grp"], "kind", "value", list(kinds), F.avg)


def logistic_curve(params: DataFrame, mu: str, disc: str, lo: float, hi: float, n: int = 500) -> DataFrame:
    """Logistic density on n points per group, with scale 1 / exp(disc)."""
    scaled = params.withColumn("sigma", F.lit(1.0) / F.exp(F.col(disc)))
    return expand_seq(scaled, lo, hi, n, "x").withColumn(
        "d", logistic_density(F.col("x"), F.col(mu), F.col("sigma")))


def predictive_check(observed: DataFrame, draws: DataFrame, by: list[str], category: str, p: str = "p") -> DataFrame:
    """Observed counts next to the counts expected from the mean predicted probabilities."""
    counted = observed.na.drop("any", subset=[*by, category])
    cells = counted.groupBy(*by, category).agg(F.count(F.lit(1)).alias("observed"))
    sizes = cells.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.sum("observed").alias("_size"))
    predicted = draws.groupBy(*by, category).agg(F.avg(p).alias("_p"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
    if by:
        expected = predicted.join(sizes, same)
    else:
        expected = predicted.withColumn("_size", cells.agg(F.sum("observed")).scalar())
    expected = expected.select(*by, category, (F.col("_p") * F.col("_size")).alias("predicted"))
    return expected.join(cells, [*by, category], "full_outer").withColumn(
        "observed", F.coalesce(F.col("observed"), F.lit(0).cast("bigint")))


def compare_scores(pointwise: DataFrame, models: list[str], weight: str | None = None) -> DataFrame:
    """Models ranked by summed out-of-sample log score, with the difference to the best and its error.

    ``pointwise`` has one score column per model. One aggregate holds the sums of all pairwise
    differences; the ranking needs only those.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    aggs = [F.sum(w).alias("_n")]
    for a in models:
        aggs.append(F.sum(w * F.col(a)).alias(f"_s_{a}"))
        for b in models:
            d = F.col(a) - F.col(b)
            aggs += [F.sum(w * d).alias(f"_d_{a}_{b}"), F.sum(w * d * d).alias(f"_q_{a}_{b}")]
    sums = pointwise.agg(*aggs)
    best = F.greatest(*[F.col(f"_s_{m}") for m in models]) if len(models) > 1 else F.col(f"_s_{models[0]}")
    n = F.col("_n")

    def against_best(a: str, kind: str) -> Column:
        chain = None
        for b in models:
            hit = F.col(f"_s_{b}") == best
            chain = F.when(hit, F.col(f"_{kind}_{a}_{b}")) if chain is None else chain.when(hit, F.col(f"_{kind}_{a}_{b}"))
        return chain

    rows = []
    for a in models:
        d, q = against_best(a, "d"), against_best(a, "q")
        spread = F.sqrt(F.greatest(n * (q - d * d / n) / (n - 1), F.lit(0.0)))
        rows.append(F.struct(
            F.lit(a).alias("model"), F.col(f"_s_{a}").alias("elpd"), d.alias("elpd_diff"), spread.alias("se_diff")))
    return sums.select(F.inline(F.array(*rows)))


# -- regression -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Term:
    """A coefficient: its name, the column it multiplies, and its Gaussian prior."""

    name: str
    column: Column
    mean: float
    sd: float


def stack_cumulative(cells: DataFrame, y: str, levels: int) -> DataFrame:
    """Cells → one row per covariate combination and cut j: ``k`` of ``w`` answers are at or below j."""
    xs = [c for c in cells.columns if c not in (y, "n")]
    cut = cells.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(levels - 1))))
    return cut.groupBy(*xs, "cut").agg(
        F.sum("n").alias("w"),
        F.sum(F.when(F.col(y) <= F.col("cut"), F.col("n")).otherwise(F.lit(0))).alias("k"))


def stack_adjacent(cells: DataFrame, y: str, levels: int) -> DataFrame:
    """Cells → one row per covariate combination and cut j: of ``w`` answers j or j + 1, ``k`` are j."""
    xs = [c for c in cells.columns if c not in (y, "n")]
    cut = cells.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(levels - 1))))
    near = cut.where((F.col(y) == F.col("cut")) | (F.col(y) == F.col("cut") + 1))
    return near.groupBy(*xs, "cut").agg(
        F.sum("n").alias("w"),
        F.sum(F.when(F.col(y) == F.col("cut"), F.col("n")).otherwise(F.lit(0))).alias("k"))


def fit_terms(rows: DataFrame, terms: list[Term], refits: int = 3) -> dict[str, float]:
    """Binomial regression of ``k`` of ``w`` on the terms, at the maximum of the posterior.

    Prior means go into the offset and prior standard deviations into the scale of the features, so
    every penalty is that of a unit Gaussian. Spark's penalty is relative to the sum of the working
    weights w · p · (1 − p), which is known only after a fit; hence the refits.
    """
    offset = reduce(lambda a, b: a + b, [F.lit(t.mean) * t.column for t in terms])
    data = materialize(rows.where(F.col("w") > 0).select(
        (F.col("k") / F.col("w")).alias("label"), F.col("w").cast("double").alias("weight"),
        offset.alias("offset"), F.array(*[F.lit(t.sd) * t.column for t in terms]).alias("x")), "cells")
    # Every iteration is a pass over the cells: keep them in memory, backed by the written table.
    data = data.withColumn("features", array_to_vector("x")).cache()
    strength = 4.0 / data.agg(F.sum("weight")).first()[0]
    for step in range(refits):
        model = GeneralizedLinearRegression(
            family="binomial", link="logit", weightCol="weight", offsetCol="offset", fitIntercept=False,
            regParam=strength, tol=1e-9 if step == refits - 1 else 1e-5, maxIter=50).fit(data)
        p = F.col("prediction")
        strength = 1.0 / model.transform(data).agg(F.sum(F.col("weight") * p * (1 - p))).first()[0]
    data.unpersist()
    return {t.name: t.mean + t.sd * float(c) for t, c in zip(terms, model.coefficients, strict=True)}


def covariate_levels(cells: DataFrame, xs: list[str], limit: int = 1000) -> dict[str, list[str]]:
    """Levels of each covariate in label order; the first is the reference."""
    text = cells.select(*[F.col(x).cast("string").alias(x) for x in xs])
    packed = text.unpivot([], xs, "x", "level").distinct()
    found: dict[str, list[str]] = {x: [] for x in xs}
    for r in small_rows(packed, limit):
        found[r["x"]].append(r["level"])
    return {x: sorted(v) for x, v in found.items()}


def ordinal_terms(
    levels: Mapping[str, list[str]], cuts: int, prior_means: tuple[float, ...] = THRESHOLD_PRIOR,
    threshold_sd: float = 1.0, slope_sd: float = 2.0, specific: bool | Iterable[str] = False,
    group: str | None = None, group_levels: list[str] = (), group_sd: float = 1.0, thresholds: str = "common",
) -> list[Term]:
    """Terms of logit P(answer ≤ j) = threshold_j − slopes.

    ``specific`` gives each cut its own slopes, of all covariates or of those it lists. ``group`` adds a shrunken intercept per group, and
    ``thresholds="by_group"`` separate thresholds per group.
    """
    one = lambda condition: condition.cast("double")
    terms = []
    for j in range(1, cuts + 1):
        at = F.col("cut") == j
        if thresholds == "by_group":
            terms += [Term(f"cut{j}:{g}", one(at & (F.col(group) == g)), prior_means[j - 1], threshold_sd)
                      for g in group_levels]
        else:
            terms.append(Term(f"cut{j}", one(at), prior_means[j - 1], threshold_sd))
    for x, names in levels.items():
        for v in names[1:]:
            hit = F.col(x).cast("string") == v
            if specific is True or (specific and x in specific):
                terms += [Term(f"{x}={v}@{j}", -one(hit & (F.col("cut") == j)), 0.0, slope_sd)
                          for j in range(1, cuts + 1)]
            else:
                terms.append(Term(f"{x}={v}", -one(hit), 0.0, slope_sd))
    if group is not None and thresholds == "common":
        terms += [Term(f"{group}={g}", -one(F.col(group) == g), 0.0, group_sd) for g in group_levels]
    return terms


def fit_ordinal(
    df: DataFrame, y: str, xs: list[str], levels: int = 5, prior_means: tuple[float, ...] = THRESHOLD_PRIOR,
    threshold_sd: float = 1.0, prior_sd: float = 2.0, group: str | None = None, group_sd: float = 1.0,
    thresholds: str = "common",
) -> DataFrame:
    """Proportional-odds regression of an ordinal answer on categorical covariates: (term, estimate).

    The stacked rows form a composite likelihood: estimates are consistent, and no standard errors
    are reported.
    """
    keys = [*xs, group] if group else list(xs)
    cells = materialize(ordinal_cells(df, y, keys), "cells")
    found = covariate_levels(cells, keys)
    group_levels = found.pop(group) if group else []
    terms = ordinal_terms(found, levels - 1, prior_means, threshold_sd, prior_sd, group=group,
                          group_levels=group_levels, group_sd=group_sd, thresholds=thresholds)
    estimates = fit_terms(stack_cumulative(cells, y, levels), terms)
    return df.sparkSession.createDataFrame(list(estimates.items()), "term string, estimate double")


def category_scores(cells: DataFrame, y: str, levels: int, terms: list[Term], estimates: Mapping[str, float],
                    form: str, name: str) -> DataFrame:
    """Add the log probability of each cell's answer under a fitted model."""
    predictors = reduce(lambda a, b: a + b, [F.lit(estimates[t.name]) * t.column for t in terms])
    keys = cells.columns
    cut = cells.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(levels - 1))))
    eta = cut.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("cut", predictors.alias("eta")))), lambda s: s["eta"])
        .alias("_eta"))
    e = [F.col("_eta")[j] for j in range(levels - 1)]
    if form == "cumulative":
        inverse = [F.lit(1.0) / (F.lit(1.0) + F.exp(-v)) for v in e]
        edges = [F.lit(0.0), *inverse, F.lit(1.0)]
        probabilities = [edges[i + 1] - edges[i] for i in range(levels)]
    else:
        # log P(j + 1) − log P(j) = −eta_j
        steps = [F.lit(0.0)]
        for v in e:
            steps.append(steps[-1] - v)
        total = reduce(lambda a, b: a + b, [F.exp(s) for s in steps])
        probabilities = [F.exp(s) / total for s in steps]
    p = F.array(*probabilities)[F.col(y).cast("int") - 1]
    return eta.withColumn(name, F.log(F.greatest(p, F.lit(1e-300)))).drop("_eta")


def check_proportional_odds(
    df: DataFrame, y: str, xs: list[str], key: str, levels: int = 5, folds: int = 3,
    prior_means: tuple[float, ...] = THRESHOLD_PRIOR, prior_sd: float = 2.0, chosen: Iterable[Iterable[str]] = (),
) -> DataFrame:
    """Compare common with cut-specific slopes by out-of-sample log score.

    Models: cumulative with common slopes, adjacent-category with common slopes, adjacent-category
    with cut-specific slopes; and for every list in ``chosen`` one whose slopes are cut-specific for the
    covariates listed only. All models are fitted on the same counted cells. Folds are cut from the respondent number; respondents are read once.
    """
    with_fold = df.withColumn("fold", F.pmod(F.col(key), F.lit(folds)))
    cells = materialize(ordinal_cells(with_fold, y, ["fold", *xs]), "cells")
    found = covariate_levels(cells, xs)
    common = ordinal_terms(found, levels - 1, prior_means, slope_sd=prior_sd)
    specific = ordinal_terms(found, levels - 1, prior_means, slope_sd=prior_sd, specific=True)
    models = {
        "cumulative": (stack_cumulative, common, "cumulative"),
        "adjacent": (stack_adjacent, common, "adjacent"),
        "adjacent_specific": (stack_adjacent, specific, "adjacent"),
    }
    for names in map(list, chosen):
        some = ordinal_terms(found, levels - 1, prior_means, slope_sd=prior_sd, specific=names)
        models["adjacent_" + "_".join(names)] = (stack_adjacent, some, "adjacent")
    scored = []
    for fold in range(folds):
        train = cells.where(F.col("fold") != fold).groupBy(*xs, y).agg(F.sum("n").alias("n"))
        test = cells.where(F.col("fold") == fold)
        for name, (stack, terms, form) in models.items():
            estimates = fit_terms(stack(train, y, levels), terms, refits=2)
            test = category_scores(test, y, levels, terms, estimates, form, name)
        scored.append(test)
    return compare_scores(reduce(lambda a, b: a.unionByName(b), scored), list(models), "n")
