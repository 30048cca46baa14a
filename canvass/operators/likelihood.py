"""Cumulative-logit regression by its full likelihood, with posterior draws and estimated group spread.

P(answer <= j) = F(threshold_j - slopes - group effect), F logistic. The posterior's mode is found by
Newton steps: gradient and Hessian are summed from the cells of the answers in one aggregation. Every
cell touches few terms, so only their pairs are summed, combined where the cells lie; what reaches the
driver are the sums of the common terms, whose number follows the questionnaire.

Terms of a group (an effect, or thresholds of its own) meet only the common terms and each other in
the Hessian. They are eliminated group by group where the groups lie, so there may be any number of
them: the driver gets sums of packed lower triangles, and the groups' terms are a written table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.operators.ordinal import THRESHOLD_PRIOR
from canvass.session import materialize

#: Marks in place of a second term: the entry belongs to the gradient, or is the log likelihood.
GRADIENT, VALUE = -(1 << 20), -(1 << 21)
LEAST = 1e-300


@dataclass
class Fit:
    """A fitted model. ``names``, ``mode`` and ``precision`` describe the common terms, with the groups' terms integrated
    out; ``effects`` has group, mean and sd of the terms of each group; ``group_sd`` is the spread given or estimated."""

    spark: SparkSession
    names: list[str]
    mode: np.ndarray
    precision: np.ndarray
    levels: int
    xs: list[str]
    index: DataFrame
    group: str | None = None
    effects: DataFrame | None = None
    group_sd: float | None = None
    own_thresholds: bool = False
    history: list[tuple[float, float]] = field(default_factory=list)

    def covariance(self) -> np.ndarray:
        return np.linalg.inv(self.precision)

    def estimates(self) -> DataFrame:
        """term, estimate and se of the common terms, then those of the groups: "city=A", or "cut1:A" for thresholds of their own."""
        se = np.sqrt(np.diag(self.covariance()))
        common = self.spark.createDataFrame([(n, float(m), float(s)) for n, m, s in zip(self.names, self.mode, se, strict=True)], "term string, estimate double, se double")
        if self.effects is None:
            return common
        at = self.effects.select("group", F.posexplode(F.arrays_zip("mean", "sd")).alias("k", "v"))
        name = F.concat(F.lit("cut"), F.col("k") + 1, F.lit(":"), "group") if self.own_thresholds else F.concat(F.lit(f"{self.group}="), "group")
        return common.unionByName(at.select(name.alias("term"), F.col("v.mean").alias("estimate"), F.col("v.sd").alias("se")))


def index_levels(cells: DataFrame, columns: dict[str, str], first: int) -> DataFrame:
    """x, level, number of every level but the first of each covariate, in the order of the covariates and labels; ``columns`` has theirs."""
    rows, seen, order = [], set(), list(columns)
    if columns:
        pairs = cells.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.col(c).cast("string").alias("level")) for x, c in columns.items()])).alias("t")).select("t.*").distinct()
        for x, level in sorted(map(tuple, pairs.collect()), key=lambda t: (order.index(t[0]), t[1])):
            if x in seen:
                rows.append((x, level, first + len(rows)))
            seen.add(x)
    return cells.sparkSession.createDataFrame(rows, "x string, level string, number int")


def with_terms(cells: DataFrame, xs: dict[str, str], index: DataFrame, keep: list[str]) -> DataFrame:
    """The cells with the numbers of their terms as ``idx``; one join, however many covariates there are. ``xs`` has their columns."""
    if not xs:
        return cells.select(*keep, F.array().cast("array<int>").alias("idx"))
    told = cells.withColumn("_cell", F.monotonically_increasing_id())
    told = materialize(told, "cells")
    long = told.select("_cell", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.col(c).cast("string").alias("level")) for x, c in xs.items()])).alias("t")).select("_cell", "t.*")
    numbers = long.join(index, ["x", "level"]).groupBy("_cell").agg(F.sort_array(F.collect_list("number")).alias("idx"))
    return told.join(numbers, "_cell", "left").select(*keep, F.coalesce("idx", F.array().cast("array<int>")).alias("idx"))


def logistic(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def with_ends(cells: DataFrame, mode: np.ndarray, levels: int, own: str | None = None) -> DataFrame:
    """The cells with the upper and lower end of their answer, ``u`` and ``l``, the probability between, ``p``, and its derivatives.

    ``gu`` and ``gl`` are the first derivatives of log p in the ends, ``uu``, ``ll`` and ``ul`` minus the second.
    Both ends are multiplied by the cell's scale ``s``, if it has one. Outermost ends are 0, with derivatives of 0.
    """
    b = F.array(*[F.lit(float(x)) for x in mode]) if len(mode) else F.array().cast("array<double>")
    y, scale = F.col("y"), F.col("s") if "s" in cells.columns else F.lit(1.0)
    cut = (lambda j: F.get("e", j - 1)) if own == "thresholds" else (lambda j: F.get(b, j - 1))
    eta = F.aggregate("idx", F.lit(0.0), lambda s, i: s + F.get(b, i))
    if own == "effect":
        eta = eta + F.get("e", F.lit(0))
    sides = cells.withColumn("eta", eta).withColumns({
        "u": F.when(y < levels, scale * (cut(y) - F.col("eta"))).otherwise(0.0), "l": F.when(y > 1, scale * (cut(y - 1) - F.col("eta"))).otherwise(0.0)})
    sides = sides.withColumns({"fu": F.when(y < levels, logistic(F.col("u"))).otherwise(1.0), "fl": F.when(y > 1, logistic(F.col("l"))).otherwise(0.0)})
    du, dl = (F.col(c) * (1 - F.col(c)) for c in ("fu", "fl"))
    p = F.greatest(F.col("fu") - F.col("fl"), F.lit(LEAST))
    sides = sides.withColumns({"p": p, "gu": du / p, "gl": -dl / p})
    return sides.withColumns({
        "uu": F.col("gu") * (F.col("gu") - (1 - 2 * F.col("fu"))), "ll": F.col("gl") * (F.col("gl") - (1 - 2 * F.col("fl"))), "ul": F.col("gu") * F.col("gl")})


def pair_sums(cells: DataFrame, mode: np.ndarray, levels: int, own: str | None) -> DataFrame:
    """Sums of gradient and negative Hessian over the cells: (g,) i, j, v; ``own`` is None, "effect" or "thresholds".

    Terms of a group have negative numbers, -1 first; ``e`` of a cell has their values.
    """
    y, n, scale = F.col("y"), F.col("n"), F.col("s") if "s" in cells.columns else F.lit(1.0)
    number = (lambda j: -j) if own == "thresholds" else (lambda j: j - 1)
    sides = with_ends(cells, mode, levels, own)
    term = lambda i, u, l: F.struct(i.cast("int").alias("i"), (scale * u).alias("u"), (scale * l).alias("l"))  # noqa: E731,E741
    nothing = F.array().cast("array<struct<i:int,u:double,l:double>>")
    active = [F.when(y < levels, F.array(term(number(y), 1.0, 0.0))).otherwise(nothing), F.when(y > 1, F.array(term(number(y - 1), 0.0, 1.0))).otherwise(nothing),
              F.transform("idx", lambda i: term(i, -1.0, -1.0))]
    if own == "effect":
        active.append(F.array(term(F.lit(-1), -1.0, -1.0)))
    told = sides.withColumn("a", F.concat(*active))
    entry = lambda i, j, v: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), (n * v).alias("v"))
    second = lambda a, c: F.col("uu") * a["u"] * c["u"] + F.col("ll") * a["l"] * c["l"] + F.col("ul") * (a["u"] * c["l"] + a["l"] * c["u"])
    pairs = F.flatten(F.transform("a", lambda a: F.transform(F.filter("a", lambda c: c["i"] <= a["i"]), lambda c: entry(a["i"], c["i"], second(a, c)))))
    slope = F.transform("a", lambda a: entry(a["i"], F.lit(GRADIENT), F.col("gu") * a["u"] + F.col("gl") * a["l"]))
    value = F.array(entry(F.lit(VALUE), F.lit(VALUE), F.log("p")))
    keys = ["g"] if own else []
    return told.select(*keys, F.explode(F.concat(pairs, slope, value)).alias("x")).groupBy(*keys, "x.i", "x.j").agg(F.sum("x.v").alias("v"))


def placed(entries, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Hessian, gradient and log likelihood from entries of terms 0 to size - 1."""
    h, s, value = np.zeros((size, size)), np.zeros(size), 0.0
    for i, j, v in entries:
        if i == VALUE:
            value += v
        elif j == GRADIENT:
            s[i] += v
        else:
            h[i, j] += v
            if i != j:
                h[j, i] += v
    return h, s, value


def local_system(entries, e: np.ndarray, mean: np.ndarray, sd: float) -> tuple[np.ndarray, ...]:
    """Of one group: the numbers of its common terms, its own Hessian with prior and the coupling, both gradients, common Hessian, value."""
    r = len(e)
    entries = [(x["i"], x["j"], x["v"]) for x in entries]
    common = sorted({i for i, j, _ in entries if i >= 0} | {j for _, j, _ in entries if j >= 0})
    place = {c: r + k for k, c in enumerate(common)} | {-k - 1: k for k in range(r)} | {VALUE: VALUE, GRADIENT: GRADIENT}
    h, s, value = placed([(place[i], place[j], v) for i, j, v in entries], r + len(common))
    own = h[:r, :r] + np.eye(r) / sd**2
    return np.array(common, dtype=int), own, h[:r, r:], s[:r] - (e - mean) / sd**2, s[r:], h[r:, r:], value - 0.5 * float((((e - mean) / sd) ** 2).sum())


def summed(system: DataFrame, size: int, mean: np.ndarray, sd: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Hessian and gradient of the common terms after the groups' terms are eliminated, and the value, from all groups."""
    low = np.tril_indices(size)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, s, total = np.zeros((size, size)), np.zeros(size), 0.0
        for batch in batches:
            for entries, e in zip(batch["entries"], batch["e"], strict=True):
                at, own, cross, mine, theirs, common, value = local_system(entries, np.asarray(e, float), mean, sd)
                solved = np.linalg.solve(own, np.column_stack([cross, mine]))
                h[np.ix_(at, at)] += common - cross.T @ solved[:, :-1]
                s[at] += theirs - cross.T @ solved[:, -1]
                total += value
        yield pd.DataFrame({"packed": [np.concatenate([h[low], s, [total]])]})

    packed = np.zeros(len(low[0]) + size + 1)
    for row in system.mapInPandas(reduce, "packed array<double>").collect():
        packed += np.asarray(row["packed"])
    h = np.zeros((size, size))
    h[low] = packed[: len(low[0])]
    return h + np.tril(h, -1).T, packed[len(low[0]): -1], float(packed[-1])


def moved(system: DataFrame, step: np.ndarray, covariance: np.ndarray, mean: np.ndarray, sd: float) -> DataFrame:
    """Per group: its terms, their Newton step given that of the common ones, and their posterior variances."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, entries, e in zip(batch["g"], batch["entries"], batch["e"], strict=True):
                at, own, cross, mine, *_ = local_system(entries, np.asarray(e, float), mean, sd)
                inverse = np.linalg.inv(own)
                pull = inverse @ cross
                var = np.diag(inverse) + np.einsum("ij,jk,ik->i", pull, covariance[np.ix_(at, at)], pull)
                out.append((g, np.asarray(e, float), inverse @ (mine - cross @ step[at]), var))
            yield pd.DataFrame(out, columns=["g", "e", "d", "var"])

    return materialize(system.mapInPandas(each, "g string, e array<double>, d array<double>, var array<double>"), "effects")


def fit_cumulative(
    df: DataFrame, y: str, xs: list[str], levels: int = 5, prior_means: tuple[float, ...] = THRESHOLD_PRIOR,
    threshold_sd: float = 1.0, prior_sd: float = 2.0, group: str | None = None, group_sd: float | None = 1.0,
    thresholds: str = "common", tolerance: float = 1e-7, most: int = 200,
) -> Fit:
    """Posterior mode of a proportional-odds regression with independent Gaussian priors.

    ``group`` adds an effect per group, shrunken by ``group_sd``, or with ``thresholds="by_group"``
    thresholds per group instead of the common ones. With ``group_sd=None`` the spread between groups
    is estimated by EM: posterior means and variances of the effects give the next spread, under a
    prior that is linear at 0 and so keeps it away from there. Rows with a null answer, covariate or
    group are left out. Any number of groups and levels may occur; the common terms' Hessian, squared
    in their number, is held by the driver.
    """
    spark = df.sparkSession
    own = None if group is None else "thresholds" if thresholds == "by_group" else "effect"
    r = {None: 0, "effect": 1, "thresholds": levels - 1}[own]
    cuts = 0 if own == "thresholds" else levels - 1
    # Names of our own: those of the caller's columns may be any.
    columns = {x: f"x{i}" for i, x in enumerate(xs)}
    answers = df.select(F.col(y).alias("y"), *[F.col(x).cast("string").alias(c) for x, c in columns.items()], *([F.col(group).cast("string").alias("g")] if group else []))
    cells = materialize(answers.na.drop().groupBy(*answers.columns).agg(F.count(F.lit(1)).alias("n")), "cells")
    index = index_levels(cells, columns, cuts)
    told = [(row["x"], row["level"]) for row in index.orderBy("number").collect()]
    names = [f"cut{j}" for j in range(1, cuts + 1)] + [f"{x}={v}" for x, v in told]
    mean = np.array([*prior_means[:cuts], *[0.0] * len(told)])
    sd = np.array([threshold_sd] * cuts + [prior_sd] * len(told))
    size = len(mean)
    cells = with_terms(cells, columns, index, ["y", "n", *(["g"] if group else [])])
    cells = materialize(cells.groupBy(*[c for c in cells.columns if c != "n"]).agg(F.sum("n").alias("n")), "cells")
    own_mean = np.array(prior_means if own == "thresholds" else [0.0] * r)
    spread = threshold_sd if own == "thresholds" else (group_sd or 1.0)
    estimated = own == "effect" and group_sd is None
    start = F.array(*[F.lit(float(m)) for m in own_mean])
    effects = materialize(cells.select("g").distinct().withColumns({"e": start, "d": F.transform(start, lambda x: x * 0.0)}), "effects") if own else None
    groups = effects.count() if own else 0

    def evaluate(mode: np.ndarray, effects: DataFrame | None) -> tuple:
        if own:
            sums = pair_sums(cells.join(effects.select("g", "e"), "g"), mode, levels, own)
            system = materialize(sums.groupBy("g").agg(F.collect_list(F.struct("i", "j", "v")).alias("entries")).join(effects.select("g", "e"), "g"), "system")
            h, s, value = summed(system, size, own_mean, spread)
        else:
            system = None
            h, s, value = placed([tuple(x) for x in pair_sums(cells, mode, levels, own).select("i", "j", "v").collect()], size)
        return system, h + np.diag(1 / sd**2), s - (mode - mean) / sd**2, value - 0.5 * float((((mode - mean) / sd) ** 2).sum())

    mode, history, trail = mean.copy(), [], []
    now = evaluate(mode, effects)
    for _ in range(most):
        system, h, s, value = now
        step = np.linalg.solve(h, s) if size else np.zeros(0)
        longest = float(np.abs(step).max(initial=0))
        if own:
            effects = moved(system, step, np.linalg.inv(h) if size else np.zeros((0, 0)), own_mean, spread)
            told = effects.agg(F.max(F.array_max(F.transform("d", lambda x: F.abs(x)))).alias("d"), F.sum(F.get("e", F.lit(0)) * F.get("e", F.lit(0)) + F.get("var", F.lit(0))).alias("s")).first()
            longest = max(longest, told["d"] or 0.0)
        history.append((value, spread))
        before = spread
        if estimated and longest < 0.1:
            spread = math.sqrt(max(told["s"], 1e-12) / max(groups - 1, 1))
            settled = abs(spread - before) <= 1e-4 * before
            trail.append(math.log(spread))
            if not settled and len(trail) == 3:
                # Steps of EM shrink by a nearly constant factor: go where they would end, within a factor of e.
                one, two = trail[1] - trail[0], trail[2] - trail[1]
                if 0 < two / one < 1:
                    spread = math.exp(trail[2] + min(max(two * two / (one - two), -1.0), 1.0))
                trail = []
        else:
            settled = not estimated
        if longest < (max(tolerance, 1e-5) if estimated else tolerance) and settled:
            break
        part = 1.0
        while True:
            there = effects.withColumn("e", F.zip_with("e", "d", lambda x, d: x + part * d)) if own else None
            now = evaluate(mode + part * step, there)
            # Beyond a changed spread the values are not comparable.
            if now[3] >= value - 1e-9 * abs(value) or part < 1e-4 or spread != before:
                break
            part /= 2
        mode, effects = mode + part * step, there
        if own:
            effects = effects.withColumn("d", F.transform("d", lambda x: x * 0.0))
    if own:
        effects = effects.select(F.col("g").alias("group"), F.col("e").alias("mean"), F.transform("var", lambda x: F.sqrt(x)).alias("sd"))
    return Fit(spark, names, mode, h, levels, xs, index, group, effects, spread if own else None, own == "thresholds", history)


def posterior_draws(fit: Fit, draws: int, seed: int = 1) -> DataFrame:
    """draw, term, value: normal draws of the common terms about the mode with the inverse Hessian as covariance.

    Each draw has a seed of its own, so it is the same however the draws are partitioned.
    """
    factor, mode, names = np.linalg.cholesky(fit.covariance()), fit.mode, fit.names

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                values = mode + factor @ np.random.default_rng([seed, k]).standard_normal(len(mode))
                yield pd.DataFrame({"draw": k, "term": names, "value": values})

    return fit.spark.range(draws).mapInPandas(draw, "draw long, term string, value double")


def expected_shares(fit: Fit, cells: DataFrame, draws: DataFrame) -> DataFrame:
    """Probability of every category for each draw and each of the distinct covariate combinations of ``cells``.

    Columns: draw, the covariates, category, p. Terms of a draw are packed into one array, joined on the draw.
    """
    place = fit.spark.createDataFrame([(n, k) for k, n in enumerate(fit.names)], "term string, k int")
    packed = draws.join(place, "term").groupBy("draw").agg(F.sort_array(F.collect_list(F.struct("k", "value")))["value"].alias("b"))
    packed = materialize(packed, "draws")
    combos = with_terms(cells.select(*fit.xs).distinct(), {x: x for x in fit.xs}, fit.index, fit.xs)
    last = packed.agg(F.max("draw")).first()[0]
    # A combination meets each draw by its number.
    wide = combos.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-1 if last is None else last).cast("long")))) if last is not None else combos.withColumn("draw", F.lit(0).cast("long"))
    met = wide.join(packed, "draw").withColumn("eta", F.aggregate("idx", F.lit(0.0), lambda s, i: s + F.get("b", i)))
    edges = [F.lit(0.0), *[logistic(F.get("b", F.lit(j)) - F.col("eta")) for j in range(fit.levels - 1)], F.lit(1.0)]
    shares = F.array(*[F.struct(F.lit(j + 1).alias("category"), (edges[j + 1] - edges[j]).alias("p")) for j in range(fit.levels)])
    return met.select("draw", *fit.xs, F.explode(shares).alias("s")).select("draw", *fit.xs, "s.category", "s.p")


def tail_shape(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution for sorted positive excesses.

    The estimate of Zhang and Stephens (2009): a mean over candidates for shape / scale, weighed by their
    profile likelihood; the shape is drawn towards 0.5 as if by ten more excesses.
    """
    n = len(excess)
    m = 30 + int(n**0.5)
    quarter = excess[int(n / 4 + 0.5) - 1]
    b = 1 / excess[-1] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * quarter)
    k = np.log1p(-b[:, None] * excess).mean(axis=1)
    fit = n * (np.log(-b / k) - k - 1)
    weight = np.exp(fit - fit.max())
    b = float((b * weight / weight.sum()).sum())
    k = float(np.log1p(-b * excess).mean())
    return (n * k + 5) / (n + 10), -k / b


def smoothed(ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Log importance weights whose largest are replaced by the order statistics of their Pareto fit, and its shape."""
    weights = ratios - ratios.max()
    n = len(weights)
    most = int(min(n / 5, 3 * math.sqrt(n)))
    if most < 5:
        return weights, math.inf
    order = np.argsort(weights, kind="stable")
    tail, cut = order[-most:], weights[order[-most - 1]]
    excess = np.exp(weights[tail]) - np.exp(cut)
    if excess[0] <= 0 or excess[-1] <= excess[0] * (1 + 1e-12):
        return weights, 0.0 if excess[-1] <= 1e-12 else math.inf
    shape, scale = tail_shape(excess)
    p = (np.arange(most) + 0.5) / most
    weights = weights.copy()
    weights[tail] = np.minimum(np.log(np.exp(cut) + (scale * np.expm1(-shape * np.log1p(-p)) / shape if abs(shape) > 1e-12 else -scale * np.log1p(-p))), 0.0)
    return weights, shape


def leave_one_out(fit: Fit, df: DataFrame, y: str, draws: DataFrame) -> DataFrame:
    """Log score of every answer under a fit without it, by Pareto-smoothed importance sampling from the draws.

    One row per covariate combination and answer: the covariates, ``y``, n (respondents), elpd (of one of
    them) and tail (the Pareto shape; above 0.7 the score is not to be trusted). Respondents are counted first; a task
    holds the draws of a combination, however many respondents it has.
    """
    counted = df.select(F.col(y).alias("_y"), *fit.xs).na.drop().groupBy("_y", *fit.xs).agg(F.count(F.lit(1)).alias("_n"))
    counted = materialize(counted, "counted")
    shares = expected_shares(fit, counted, draws)
    same = [F.col(x).eqNullSafe(F.col(f"_of_{x}")) for x in fit.xs]
    seen = counted.select("_y", "_n", *[F.col(x).alias(f"_of_{x}") for x in fit.xs])
    scored = shares.join(seen, [*same, F.col("category") == F.col("_y")]).groupBy(*fit.xs, "_y", "_n").agg(
        F.collect_list(F.log(F.greatest("p", F.lit(LEAST)))).alias("logs"))

    @F.pandas_udf("struct<elpd double, tail double>")
    def score(logs: pd.Series) -> pd.DataFrame:
        out = []
        for values in logs:
            values = np.sort(np.asarray(values, float))
            weights, shape = smoothed(-values)
            out.append((np.logaddexp.reduce(weights + values) - np.logaddexp.reduce(weights), shape))
        return pd.DataFrame(out, columns=["elpd", "tail"])

    return scored.withColumn("s", score("logs")).select(*fit.xs, F.col("_y").alias(y), F.col("_n").alias("n"), "s.elpd", "s.tail")


def fit_dispersion(
    df: DataFrame, y: str, xs: list[str], group: str, levels: int = 5, prior_means: tuple[float, ...] = THRESHOLD_PRIOR,
    threshold_sd: float = 1.0, prior_sd: float = 2.0, dispersion_sd: float = 0.5, tolerance: float = 1e-5, most: int = 60,
) -> tuple[Fit, DataFrame]:
    """Fit with a dispersion per group: P(answer <= j) = F((threshold_j - slopes) * exp(disc of the group)).

    The predictor is not linear in all terms, so steps alternate: a Newton step of thresholds and slopes with
    all scales as they are, one of every group's dispersion with those as they are, halved until the posterior
    rises, and the best common factor of all scales, which only the priors decide. Dispersions have a normal prior about 0. Returns the fit of the common terms, given the
    dispersions, and a table of group, disc and sd. Groups are a table: any number may occur. Rows
    with a null answer, covariate or group are left out.
    """
    columns = {x: f"x{i}" for i, x in enumerate(xs)}
    answers = df.select(F.col(y).alias("y"), *[F.col(x).cast("string").alias(c) for x, c in columns.items()], F.col(group).cast("string").alias("g"))
    cells = materialize(answers.na.drop().groupBy(*answers.columns).agg(F.count(F.lit(1)).alias("n")), "cells")
    index = index_levels(cells, columns, levels - 1)
    told = [(row["x"], row["level"]) for row in index.orderBy("number").collect()]
    names = [f"cut{j}" for j in range(1, levels)] + [f"{x}={v}" for x, v in told]
    mean = np.array([*prior_means[:levels - 1], *[0.0] * len(told)])
    sd = np.array([threshold_sd] * (levels - 1) + [prior_sd] * len(told))
    cells = materialize(with_terms(cells, columns, index, ["y", "n", "g"]), "cells")
    groups = materialize(cells.select("g").distinct().withColumn("disc", F.lit(0.0)), "dispersion")
    mode, history, h = mean.copy(), [], np.diag(1 / sd**2)

    def scaled(groups: DataFrame) -> DataFrame:
        return cells.join(groups.select("g", F.exp("disc").alias("s")), "g")

    def height(mode: np.ndarray, groups: DataFrame) -> float:
        likely = with_ends(scaled(groups), mode, levels).agg(F.coalesce(F.sum(F.col("n") * F.log("p")), F.lit(0.0))).first()[0]
        prior = groups.agg(F.coalesce(F.sum(F.col("disc") * F.col("disc")), F.lit(0.0))).first()[0] / dispersion_sd**2
        return likely - 0.5 * (prior + float((((mode - mean) / sd) ** 2).sum()))

    value = height(mode, groups)
    for _ in range(most):
        h, s, _ = placed([tuple(x) for x in pair_sums(scaled(groups), mode, levels, None).select("i", "j", "v").collect()], len(mode))
        h, s = h + np.diag(1 / sd**2), s - (mode - mean) / sd**2
        step, part = np.linalg.solve(h, s), 1.0
        while (there := height(mode + part * step, groups)) < value - 1e-9 * abs(value) and part > 1e-4:
            part /= 2
        mode, value, longest = mode + part * step, there, float(np.abs(part * step).max(initial=0))
        # In a dispersion an end moves by its own value.
        ends = with_ends(scaled(groups), mode, levels)
        slope = F.col("gu") * F.col("u") + F.col("gl") * F.col("l")
        bend = F.col("uu") * F.col("u") ** 2 + F.col("ll") * F.col("l") ** 2 + 2 * F.col("ul") * F.col("u") * F.col("l")
        sums = ends.groupBy("g").agg(F.sum(F.col("n") * slope).alias("a"), F.sum(F.col("n") * bend).alias("b"))
        a, b = F.col("a") - F.col("disc") / dispersion_sd**2, F.greatest(F.col("b") - F.col("a"), F.col("b") / 4) + 1 / dispersion_sd**2
        moves = materialize(groups.select("g", "disc").join(sums, "g").select("g", "disc", F.greatest(F.least(a / b, F.lit(0.7)), F.lit(-0.7)).alias("move"), (1 / F.sqrt(b)).alias("sd")), "moves")
        part = 1.0
        moved_by = lambda k: moves.select("g", (F.col("disc") + k * F.col("move")).alias("disc"), "sd")
        while (there := height(mode, moved_by(part))) < value - 1e-9 * abs(value) and part > 1e-4:
            part /= 2
        groups, value = moved_by(part), there
        told = moves.agg(F.coalesce(F.max(F.abs("move")), F.lit(0.0)).alias("most"), F.coalesce(F.sum(F.col("disc") + part * F.col("move")), F.lit(0.0)).alias("sum"), F.count(F.lit(1)).alias("n")).first()
        # All terms smaller and all dispersions larger by the same factor is the same likelihood: only the priors say by how much.
        common = 0.0
        for _ in range(30):
            x = mode * math.exp(-common)
            first = float((-(x - mean) * x / sd**2).sum()) + (told["sum"] + told["n"] * common) / dispersion_sd**2
            common -= first / max(float(((2 * x - mean) * x / sd**2).sum()) + told["n"] / dispersion_sd**2, 1e-3)
        if (there := height(mode * math.exp(-common), groups.withColumn("disc", F.col("disc") + common))) >= value - 1e-9 * abs(value):
            mode, groups, value = mode * math.exp(-common), groups.withColumn("disc", F.col("disc") + common), there
        longest = max(longest, part * told["most"], abs(common))
        history.append((value, longest))
        if longest < tolerance:
            break
    fit = Fit(df.sparkSession, names, mode, h, levels, list(xs), index, history=history)
    return fit, groups.select(F.col("g").alias("group"), "disc", *([F.col("sd")] if "sd" in groups.columns else [F.lit(dispersion_sd).alias("sd")]))
