"""Ordinal answers, posterior draws, curves and fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from canvass.functions.scalars import age, age_band
from canvass.operators import likelihood as lk
from canvass.operators import ordinal as om
from canvass.plans import views as v
from canvass.plans.catalog import registry as r
from canvass.plans.catalog.registry import query
from canvass.plans.catalog.measures import rounded

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
AGE = "2024 - birth_year"
BROAD = f"""CASE WHEN {AGE} < 18 THEN '<18' WHEN {AGE} < 30 THEN '18-29' WHEN {AGE} < 50 THEN '30-49' WHEN {AGE} < 65 THEN '50-64'
  WHEN {AGE} > 64 THEN '>64' END"""


def rated(spark, d):
    """Rating with gender, broad age band and city."""
    return v.respondents(spark, d).select(
        "id", "city", "rating", F.col("gender_code").alias("gender"),
        age_band(age("birth_year", 2024), "broad").alias("age_group"))


CELLS = f"""{r.RESPONDENTS}, cells AS (SELECT gender_code gender, {BROAD} age_group, rating, count(*) n FROM respondents
  WHERE gender_code IS NOT NULL AND birth_year IS NOT NULL AND rating IS NOT NULL GROUP BY 1, 2, 3)"""


@query("M1_ordinal_cells", f"WITH {CELLS} SELECT * FROM cells")
def ordinal_cells(spark, d):
    return om.ordinal_cells(rated(spark, d), "rating", ["gender", "age_group"])


@query("M2_cumulative_logits", f"""WITH {r.RESPONDENTS}, k AS (SELECT city, rating, count(*) n FROM respondents WHERE rating IS NOT NULL GROUP BY 1, 2),
  c AS (SELECT city, rating, n, CAST(sum(n) OVER (PARTITION BY city ORDER BY rating) AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY city) AS DOUBLE) cum_share FROM k)
  SELECT city, rating, n, cum_share, round(CASE WHEN cum_share > 0 AND cum_share < 1 THEN ln(cum_share / (1 - cum_share)) END, 12) logit FROM c""")
def cumulative_logits(spark, d):
    return rounded(om.cumulative_logits(rated(spark, d), "rating", ["city"]), 12, "logit")


@query("M3_summarise_draws", f"""WITH {r.DRAWS} SELECT category, grp, round(avg(p), 12) est, round(quantile_cont(p, 0.025), 12) lwr95,
  round(quantile_cont(p, 0.25), 12) lwr50, round(quantile_cont(p, 0.75), 12) upr50, round(quantile_cont(p, 0.975), 12) upr95 FROM draws GROUP BY 1, 2""")
def summarise_draws(spark, d):
    out = om.summarise_draws(v.draws(spark, d), ["category", "grp"], "p")
    return rounded(out, 12, "est", "lwr95", "lwr50", "upr50", "upr95")


CATEGORY = "CASE category " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(EVENT_TYPES, 1)) + " END"


def numbered_draws(spark, d):
    """Draws with the event type as an ordinal category."""
    number = reduce(lambda a, e: a.when(F.col("category") == e[1], e[0]), list(enumerate(EVENT_TYPES, 1))[1:],
                    F.when(F.col("category") == EVENT_TYPES[0], 1))
    return v.draws(spark, d).withColumn("number", number)


@query("M4_mean_category", f"WITH {r.DRAWS} SELECT draw, grp, round(sum({CATEGORY} * p), 12) mean_cat FROM draws GROUP BY 1, 2")
def mean_category(spark, d):
    return rounded(om.mean_category(numbered_draws(spark, d), ["draw", "grp"], "number", "p"), 12, "mean_cat")


def wide_draws(spark, d):
    """One row per draw; an effect and a dispersion column per group."""
    draws = v.draws(spark, d)
    at = lambda g, e: F.sum(F.when((F.col("grp") == g) & (F.col("category") == e), F.col("p")))
    return draws.groupBy("draw").agg(
        *[at(g, "click").alias(f"r_city[{g},Intercept]") for g in range(5)],
        *[at(g, "view").alias(f"r_city__disc[{g},Intercept]") for g in range(5)])


@query("M5_reshape_draws", f"""WITH {r.DRAWS} SELECT CAST(grp AS VARCHAR) grp, round(avg(CASE WHEN category = 'click' THEN p END), 12) effect,
  round(avg(CASE WHEN category = 'view' THEN p END), 12) disc FROM draws GROUP BY 1""")
def reshape_draws(spark, d):
    wide = wide_draws(spark, d)
    out = om.reshape_draws(wide, [c for c in wide.columns if c != "draw"],
                           {"disc": r"^r_city__disc", "effect": r"^r_city"}, r"\[(.*),")
    return rounded(out, 12, "effect", "disc")


@query("M6_logistic_curve", f"""WITH {r.DRAWS}, par AS (SELECT grp, avg(CASE WHEN category = 'click' THEN p END) mu,
  avg(CASE WHEN category = 'view' THEN p END) disc FROM draws GROUP BY 1),
  s AS (SELECT grp, mu, 1 / exp(disc) sigma FROM par), z AS (SELECT grp, mu, sigma, -5.5e0 + i * (11e0 / 499) x FROM s CROSS JOIN range(500) t(i))
  SELECT grp, round(x, 12) x, round(exp(-abs((x - mu) / sigma)) / (sigma * pow(1 + exp(-abs((x - mu) / sigma)), 2)), 12) d FROM z""")
def logistic_curve(spark, d):
    at = lambda e: F.avg(F.when(F.col("category") == e, F.col("p")))
    params = v.draws(spark, d).groupBy("grp").agg(at("click").alias("mu"), at("view").alias("disc"))
    return rounded(om.logistic_curve(params, "mu", "disc", -5.5, 5.5, 500), 12, "x", "d").select("grp", "x", "d")


EVENTS = "SELECT user_id % 5 grp, event_type category FROM events"


@query("M7_predictive_check", f"""WITH {r.DRAWS}, obs AS (SELECT grp, category, count(*) observed FROM ({EVENTS}) t GROUP BY 1, 2),
  pred AS (SELECT grp, category, avg(p) p FROM draws GROUP BY 1, 2)
  SELECT pred.grp, pred.category, coalesce(observed, 0) observed, round(p * (SELECT sum(observed) FROM obs o WHERE o.grp = pred.grp), 8) predicted
  FROM pred LEFT JOIN obs ON pred.grp = obs.grp AND pred.category = obs.category""")
def predictive_check(spark, d):
    events = v.table(spark, d, "events").select((F.col("user_id") % 5).alias("grp"), F.col("event_type").alias("category"))
    return rounded(om.predictive_check(events, v.draws(spark, d), ["grp"], "category"), 8, "predicted")


@query("M7_predictive_check_overall", f"""WITH {r.DRAWS}, obs AS (SELECT category, count(*) observed FROM ({EVENTS}) t GROUP BY 1)
  SELECT category, any_value(observed) observed, round(avg(p) * (SELECT sum(observed) FROM obs), 8) predicted FROM draws JOIN obs USING (category) GROUP BY 1""")
def predictive_check_overall(spark, d):
    events = v.table(spark, d, "events").select(F.col("event_type").alias("category"))
    return rounded(om.predictive_check(events, v.draws(spark, d), [], "category"), 8, "predicted")


def pointwise_scores(spark, d):
    """Log scores of two simple models of item quality, each fitted without the item's own fold.

    Kept as counted cells: every item of a cell has the same score.
    """
    items = v.scored(spark, d).where(F.col("quality").isNotNull())
    cells = items.groupBy((F.col("id") % 5).alias("fold"), "lang", "quality").agg(F.count(F.lit(1)).alias("n"))
    good = F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(F.lit(0)))

    def outside(keys, name):
        """Share of good items per key, from the other folds: all folds minus the own one."""
        whole = cells.groupBy(*[F.col(k).alias(f"w_{k}") for k in keys]).agg(good.alias("g1"), F.sum("n").alias("n1"))
        own = cells.groupBy("fold", *keys).agg(good.alias("g0"), F.sum("n").alias("n0"))
        both = own.join(whole, [F.col(k) == F.col(f"w_{k}") for k in keys]) if keys else own.withColumns({
            "g1": whole.select("g1").scalar(), "n1": whole.select("n1").scalar()})
        p = (F.col("g1") - F.col("g0") + 1) / (F.col("n1") - F.col("n0") + 2)
        return both.select("fold", *keys, p.alias(name))

    score = lambda p: F.log(F.when(F.col("quality") == 1, F.col(p)).otherwise(F.lit(1.0) - F.col(p)))
    return (
        cells.join(outside([], "p_all"), "fold").join(outside(["lang"], "p_lang"), ["fold", "lang"])
        .select("n", score("p_all").alias("overall"), score("p_lang").alias("by_lang"))
    )


@query("M8_compare_scores", f"""WITH {r.SCORED}, i AS (SELECT id % 5 fold, lang, quality FROM scored WHERE quality IS NOT NULL),
  k AS (SELECT fold, lang, sum(quality) g, count(*) n FROM i GROUP BY 1, 2),
  a AS (SELECT fold, ((SELECT sum(g) FROM k) - sum(g) + 1) / CAST((SELECT sum(n) FROM k) - sum(n) + 2 AS DOUBLE) p FROM k GROUP BY 1),
  b AS (SELECT fold, lang, (sum(g) OVER (PARTITION BY lang) - g + 1) / CAST(sum(n) OVER (PARTITION BY lang) - n + 2 AS DOUBLE) p FROM k),
  s AS (SELECT ln(CASE WHEN quality = 1 THEN a.p ELSE 1 - a.p END) overall, ln(CASE WHEN quality = 1 THEN b.p ELSE 1 - b.p END) by_lang
        FROM i JOIN a ON i.fold = a.fold JOIN b ON i.fold = b.fold AND i.lang = b.lang),
  t AS (SELECT count(*) n, sum(overall) so, sum(by_lang) sb, sum(overall - by_lang) d, stddev_samp(overall - by_lang) sd FROM s)
  SELECT 'overall' model, round(so, 6) elpd, round(so - greatest(so, sb), 6) + 0e0 elpd_diff, round(CASE WHEN so >= sb THEN 0e0 ELSE sqrt(n) * sd END, 6) se_diff FROM t
  UNION ALL SELECT 'by_lang', round(sb, 6), round(sb - greatest(so, sb), 6) + 0e0, round(CASE WHEN sb > so THEN 0e0 ELSE sqrt(n) * sd END, 6) FROM t""")
def compare_scores(spark, d):
    out = om.compare_scores(pointwise_scores(spark, d), ["overall", "by_lang"], "n")
    return rounded(out, 6, "elpd", "elpd_diff", "se_diff").withColumn("elpd_diff", F.col("elpd_diff") + F.lit(0.0))


STACK = f"""WITH {CELLS} SELECT gender, age_group, CAST(j AS INT) cut, CAST(sum(n) AS BIGINT) w,
  CAST(sum(CASE WHEN rating <= j THEN n ELSE 0 END) AS BIGINT) k FROM cells CROSS JOIN range(1, 5) t(j) GROUP BY 1, 2, 3"""


@query("M9_stacked_cells", STACK)
def stacked_cells(spark, d):
    return om.stack_cumulative(om.ordinal_cells(rated(spark, d), "rating", ["gender", "age_group"]), "rating", 5)


CITIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SLOPES = [(f"gender={g}", f"gender = {g}", 2.0) for g in (2, 3)] + [
    (f"age_group={a}", f"age_group = '{a}'", 2.0) for a in ("30-49", "50-64", "<18", ">64")]


def mode_sql(slopes, own_thresholds=(), effects=0, rounds=800, momentum=0.9):
    """The posterior mode in SQL, by scaled gradient steps with momentum over the counted cells until nothing moves.

    ``slopes`` has name, condition and prior sd of each slope; the last ``effects`` of them are shrunken effects,
    which move together with the thresholds without changing the likelihood: that shift is taken exactly.
    """
    heads = [(f"cut{j}" + (f":{g}" if g else ""), om.THRESHOLD_PRIOR[j - 1], 1.0) for g in (own_thresholds or [""]) for j in range(1, 5)]
    terms = heads + [(name, 0.0, sd) for name, _, sd in slopes]
    first = "4 * (list_position([" + ", ".join(f"'{g}'" for g in own_thresholds) + "], city) - 1)" if own_thresholds else "0"
    marks = ", ".join(f"CASE WHEN {c} THEN {len(heads) + k} END" for k, (_, c, _) in enumerate(slopes, 1))
    joint = [k for k in range(len(terms)) if k < len(heads) or k >= len(terms) - effects] if effects else []
    off = " + ".join(f"(b[{k + 1}] - ({terms[k][1]}e0)) / {terms[k][2] ** 2}e0" for k in joint)
    shift = f" - ({off}) / {sum(1 / terms[k][2] ** 2 for k in joint)}e0" if joint else ""
    entries = []
    for k, (_, mean, sd) in enumerate(terms):
        if k < len(heads):
            at = f"CASE WHEN u = {k + 1} THEN n * {{0}} WHEN l = {k + 1} THEN n * {{1}} ELSE 0 END"
            score, curve = at.format("gu", "gl"), at.format("uu", "ll")
        else:
            at = f"CASE WHEN list_contains(s, {k + 1}) THEN n * ({{}}) ELSE 0 END"
            score, curve = at.format("-gu - gl"), at.format("uu + ll + 2 * ul")
        entries.append(f"b[{k + 1}] + {momentum}e0 * (b[{k + 1}] - o[{k + 1}]) + (sum({score}) - (b[{k + 1}] - ({mean}e0)) / {sd**2}e0) / (4 * (sum({curve}) + {1 / sd**2}e0))"
                       + (shift if k in joint else ""))
    start = "[" + ", ".join(f"{mean}e0" for _, mean, _ in terms) + "]"
    return f"""WITH RECURSIVE {r.RESPONDENTS}, answers AS (SELECT gender_code gender, {BROAD} age_group, city, rating y FROM respondents
  WHERE gender_code IS NOT NULL AND birth_year IS NOT NULL AND rating IS NOT NULL),
  cells AS MATERIALIZED (SELECT y, CAST(count(*) AS DOUBLE) n, CASE WHEN y < 5 THEN {first} + y END u, CASE WHEN y > 1 THEN {first} + y - 1 END l, [{marks}] s FROM answers GROUP BY ALL),
  fit AS (SELECT 0 i, {start} b, {start} o UNION ALL
    SELECT i + 1, [{", ".join(entries)}], b FROM (
      SELECT *, gu * (gu - 1 + 2 * fu) uu, gl * (gl - 1 + 2 * fl) ll, gu * gl ul FROM (
      SELECT *, fu * (1 - fu) / (fu - fl) gu, -fl * (1 - fl) / (fu - fl) gl FROM (
      SELECT *, CASE WHEN u IS NULL THEN 1e0 ELSE 1 / (1 + exp(eta - b[u])) END fu, CASE WHEN l IS NULL THEN 0e0 ELSE 1 / (1 + exp(eta - b[l])) END fl FROM (
      SELECT *, coalesce(list_sum(list_transform(s, lambda k: CASE WHEN k IS NULL THEN 0e0 ELSE b[k] END)), 0) eta FROM fit, cells WHERE i < {rounds}) t) t) t) t GROUP BY i, b, o)
  SELECT term, round(estimate, 6) + 0e0 estimate FROM (SELECT unnest([{", ".join(f"'{name}'" for name, _, _ in terms)}]) term, unnest(b) estimate FROM fit WHERE i = {rounds}) t"""


def estimates(fit):
    return rounded(fit.estimates().select("term", "estimate"), 6, "estimate").withColumn("estimate", F.col("estimate") + F.lit(0.0))


@query("M9_fit_ordinal", mode_sql(SLOPES))
def fit_ordinal(spark, d):
    return estimates(lk.fit_cumulative(rated(spark, d), "rating", ["gender", "age_group"]))


@query("M10_group_intercepts", mode_sql(SLOPES + [(f"city={c}", f"city = '{c}'", 1.0) for c in CITIES], effects=5))
def group_intercepts(spark, d):
    return estimates(lk.fit_cumulative(rated(spark, d), "rating", ["gender", "age_group"], group="city"))


@query("M10_group_thresholds", mode_sql(SLOPES, CITIES))
def group_thresholds(spark, d):
    return estimates(lk.fit_cumulative(rated(spark, d), "rating", ["gender", "age_group"], group="city", thresholds="by_group"))


@query("M10_estimated_spread")
def estimated_spread(spark, d):
    """Effects of the cities with the spread between them estimated from the answers."""
    fit = lk.fit_cumulative(rated(spark, d), "rating", ["gender", "age_group"], group="city", group_sd=None)
    return fit.estimates().withColumn("group_sd", F.lit(fit.group_sd))


def shares_of_fit(spark, d, xs, draws=400):
    """Probabilities of every rating under draws from the posterior of a fit on the covariates."""
    people = rated(spark, d)
    fit = lk.fit_cumulative(people, "rating", xs)
    return people, lk.expected_shares(fit, people.na.drop(subset=xs), lk.posterior_draws(fit, draws))


@query("M3_fit_intervals")
def fit_intervals(spark, d):
    _, shares = shares_of_fit(spark, d, ["gender", "age_group"])
    return om.summarise_draws(shares, ["gender", "age_group", "category"], "p")


@query("M4_fit_mean_category")
def fit_mean_category(spark, d):
    _, shares = shares_of_fit(spark, d, ["gender"])
    return om.summarise_draws(om.mean_category(shares, ["draw", "gender"], "category", "p"), ["gender"], "mean_cat")


@query("M8_leave_one_out")
def leave_one_out(spark, d):
    """Two models of the rating ranked by the scores of answers they have not seen."""
    people = rated(spark, d).na.drop(subset=["rating", "gender", "age_group"])
    scores = []
    for name, xs in (("gender", ["gender"]), ("age_group", ["age_group"])):
        fit = lk.fit_cumulative(people, "rating", xs)
        scores.append(lk.leave_one_out(fit, people, "rating", lk.posterior_draws(fit, 400)).select(*xs, "rating", F.col("elpd").alias(f"by_{name}")))
    cells = om.ordinal_cells(people, "rating", ["gender", "age_group"])
    pointwise = cells.join(scores[0], ["gender", "rating"]).join(scores[1], ["age_group", "rating"])
    return om.compare_scores(pointwise, ["by_gender", "by_age_group"], "n")


@query("M7_fit_predictive_check")
def fit_predictive_check(spark, d):
    people, shares = shares_of_fit(spark, d, ["gender"])
    return om.predictive_check(people.withColumnRenamed("rating", "category"), shares, ["gender"], "category")


@query("M11_stacked_adjacent", f"""WITH {CELLS} SELECT gender, age_group, CAST(j AS INT) cut, CAST(sum(n) AS BIGINT) w,
  CAST(sum(CASE WHEN rating = j THEN n ELSE 0 END) AS BIGINT) k FROM cells CROSS JOIN range(1, 5) t(j) WHERE rating IN (j, j + 1) GROUP BY 1, 2, 3""")
def stacked_adjacent(spark, d):
    return om.stack_adjacent(om.ordinal_cells(rated(spark, d), "rating", ["gender", "age_group"]), "rating", 5)


@query("M11_proportional_odds")
def proportional_odds(spark, d):
    return om.check_proportional_odds(rated(spark, d), "rating", ["gender"], "id", folds=2)


@query("M10_dispersion")
def dispersion(spark, d):
    """Thresholds, slopes and the dispersion of every city."""
    fit, groups = lk.fit_dispersion(rated(spark, d), "rating", ["gender"], "city")
    disc = groups.select(F.concat(F.lit("disc:"), "group").alias("term"), F.col("disc").alias("estimate"), F.col("sd").alias("se"))
    return fit.estimates().unionByName(disc)


@query("M11_chosen_slopes")
def chosen_slopes(spark, d):
    """Five models ranked: common slopes in two forms, all specific, and specific for gender or age only."""
    return om.check_proportional_odds(rated(spark, d), "rating", ["gender", "age_group"], "id", folds=2, chosen=[["gender"], ["age_group"]])
