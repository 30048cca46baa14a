import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from canvass.operators import ordinal as om


@pytest.fixture(scope="module")
def answers(spark):
    rng = np.random.default_rng(11)
    n = 1500
    g = rng.integers(0, 3, n)
    city = rng.choice(["A", "B", "C"], n, p=[0.7, 0.2, 0.1])
    latent = rng.logistic(size=n) + np.array([0.0, 0.8, -0.5])[g] + (city == "B") * 0.6
    y = 1 + (latent[:, None] > np.array([-1.5, -0.4, 0.5, 1.6])).sum(1)
    pdf = pd.DataFrame({"id": np.arange(n), "g": [f"g{i}" for i in g], "city": city, "y": y.astype("int32")})
    return spark.createDataFrame(pdf).cache(), pdf


def newton(x, k, w, mean, sd):
    """Posterior mode of a binomial regression with independent Gaussian priors."""
    b = np.array(mean, float)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        grad = x.T @ (k - w * p) - (b - mean) / sd**2
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(1 / sd**2)
        b = b + np.linalg.solve(hess, grad)
    return b


def design(pdf, with_city=False):
    x, k, w = [], [], []
    for (g, city), part in pdf.groupby(["g", "city"] if with_city else ["g", lambda _: ""]):
        for j in range(1, 5):
            row = [float(j == c) for c in range(1, 5)] + [-float(g == v) for v in ("g1", "g2")]
            if with_city:
                row += [-float(city == c) for c in ("A", "B", "C")]
            x.append(row), k.append((part.y <= j).sum()), w.append(len(part))
    return np.array(x), np.array(k, float), np.array(w, float)


def test_fit_agrees_with_newton(answers):
    df, pdf = answers
    got = {r.term: r.estimate for r in om.fit_ordinal(df, "y", ["g"]).collect()}
    x, k, w = design(pdf)
    expected = newton(x, k, w, np.array([*om.THRESHOLD_PRIOR, 0, 0]), np.array([1, 1, 1, 1, 2.0, 2.0]))
    np.testing.assert_allclose([got[t] for t in ("cut1", "cut2", "cut3", "cut4", "g=g1", "g=g2")], expected, atol=1e-4)


def test_group_intercepts_are_shrunken(answers):
    df, pdf = answers
    got = {r.term: r.estimate for r in om.fit_ordinal(df, "y", ["g"], group="city", group_sd=0.3).collect()}
    x, k, w = design(pdf, with_city=True)
    expected = newton(x, k, w, np.array([*om.THRESHOLD_PRIOR, 0, 0, 0, 0, 0]), np.array([1, 1, 1, 1, 2, 2, 0.3, 0.3, 0.3]))
    names = ["cut1", "cut2", "cut3", "cut4", "g=g1", "g=g2", "city=A", "city=B", "city=C"]
    np.testing.assert_allclose([got[t] for t in names], expected, atol=1e-4)
    assert got["city=B"] > got["city=A"]


def test_group_thresholds(answers):
    df, _ = answers
    terms = {r.term for r in om.fit_ordinal(df, "y", ["g"], group="city", thresholds="by_group").collect()}
    assert len([t for t in terms if t.startswith("cut")]) == 12 and "city=A" not in terms


def test_scores_agree_with_direct_probabilities(answers):
    df, pdf = answers
    out = {r.model: r for r in om.check_proportional_odds(df, "y", ["g"], "id", folds=2).collect()}
    total = 0.0
    for fold in range(2):
        train, test = pdf[pdf.id % 2 != fold], pdf[pdf.id % 2 == fold]
        x, k, w = design(train)
        b = newton(x, k, w, np.array([*om.THRESHOLD_PRIOR, 0, 0]), np.array([1, 1, 1, 1, 2.0, 2.0]))
        slope = {"g0": 0.0, "g1": b[4], "g2": b[5]}
        for g, y in zip(test.g, test.y, strict=True):
            edge = [0, *[1 / (1 + np.exp(-(t - slope[g]))) for t in b[:4]], 1]
            total += np.log(edge[y] - edge[y - 1])
    assert out["cumulative"].elpd == pytest.approx(total, rel=1e-4)
    assert max(r.elpd_diff for r in out.values()) == 0.0
    assert all(r.se_diff >= 0 for r in out.values())


def test_slopes_of_chosen_covariates(answers):
    """A model whose every covariate is chosen is the one with all slopes specific, one without is the common one."""
    df, _ = answers
    out = {r.model: r.elpd for r in om.check_proportional_odds(df, "y", ["g", "city"], "id", folds=2, chosen=[["g"], ["g", "city"], []]).collect()}
    assert set(out) == {"cumulative", "adjacent", "adjacent_specific", "adjacent_g", "adjacent_g_city", "adjacent_"}
    assert out["adjacent_g_city"] == pytest.approx(out["adjacent_specific"], abs=1e-3)
    assert out["adjacent_"] == pytest.approx(out["adjacent"], abs=1e-3)
    assert out["adjacent_g"] != pytest.approx(out["adjacent"], abs=1e-3)


def test_compare_scores_with_weights(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(-1, 0.2, 50), rng.normal(-1.2, 0.2, 50)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "w": 1.0}))
    out = {r.model: r for r in om.compare_scores(df, ["a", "b"], "w").collect()}
    best, other = ("a", "b") if a.sum() > b.sum() else ("b", "a")
    assert out[best].elpd_diff == 0.0
    d = {"a": a, "b": b}[other] - {"a": a, "b": b}[best]
    assert out[other].elpd_diff == pytest.approx(d.sum())
    assert out[other].se_diff == pytest.approx(np.sqrt(50) * d.std(ddof=1))


def test_adjacent_stack(spark):
    cells = spark.createDataFrame([("x", 1, 4), ("x", 2, 3), ("x", 3, 2)], "g string, y int, n bigint")
    assert rows(om.stack_adjacent(cells, "y", 3).select("cut", "w", "k")) == [(1, 7, 4), (2, 5, 3)]
    assert rows(om.stack_cumulative(cells, "y", 3).select("cut", "w", "k")) == [(1, 9, 4), (2, 9, 7)]


def test_equal_shares_give_prior_thresholds(spark):
    df = spark.createDataFrame([(i % 5 + 1,) for i in range(100)], "y int")
    logits = [r.logit for r in om.cumulative_logits(df, "y", []).orderBy("y").collect()]
    np.testing.assert_allclose(logits[:4], [-1.386294, -0.405465, 0.405465, 1.386294], atol=1e-6)
    assert logits[4] is None


def test_draws(spark):
    draws = spark.createDataFrame([(d, c, p) for d in range(4) for c, p in ((1, 0.25), (2, 0.75))], "draw int, cat int, p double")
    assert rows(om.mean_category(draws, ["draw"], "cat", "p")) == [(d, 1.75) for d in range(4)]
    s = om.summarise_draws(draws, ["cat"], "p").orderBy("cat").collect()
    assert (s[0].est, s[0].lwr95, s[0].upr95) == (0.25, 0.25, 0.25)
    obs = spark.createDataFrame([(1,), (2,), (2,), (2,), (3,)], "cat int")
    check = {r.cat: (r.observed, r.predicted) for r in om.predictive_check(obs, draws, [], "cat").collect()}
    assert check == {1: (1, 1.25), 2: (3, 3.75), 3: (1, None)}


def test_reshaped_draws(spark):
    wide = spark.createDataFrame([(1.0, 3.0, 0.0), (3.0, 5.0, 2.0)], "a double, b double, c double").toDF(
        "r_city[A,Intercept]", "r_city__disc[A,Intercept]", "r_city[B,Intercept]")
    out = om.reshape_draws(wide, wide.columns, {"disc": "^r_city__disc", "effect": "^r_city"}, r"\[(.*),")
    assert rows(out) == [("A", 4.0, 2.0), ("B", None, 1.0)]
    curve = om.logistic_curve(out.na.fill(0.0), "effect", "disc", -5, 5, 101)
    assert curve.groupBy("grp").count().count() == 2
    assert curve.where((F.col("grp") == "B") & (F.col("x") == 1.0)).first().d == pytest.approx(0.25)
