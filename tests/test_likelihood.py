import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canvass.operators import likelihood as lk
from canvass.operators import ordinal as om

PRIOR = np.array(om.THRESHOLD_PRIOR)


def sigmoid(v):
    return 1 / (1 + np.exp(-v))


def gradient(theta, x, y, n, mean, sd):
    """Score and log posterior of dense terms; the first four are thresholds, x has -1 for every active slope."""
    upper, lower = np.append(theta[:4], np.inf), np.append(-np.inf, theta[:4])
    eta = x @ theta[4:]
    fu, fl = sigmoid(upper[y - 1] + eta), sigmoid(lower[y - 1] + eta)
    p = fu - fl
    gu, gl = fu * (1 - fu) / p, -fl * (1 - fl) / p
    score = np.zeros(len(theta))
    np.add.at(score, np.minimum(y - 1, 3), n * gu * (y < 5))
    np.add.at(score, np.maximum(y - 2, 0), n * gl * (y > 1))
    score[4:] += x.T @ (n * (gu + gl))
    return score - (theta - mean) / sd**2


def mode_of(x, y, n, mean, sd):
    """Newton with a numerical Hessian."""
    theta = mean.copy()
    for _ in range(60):
        g = gradient(theta, x, y, n, mean, sd)
        h = np.array([(gradient(theta + 1e-5 * e, x, y, n, mean, sd) - gradient(theta - 1e-5 * e, x, y, n, mean, sd)) / 2e-5 for e in np.eye(len(theta))])
        step = np.linalg.solve(h, g)
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return theta, -(h + h.T) / 2


def planted(n=3000, groups=3, spread=0.0, seed=11):
    rng = np.random.default_rng(seed)
    g, city = rng.integers(0, 3, n), rng.integers(0, groups, n)
    effect = rng.normal(size=groups) * spread
    latent = rng.logistic(size=n) + np.array([0.0, 0.8, -0.5])[g] + effect[city]
    y = 1 + (latent[:, None] > np.array([-1.5, -0.4, 0.5, 1.6])).sum(1)
    return pd.DataFrame({"id": np.arange(n), "g": [f"g{i}" for i in g], "city": [f"c{i}" for i in city], "y": y.astype("int32")}), effect


def dense(pdf, columns):
    return np.column_stack([-(pdf[c] == v).to_numpy(float) for c, v in columns])


@pytest.fixture(scope="module")
def answers(spark):
    pdf, _ = planted()
    return spark.createDataFrame(pdf).cache(), pdf


def test_mode_and_errors(answers):
    df, pdf = answers
    fit = lk.fit_cumulative(df, "y", ["g"])
    mean, sd = np.append(PRIOR, [0, 0]), np.array([1, 1, 1, 1, 2.0, 2.0])
    want, h = mode_of(dense(pdf, [("g", "g1"), ("g", "g2")]), pdf.y.to_numpy(), np.ones(len(pdf)), mean, sd)
    assert fit.names == ["cut1", "cut2", "cut3", "cut4", "g=g1", "g=g2"]
    np.testing.assert_allclose(fit.mode, want, atol=1e-6)
    np.testing.assert_allclose(fit.precision, h, rtol=1e-4, atol=1e-2)
    got = {r.term: r for r in fit.estimates().collect()}
    assert got["g=g1"].se == pytest.approx(np.sqrt(np.linalg.inv(h)[4, 4]), rel=1e-4)


def test_group_effects(answers):
    df, pdf = answers
    fit = lk.fit_cumulative(df, "y", ["g"], group="city", group_sd=0.3)
    mean, sd = np.append(PRIOR, [0.0] * 5), np.array([1, 1, 1, 1, 2, 2, 0.3, 0.3, 0.3])
    want, h = mode_of(dense(pdf, [("g", "g1"), ("g", "g2"), ("city", "c0"), ("city", "c1"), ("city", "c2")]), pdf.y.to_numpy(), np.ones(len(pdf)), mean, sd)
    np.testing.assert_allclose(fit.mode, want[:6], atol=1e-5)
    effects = {r.group: r for r in fit.effects.collect()}
    np.testing.assert_allclose([effects[f"c{k}"].mean[0] for k in range(3)], want[6:], atol=1e-5)
    cov = np.linalg.inv(h)
    np.testing.assert_allclose(fit.covariance(), cov[:6, :6], atol=1e-5)
    np.testing.assert_allclose([effects[f"c{k}"].sd[0] for k in range(3)], np.sqrt(np.diag(cov)[6:]), rtol=1e-3)


def test_group_thresholds(answers):
    df, pdf = answers
    fit = lk.fit_cumulative(df, "y", ["g"], group="city", thresholds="by_group")
    effects = {r.group: np.array(r.mean) for r in fit.effects.collect()}
    assert fit.names == ["g=g1", "g=g2"]
    # At the mode the score of every group's thresholds, given the slopes, is 0.
    for city, part in pdf.groupby("city"):
        x = dense(part, [("g", "g1"), ("g", "g2")])
        theta = np.append(effects[city], fit.mode)
        score = gradient(theta, x, part.y.to_numpy(), np.ones(len(part)), np.append(PRIOR, fit.mode), np.ones(6))
        np.testing.assert_allclose(score[:4], 0, atol=1e-3)


def test_spread_is_recovered(spark):
    pdf, effect = planted(n=20_000, groups=60, spread=0.7, seed=3)
    fit = lk.fit_cumulative(spark.createDataFrame(pdf), "y", ["g"], group="city", group_sd=None)
    assert fit.group_sd == pytest.approx(effect.std(ddof=1), rel=0.1)
    assert len(fit.history) < 40
    got = {r.group: r.mean[0] for r in fit.effects.collect()}
    assert np.corrcoef([got[f"c{k}"] for k in range(60)], effect)[0, 1] > 0.95


def test_draws(answers):
    df, pdf = answers
    fit = lk.fit_cumulative(df, "y", ["g"])
    draws = lk.posterior_draws(fit, 2000, seed=5)
    wide = draws.toPandas().pivot(index="draw", columns="term", values="value")[fit.names]
    se = np.sqrt(np.diag(fit.covariance()))
    assert (np.abs(wide.mean().to_numpy() - fit.mode) < 5 * se / np.sqrt(2000)).all()
    np.testing.assert_allclose(wide.cov().to_numpy(), fit.covariance(), atol=6 * se.max() ** 2 / np.sqrt(2000))
    shares = lk.expected_shares(fit, df, draws.where("draw < 50"))
    assert shares.count() == 50 * 3 * 5
    assert shares.groupBy("draw", "g").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    b = wide.iloc[7]
    row = {r.category: r.p for r in shares.where("draw = 7 AND g = 'g1'").collect()}
    edges = [0, *sigmoid(b[["cut1", "cut2", "cut3", "cut4"]].to_numpy() - b["g=g1"]), 1]
    np.testing.assert_allclose([row[k] for k in range(1, 6)], np.diff(edges), atol=1e-12)


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(1, "a", 1), (2, "b", 2), (5, None, 3), (None, "a", 4), (3, "a", 5), (3, "b", 6)]
    df = spark.createDataFrame(rows, "n int, g string, y int")
    same = spark.createDataFrame([r for r in rows if r[0] and r[1]], "answer int, city string, id int")
    a, b = lk.fit_cumulative(df, "n", ["g"]), lk.fit_cumulative(same, "answer", ["city"])
    np.testing.assert_allclose(a.mode, b.mode)
    none = lk.fit_cumulative(df.limit(0), "n", ["g"])
    np.testing.assert_allclose(none.mode, PRIOR)
    assert lk.fit_cumulative(df, "n", [], group="g").effects.count() == 2


def test_pareto_tail():
    rng = np.random.default_rng(0)
    for shape in (0.2, 0.6):
        excess = np.sort((rng.uniform(size=20_000) ** -shape - 1) / shape * 2.0)
        k, scale = lk.tail_shape(excess)
        assert k == pytest.approx(shape, abs=0.04) and scale == pytest.approx(2.0, rel=0.06)


def test_leave_one_out(spark):
    """Scores agree with those of fits without each answer, integrated over their own draws."""
    pdf, _ = planted(n=60, seed=8)
    df = spark.createDataFrame(pdf)
    fit = lk.fit_cumulative(df, "y", ["g"])
    out = lk.leave_one_out(fit, df, "y", lk.posterior_draws(fit, 4000))
    got = {(r.g, r.y): r for r in out.collect()}
    assert sum(r.n for r in got.values()) == 60
    assert max(r.tail for r in got.values()) < 0.7
    mean, sd = np.append(PRIOR, [0, 0]), np.array([1, 1, 1, 1, 2.0, 2.0])
    rng, x = np.random.default_rng(3), dense(pdf, [("g", "g1"), ("g", "g2")])
    total = 0.0
    for (g, y), part in pdf.groupby(["g", "y"]):
        rest = np.delete(np.arange(60), part.index[0])
        mode, h = mode_of(x[rest], pdf.y.to_numpy()[rest], np.ones(59), mean, sd)
        b = rng.multivariate_normal(mode, np.linalg.inv(h), 4000)
        eta = b[:, 4:] @ x[part.index[0]]
        edges = np.column_stack([np.zeros(4000), sigmoid(b[:, :4] + eta[:, None]), np.ones(4000)])
        want = np.log((edges[:, y] - edges[:, y - 1]).clip(1e-300).mean())
        assert got[g, y].elpd == pytest.approx(want, abs=0.25)
        total += len(part) * (got[g, y].elpd - want)
    assert abs(total) < 1.0


def test_dispersion_is_recovered(spark):
    """Planted scales of three groups, and a score of 0 in every dispersion and common term."""
    rng = np.random.default_rng(4)
    n, disc = 12_000, np.array([0.5, 0.0, -0.5])
    g, city = rng.integers(0, 2, n), rng.integers(0, 3, n)
    latent = rng.logistic(size=n) / np.exp(disc)[city] + 0.7 * g
    y = 1 + (latent[:, None] > np.array([-1.2, -0.4, 0.5, 1.3])).sum(1)
    pdf = pd.DataFrame({"g": [f"g{i}" for i in g], "city": [f"c{i}" for i in city], "y": y.astype("int32")})
    fit, groups = lk.fit_dispersion(spark.createDataFrame(pdf), "y", ["g"], "city", dispersion_sd=1.0)
    got = {r.group: r for r in groups.collect()}
    d = np.array([got[f"c{k}"].disc for k in range(3)])
    np.testing.assert_allclose(d - d[1], disc, atol=0.08)
    assert all(0.005 < r.sd < 0.2 for r in got.values())
    assert fit.mode[4] * np.exp(d[1]) == pytest.approx(0.7, abs=0.1)

    def value(theta):
        eta, s = theta[4] * g, np.exp(theta[5:])[city]
        upper, lower = np.append(theta[:4], np.inf), np.append(-np.inf, theta[:4])
        p = sigmoid(s * (upper[y - 1] - eta)) - sigmoid(s * (lower[y - 1] - eta))
        return np.log(p).sum() - 0.5 * (((theta[:4] - PRIOR) ** 2).sum() + (theta[4] / 2) ** 2 + (theta[5:] ** 2).sum())

    theta = np.append(fit.mode, d)
    score = [(value(theta + 1e-4 * e) - value(theta - 1e-4 * e)) / 2e-4 for e in np.eye(8)]
    np.testing.assert_allclose(score, 0, atol=0.05)
    curve = om.logistic_curve(groups.withColumn("mu", F.lit(0.0)), "mu", "disc", -5, 5, 11)
    assert curve.count() == 33
