import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from canvass.functions.quantiles import exact_quantiles, weighted_values
from canvass.functions.ranking import group_ids, number_rows
from canvass.operators import numeric as nm
from canvass.operators.text import batches

PROBS = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


@pytest.fixture(scope="module")
def amounts(spark):
    """Groups of very different shape; one holds most of the rows."""
    rng = np.random.default_rng(7)
    parts = {
        "hot": np.round(rng.lognormal(3, 2, 6000), 2), "signed": rng.normal(0, 1e-3, 900), "constant": np.full(50, 7.0),
        "zeros": np.concatenate([np.zeros(99), [5.0]]), "one": np.array([3.5]), "two": np.array([-2.0, 8.0]),
        "huge": np.array([1e-300, 1.0, 1e300, 2.0, -1e300]), "powers": 2.0 ** np.arange(-40, 40),
        "close": 1.7e9 + np.arange(500) / 1024,
    }
    return pd.concat([pd.DataFrame({"g": g, "x": x}) for g, x in parts.items()], ignore_index=True)


def test_exact_quantiles(spark, amounts):
    got = exact_quantiles(weighted_values(spark.createDataFrame(amounts), ["g"], "x"), ["g"], PROBS).collect()
    assert {r.g for r in got} == set(amounts.g)
    for r in got:
        x = amounts[amounts.g == r.g].x
        assert r.n == len(x)
        np.testing.assert_allclose(r.quantiles, np.quantile(x, PROBS), rtol=1e-12, atol=1e-15)


def test_quantiles_of_weighted_values_and_without_groups(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 1)], "x double, w int")
    counts = weighted_values(df, [], "x", weight="w")
    assert exact_quantiles(counts, [], [0.5]).first().quantiles == [1.0]


def test_spend_summary(spark):
    df = spark.createDataFrame(
        [("A", 1.0), ("A", 2.0), ("A", 9.0), ("B", 4.0), ("B", None), (None, 100.0)], "city string, total double")
    exact = rows(nm.spend_summary(df, "city", "total", "All"))
    assert exact == [("A", 3, 4.0, 2.0), ("All", 5, 23.2, 4.0), ("B", 1, 4.0, 4.0)]
    sketch = rows(nm.spend_summary(df, "city", "total", "All", approximate=True))
    assert [r[:3] for r in sketch] == [r[:3] for r in exact]


def test_means_of_positive_amounts(spark):
    df = spark.createDataFrame([("A", 0.0), ("A", 4.0), ("A", None), ("B", 0.0)], "city string, x double")
    assert rows(nm.mean_by(df, "city", ["x"])) == [("A", 2.0), ("B", 0.0)]
    assert rows(nm.mean_positive_by(df, "city", ["x"])) == [("A", 4.0), ("B", None)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([("A", float(x)) for x in (0, 1, 2, 3, 4, 4)] + [("B", 2.5)], "city string, x double")
    got = nm.histogram(df, ["city"], "x", bins=5, density=True).orderBy("city", "bin").collect()
    a = [r.n for r in got if r.city == "A"]
    assert a == [1, 1, 1, 1, 2]  # width 1, centred on whole numbers
    assert [r.n for r in got if r.city == "B"] == [0, 0, 1, 0, 0]  # 2.5 closes the bin around 2
    assert sum(r.density * (r.xmax - r.xmin) for r in got if r.city == "A") == pytest.approx(1)


def test_histogram_limits_weights_and_single_value(spark):
    df = spark.createDataFrame([("A", float(x), 10) for x in range(11)], "city string, x double, n int")
    assert sum(r.n for r in nm.histogram(df, ["city"], "x", bins=3, lo=2, hi=4).collect()) == 3
    assert sum(r.n for r in nm.histogram(df, ["city"], "x", bins=4, weight="n").collect()) == 110
    same = spark.createDataFrame([("A", 5.0)] * 3, "city string, x double")
    assert sum(r.n for r in nm.histogram(same, ["city"], "x", bins=4).collect()) == 3


def test_density_agrees_with_direct_sum(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(10, 2, 400), rng.normal(20, 1, 100)])
    got = nm.density(spark.createDataFrame(pd.DataFrame({"g": "a", "x": x})), ["g"], "x", points=50).orderBy("point").toPandas()
    iqr = np.quantile(x, 0.75) - np.quantile(x, 0.25)
    bw = 0.9 * min(x.std(ddof=1), iqr / 1.34) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 50)
    direct = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got.x, grid)
    np.testing.assert_allclose(got.density, direct, atol=2e-5)


def test_density_of_a_narrow_group_beside_an_outlier(spark):
    rng = np.random.default_rng(4)
    groups = {"small": rng.normal(5, 1, 300), "wide": np.append(rng.normal(500, 80, 300), 1e6), None: rng.normal(40, 3, 50)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, x double")
    lo, hi = min(x.min() for x in groups.values()), max(x.max() for x in groups.values())
    for points in (40, 4000):
        got = nm.density(df, ["g"], "x", points=points).toPandas()
        assert len(got) == 3 * points
        grid = np.linspace(lo, hi, points)
        for g, x in groups.items():
            bw = 0.9 * min(x.std(ddof=1), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34) * len(x) ** -0.2
            direct = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
            mine = got[got.g.isna() if g is None else got.g == g].sort_values("point")
            np.testing.assert_allclose(mine.density, direct, rtol=2e-3, atol=1e-5 / bw)
    one = nm.density(spark.createDataFrame([("a", 3.0)] * 4, "g string, x double"), ["g"], "x", points=3).collect()
    assert len(one) == 3 and all(r.x == 3 and r.density > 0 for r in one)


def test_row_numbers_with_a_hot_group(spark):
    pdf = pd.DataFrame({"g": ["hot"] * 5000 + ["a", "b", None, None] * 100})
    pdf["k"] = np.random.default_rng(1).permutation(len(pdf))
    got = number_rows(spark.createDataFrame(pdf, "g string, k bigint").repartition(8), ["g"], ["k"]).toPandas()
    expected = got.sort_values("k").groupby("g", dropna=False).cumcount() + 1
    assert (got.row == expected.reindex(got.index)).all()
    assert len(got) == len(pdf)


def test_batches_and_group_ids(spark):
    df = spark.createDataFrame([("en", i) for i in range(12)] + [("fi", 1)], "lang string, id int")
    sizes = batches(df, ["lang"], ["id"], 5).groupBy("lang", "batch").count()
    assert rows(sizes) == [("en", 1, 5), ("en", 2, 5), ("en", 3, 2), ("fi", 1, 1)]
    texts = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "t string")
    assert rows(group_ids(texts, "t")) == [("a", 1), ("b", 2), ("b", 2), (None, None)]


def test_economic_table(spark):
    df = spark.createDataFrame(
        [("X", "Merchandise", 26.94, 70.0, 1885.86), ("X", "Tickets", 53.97, 70.0, 3778.03), ("Y", "Tickets", 15.0, 12.2, 183.04)],
        "country string, category string, expense double, visits double, yearly double")
    out = nm.economic_table(df, "country", "expense", "visits", "yearly")
    assert out.where(F.abs("gap") > 0.131).count() == 0
    assert {r.country: round(r.country_total, 2) for r in out.collect()} == {"X": 5663.89, "Y": 183.04}


def test_fractional_weights_are_not_cut(spark):
    from canvass.operators import numeric
    df = spark.createDataFrame([("a", 0.0, 0.5), ("a", 10.0, 0.5), ("a", 10.0, 0.25)], "g string, x double, w double")
    assert sum(r.n for r in numeric.histogram(df, ["g"], "x", bins=5, weight="w").collect()) == 1.25


def test_long_lists_and_repeated_codes(spark):
    from canvass.operators import codebook
    df = spark.createDataFrame([(str(i),) for i in range(700)], "code string")
    got = codebook.decode(df, {"code": {str(i): f"label {i}" for i in range(650)}}).collect()
    assert got[3].code == "label 3" and got[699].code == "699"
    twice = spark.createDataFrame([("code", "1", "b"), ("code", "1", "a")], "variable string, code string, label string")
    out = codebook.label_codes(df, twice, ["code"]).collect()
    assert len(out) == 700 and "a" in {r.code for r in out}


def test_quantiles_of_fractional_weights_and_infinities(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 0.25), ("a", 2.0, 0.25), ("a", 3.0, 0.5), ("b", 7.0, 0.1), ("c", 1.0, 0.2), ("c", 5.0, 0.7), ("c", 9.0, 0.0), ("c", 8.0, None)],
        "g string, x double, w double")
    got = {r.g: r.quantiles for r in exact_quantiles(weighted_values(df, ["g"], "x", "w"), ["g"], [0.0, 0.2, 0.4, 1.0]).collect()}
    assert got == {"a": [1.0, 1.0, 2.0, 3.0], "b": [7.0] * 4, "c": [1.0, 1.0, 5.0, 5.0]}
    inf = float("inf")
    ends = spark.createDataFrame([("l", -inf), ("l", 1.0), ("h", 1.0), ("h", inf), ("s", inf), ("s", inf)], "g string, x double")
    assert rows(exact_quantiles(weighted_values(ends, ["g"], "x"), ["g"], [0.5]).select("g", "quantiles")) == [
        ("h", [inf]), ("l", [-inf]), ("s", [inf])]


def test_totals_of_a_group_named_like_the_total(spark):
    from canvass.operators import reshape, tabulate
    df = spark.createDataFrame([("All", 3.0), ("A", 1.0), ("A", 5.0)], "city string, total double")
    assert rows(nm.spend_summary(df, "city", "total", "All")) == [("A", 2, 3.0, 3.0), ("All", 1, 3.0, 3.0), ("All", 3, 3.0, 3.0)]
    counts = spark.createDataFrame([("Total", "x", 3), ("A", "x", 2)], "g string, q string, n int")
    assert rows(reshape.with_totals(counts, "g", ["q"], mark="all")) == [
        ("A", False, "x", 2), ("Total", False, "x", 3), ("Total", True, "x", 5)]
    told = tabulate.tally(df, ["city"], {"q": ["total"]}, "All").where("value = '3.0'")
    assert rows(told.select("city", "n", "answered")) == [("All", 1, 1), ("All", 1, 3)]


def test_the_source_of_amounts_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b
    df = spark.range(100).selectExpr("cast(id % 3 as string) g", "cast(id as double) x").mapInPandas(count, "g string, x double")
    nm.spend_summary(df, "g", "x", "All").collect()
    assert read.value == 100
    nm.density(df, ["g"], "x", points=8).collect()
    assert read.value == 200


def test_tiny_and_huge_weights_count(spark):
    for scale in (1e-10, 1.0, 1e14):
        df = spark.createDataFrame([(1.0, 1.0 * scale), (2.0, 1.5 * scale), (3.0, 1.0 * scale), (9.0, 0.0)], "x double, w double")
        out = exact_quantiles(weighted_values(df, [], "x", "w"), [], [0.0, 0.5, 0.99]).first()
        assert list(out.quantiles) == [1.0, 2.0, 3.0]
        assert float(out.n) == pytest.approx(3.5 * scale)
