import math

import pytest
from pyspark.sql import functions as F

from canvass.functions import scalars as s
from canvass.operators import filters as f

EDGES = [17, 18, 29, 30, 39, 40, 49, 50, 59, 60, 64, 65, 69, 70, 99, 100, None]


def test_band_edges(spark):
    df = spark.createDataFrame([(a,) for a in EDGES], "a int")
    got = df.select(*[s.age_band("a", k).alias(k) for k in ("seven", "adults", "broad")]).collect()
    seven = ["0-17", "18-29", "18-29", "30-39", "30-39", "40-49", "40-49", "50-59", "50-59", "60-69", "60-69", "60-69",
             "60-69", "70+", "70+", "70+", None]
    broad = ["<18", "18-29", "18-29", "30-49", "30-49", "30-49", "30-49", "50-64", "50-64", "50-64", "50-64",
             ">64", ">64", ">64", ">64", ">64", None]
    assert [r.seven for r in got] == seven
    assert [r.adults for r in got] == [None, *seven[1:]]
    assert [r.broad for r in got] == broad


def test_band_join_agrees_with_bands(spark):
    df = spark.createDataFrame([(a,) for a in [*EDGES, -5, 3000]], "a int")
    bands = spark.createDataFrame([list(b) for b in s.AGE_BANDS["seven"]], "lo int, hi int, band string")
    for width in (1, 7, 10, 500):
        joined = f.band_join(df, "a", bands, "lo", "hi", width).select("a", "band", s.age_band("a").alias("expected"))
        assert joined.where(~F.col("band").eqNullSafe(F.col("expected"))).count() == 0
        assert joined.count() == len(EDGES) + 2


def test_decade(spark):
    df = spark.createDataFrame([(1990,), (1999,), (2000,), (None,)], "y int")
    assert [r[0] for r in df.select(s.decade("y")).collect()] == ["1990-1999", "1990-1999", "2000-2009", None]


def test_row_totals(spark):
    df = spark.createDataFrame(
        [(None, None), (1.0, None), (0.0, 0.0), (2.0, 3.0)], "a double, b double")
    strict = [r[0] for r in df.select(s.row_total(["a", "b"])).collect()]
    lenient = [r[0] for r in df.select(s.row_total(["a", "b"], strict=False)).collect()]
    dropped = [r[0] for r in f.answered_any(df, ["a", "b"]).select(s.row_total(["a", "b"], strict=False)).collect()]
    assert strict == [None, None, 0.0, 5.0]
    assert lenient == [0.0, 1.0, 0.0, 5.0]
    assert dropped == [1.0, 0.0, 5.0]


@pytest.mark.parametrize("n, total, label", [
    (1, 3, "1 (33.3%)"), (2, 3, "2 (66.7%)"), (1, 8, "1 (12.5%)"), (1, 16, "1 (6.3%)"), (4, 4, "4 (100%)"), (0, 5, "0 (0%)")])
def test_pct_label(spark, n, total, label):
    df = spark.createDataFrame([(n, total)], "n bigint, t bigint")
    assert df.select(s.pct_label("n", "t")).first()[0] == label


def test_flags_follow_three_valued_logic(spark):
    df = spark.createDataFrame([(None, True), (None, False), (True, None), (False, None)], "a boolean, b boolean")
    assert [r[0] for r in df.select(s.as_flag(F.col("a") | F.col("b"))).collect()] == [1, None, 1, None]


def test_logistic_density_and_logit(spark):
    row = spark.range(1).select(
        s.logistic_density(F.lit(1.0), F.lit(0.5), F.lit(2.0)), s.logit(F.lit(0.2)), s.logit(F.lit(1.0))).first()
    e = math.exp(-0.25)
    assert row[0] == pytest.approx(e / (2 * (1 + e) ** 2))
    assert row[1] == pytest.approx(-1.3862943611)
    assert row[2] is None
