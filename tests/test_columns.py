from pyspark.sql import functions as F

from canvass.functions import columns as c


def wide(spark):
    return spark.createDataFrame([(1, 2, 3, 4, 5), (6, 7, 8, 9, 10)], "Q1 int, Q1_1 int, Q10 int, Q11 int, other int")


def test_group_does_not_take_longer_numbers(spark):
    df = wide(spark)
    assert c.cols(df).group("Q1").names == ["Q1", "Q1_1"]
    assert c.question_groups(df, ["Q1", "Q10", "Q2"]) == {"Q1": ["Q1", "Q1_1"], "Q10": ["Q10"]}


def test_selectors(spark):
    s = c.cols(wide(spark))
    assert s.prefix("Q1").minus("Q10").names == ["Q1", "Q1_1", "Q11"]
    assert s.suffix("1").names == ["Q1", "Q1_1", "Q11"]
    assert s.contains("the").names == ["other"]
    assert s.matches(r"^Q\d+$").names == ["Q1", "Q10", "Q11"]
    assert s.numbered("Q", 5, 30).names == ["Q10", "Q11"]
    assert (s.prefix("o") | s.group("Q1")).names == ["other", "Q1", "Q1_1"]


def test_renaming(spark):
    df = wide(spark)
    assert c.rename_map(df, {"Q1": "a", "zz": "b"}).columns[0] == "a"
    assert c.suffix_columns(df, "_n", ["other"]).columns == ["Q1_n", "Q1_1_n", "Q10_n", "Q11_n", "other"]
    assert c.rename_regex(df, r"_(\d)$", r"-\1").columns[1] == "Q1-1"
    assert c.drop_columns(df, ["other", "absent"], contains="_").columns == ["Q1", "Q10", "Q11"]
    assert c.names_glue("{City}_{measure}", City="Lviv", measure="n") == "Lviv_n"


def test_typed_projections(spark):
    df = spark.createDataFrame([(True, 1.256, "a"), (False, None, "b"), (None, 2.0, None)], "x boolean, y double, z string")
    assert [r.x for r in c.true_or_null(df).collect()] == [1, None, None]
    assert [r.y for r in c.round_where(df, 1).collect()] == [1.3, None, 2.0]
    assert c.cast_where(df, lambda t: t.simpleString() == "string", F.upper).collect()[0].z == "A"
