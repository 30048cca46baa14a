import random

from conftest import rows
from pyspark.sql import functions as F

from canvass.operators import codebook as cb
from canvass.operators import filters as f
from canvass.operators import quality, reshape
from canvass.plans.catalog import QUERIES


def names(spark):
    return spark.createDataFrame(
        [("live", "club"), ("live", "mytest"), ("live", None), ("preview", "club"), ("live", "x"), (None, "club")],
        "status string, name string")


def test_null_rules(spark):
    df = names(spark)
    assert f.keep_in(df, "name", ["club"]).count() == 3
    assert f.drop_in(df, "name", ["club"]).count() == 3  # null stays
    assert f.drop_matching(df, "name", "test").count() == 5  # null stays
    assert rows(f.drop_test_answers(df, "status", "live", "name", "test", ["x"])) == [("live", "club"), ("live", None)]


def test_answered_text_drops_blank_and_null(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "t string")
    assert rows(f.answered_text(df, "t")) == [("a",)]


def test_params_expand_total_and_drop_null_gender(spark):
    df = spark.createDataFrame([("A", "f"), ("A", None), ("B", "m"), ("C", "x")], "city string, gender string")
    params = f.SurveyParams(("A", "B", "C"), ("total",), ("f", "m"))
    assert rows(f.apply_params(df, params)) == [("A", "f"), ("B", "m")]
    everyone = f.SurveyParams(("A",), ("total",), ("f", "m"), ignore=("gender",))
    assert rows(f.apply_params(df, everyone)) == [("A", "f"), ("A", None)]


def test_quality_flags(spark):
    df = spark.createDataFrame(
        [(1, "2024-10-10", 30, "x"), (2, "2024-10-12", 30, "x"), (3, "2024-10-12", 100, "x"), (4, "2024-10-12", 30, None),
         (5, "2024-10-12", None, "x"), (6, "2024-10-12", 99, "x")],
        "id int, end string, age int, q string")
    flagged = quality.quality_flags(df.withColumn("end", df.end.cast("timestamp")), "end", "2024-10-11", "age", {"q": ["q"]})
    got = {r.id: (r.test, r.bad, r.exclude, r.screenout) for r in flagged.collect()}
    assert got == {1: (1, 0, 1, 0), 2: (0, 0, 0, 1), 3: (0, 1, 1, 0), 4: (0, 1, 1, 0), 5: (0, None, None, None),
                   6: (0, 0, 0, 1)}
    assert rows(quality.valid_responses(flagged).select("id")) == [(2,), (6,)]


def test_codebook_round_trip(spark, tmp_path):
    book = cb.Codebook.from_rows(
        spark, crosswalk=[("q24", "Q4")], levels=[("Q4", "Kyllä", "Yes", 1), ("Q4", "Ei", "No", 2)],
        questions=[("Q4", "Do you live here?")])
    book.save(str(tmp_path / "book"))
    back = cb.Codebook.load(spark, str(tmp_path / "book"))
    df = spark.createDataFrame([("a", "Kyllä"), ("b", "Ei"), ("b", "Maybe"), ("b", None)], "source string, q24 string")
    df = cb.rename_crosswalk(df, back)
    out = cb.harmonize_values(df, "Q4", back.changes("levels")["Q4"], "source", ["b"])
    assert rows(out) == [("a", "Kyllä", None), ("b", "Maybe", None), ("b", "No", 2), ("b", None, None)]
    labelled = cb.label_variables(out, back.questions())
    assert ("Q4", "Do you live here?") in rows(cb.variable_labels(labelled))


def test_decode_and_remap(spark):
    df = spark.createDataFrame([(1, "x"), (9, "y"), (None, None)], "code int, place string")
    assert rows(cb.decode(df, {"code": {1: "One"}}).select("code")) == [("9",), ("One",), (None,)]
    mapping = spark.createDataFrame([("eu", "place", "x", "X"), ("ua", "place", "y", "Y")],
                                    "dataset string, variable string, original string, mapped string")
    assert rows(cb.remap(df, mapping, "eu", ["place"]).select("place")) == [("X",), ("y",), (None,)]


def test_order_of_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("zz",)], "v string")
    assert [r.v for r in cb.ordered(df.where("v <> 'zz'"), {"v": ["c", "a", "b"]}, "v").collect()] == ["c", "a", "b"]
    assert {r.v: r.v_ord for r in cb.with_order(df, "v", ["c", "a"]).collect()} == {"b": None, "a": 2, "c": 1, "zz": None}


def test_large_dictionary_is_refused(spark):
    import pytest
    with pytest.raises(ValueError):
        cb.small_rows(spark.range(50), limit=10)


def test_option_strings(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "a,b"), (5, "a (x, y),b (z),c")], "id int, o string")
    plain = reshape.explode_options(df, "o")
    aware = reshape.explode_options(df, "o", paren_aware=True)
    assert [r.o for r in plain.where("id = 5").collect()] == ["a (x", " y)", "b (z)", "c"]
    assert [r.o for r in aware.where("id = 5").collect()] == ["a (x, y)", "b (z)", "c"]
    assert rows(aware.where("id < 5")) == [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "b")]


def test_nested_parentheses(spark):
    def split(text):
        """Separators that lie in no pair of matched parentheses, by a stack."""
        pairs, stack = [], []
        for i, c in enumerate(text):
            if c == "(":
                stack.append(i)
            elif c == ")" and stack:
                pairs.append((stack.pop(), i))
        cuts = [i for i, c in enumerate(text) if c == "," and not any(a < i < b for a, b in pairs)]
        return [text[a + 1: b] for a, b in zip([-1, *cuts], [*cuts, len(text)], strict=True)]

    rng = random.Random(4)
    texts = ["A (b, (c) d), e", "a (b, c", "a, b) c, d", "((,),),", ",", "()", "(a),(b,c),,d)", "x" * 5000 + ",(y," + "z" * 5000 + ")"]
    texts += ["".join(rng.choice("ab(),,()é\n") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, o string")
    got = {r.id: r.p for r in df.select("id", reshape.split_outside(F.col("o")).alias("p")).collect()}
    assert [got[i] for i in range(len(texts))] == [split(t) for t in texts]
    assert spark.range(1).select(reshape.split_outside(F.lit("a||(b||c)||d"), "||").alias("p")).first().p == ["a", "(b||c)", "d"]


def test_many_overlapping_bands(spark):
    rng = random.Random(9)
    bands = [(a, a + rng.choice([0, 1, 5, 300, 4000]), f"b{i}") for i, a in enumerate(rng.choices(range(-500, 5000), k=400))] + [(None, 3, "low"), (4990, None, "high")]
    values = [rng.choice([None, *range(-600, 5300, 7), 3, 3, 3]) for _ in range(500)]
    b = spark.createDataFrame(bands, "lo int, hi int, band string")
    v = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "id int, x long")
    got = sorted((r.id, r.band or "") for r in f.band_join(v, "x", b, "lo", "hi").collect())
    fits = lambda x, lo, hi: x is not None and (lo is None or lo <= x) and (hi is None or x <= hi)
    assert got == sorted((i, n) for i, x in enumerate(values) for n in ([n for lo, hi, n in bands if fits(x, lo, hi)] or [""]))


def test_long_code_list_is_joined(spark):
    df = spark.createDataFrame([(7, "a"), (900, "b"), (5000, "c"), (None, "d")], "code int, x string")
    out = cb.decode(df, {"code": {i: f"label {i}" for i in range(1000)}})
    assert out.columns == ["code", "x"]
    assert rows(out) == [("5000", "c"), ("label 7", "a"), ("label 900", "b"), (None, "d")]


def test_band_join_repeats_a_band_per_cell_of_ends(spark):
    bands = spark.createDataFrame([(0, 2_000_000, "wide"), (10, 19, "teens"), (15, None, "open"), (None, None, "any"), (9, 3, "none")],
                                  "lo long, hi long, band string")
    df = spark.createDataFrame([(None,), (-1,), (0,), (10,), (15,), (19,), (20,), (2_000_000,), (2_000_001,)], "x long")
    joined = f.band_join(df, "x", bands, "lo", "hi")
    inside = lambda x, lo, hi: x is not None and (lo is None or x >= lo) and (hi is None or x <= hi)
    table = [(None if b.lo is None else b.lo, b.hi, b.band) for b in bands.collect()]
    expected = []
    for (x,) in df.collect():
        expected += [(x, n) for lo, hi, n in table if inside(x, lo, hi)] or [(x, None)]
    got = [(r.x, r.band) for r in joined.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    empty = f.band_join(df, "x", bands.limit(0), "lo", "hi")
    assert empty.count() == 9 and empty.where("band IS NOT NULL").count() == 0


def test_long_dictionaries_are_joined_once(spark):
    n = 100_000
    codes = spark.range(n).selectExpr("'a' variable", "id code", "concat('A', id) label").unionByName(
        spark.range(n).selectExpr("'b' variable", "id code", "concat('B', id) label")).unionByName(
        spark.createDataFrame([("a", 7, "A0 twice"), ("other", 7, "x")], "variable string, code long, label string"))
    df = spark.createDataFrame([(7, 99_999, "k"), (7, None, None), (None, 3, "k"), (-1, 7, "k"), (7, 99_999, "k")], "a long, b int, original string")
    out = cb.label_codes(df, codes, ["a", "b"])
    assert out.columns == ["a", "b", "original"]
    assert rows(out) == sorted([("A0 twice", "B99999", "k"), ("A0 twice", None, None), (None, "B3", "k"), ("-1", "B7", "k"), ("A0 twice", "B99999", "k")],
                               key=lambda t: [(v is None, str(v)) for v in t])
    mapping = spark.createDataFrame([("s", "original", "k", "K2"), ("s", "original", "k", "K1"), ("t", "original", "k", "T")], "dataset string, variable string, original string, mapped string")
    assert [r[0] for r in rows(cb.remap(df, mapping, "s", ["original"]).select("original"))] == ["K1"] * 4 + [None]
    captions = spark.range(n).selectExpr("concat('Q', id) question", "concat('About ', id) caption")
    assert rows(cb.with_caption(spark.createDataFrame([("Q5",), ("none",)], "question string"), captions)) == [("Q5", "About 5"), ("none", None)]


def test_harmonize_sheet_agrees_with_literals(spark):
    df = spark.createDataFrame([("a", "Kyllä", "x", None), ("b", "Ei", None, 5), ("a", None, "y", 6), ("a", "Ei", "zz", 7)], "source string, Q4 string, Q5 string, Q5_code int")
    sheet = spark.createDataFrame([("Q4", "Kyllä", "Yes", 1), ("Q4", "Ei", "No", 2), ("Q5", "x", "X", 9), ("Q9", "a", "b", 1)], "variable string, `from` string, `to` string, value int")
    changes = cb.Codebook({"recodes": sheet}).changes("recodes")
    for source in ((None, None), ("source", ["a"])):
        want = cb.harmonize_all(df, changes, *source)
        assert rows(cb.harmonize_sheet(df, sheet, *source).select(want.columns)) == rows(want)


def test_sums_over_bands_equal_those_of_the_joined_rows(spark):
    rng = random.Random(11)
    bands = [(a, a + rng.choice([-2, 0, 1, 5, 300, 4000]), rng.choice([None, -7, 2**62, i])) for i, a in enumerate(rng.choices(range(-500, 5000, 3), k=400))]
    bands += [(None, 3, 10), (None, 3, 20), (4990, None, None), (None, None, 5), (None, None, None), (7000, 7001, None)]
    values = [rng.choice([None, *range(-600, 5300, 7), 3, 3, 3, 7000]) for _ in range(500)]
    b = spark.createDataFrame(bands, "lo long, hi long, points long")
    v = spark.createDataFrame(list(enumerate(values)), "id int, x long")
    sums = {"held": F.lit(1), "known": F.col("points").isNotNull().cast("int"), "points": F.col("points").cast("decimal(20,0)")}
    found = f.band_join(v, "x", b, "lo", "hi", sums=sums)
    assert found.columns == ["id", "x", *sums]
    for r in found.collect():
        fits = [p for lo, hi, p in bands if r.x is not None and (lo is None or lo <= r.x) and (hi is None or r.x <= hi) and not (lo is not None and hi is not None and lo > hi)]
        known = [p for p in fits if p is not None]
        assert (r.held, r.known, r.points) == ((len(fits), len(known), sum(known) if known else None) if fits else (None, None, None))
    assert found.count() == len(values)
    empty = f.band_join(v, "x", b.limit(0), "lo", "hi", sums=sums)
    assert empty.count() == 500 and empty.where("held IS NOT NULL OR points IS NOT NULL").isEmpty()


def test_interval_join_makes_no_row_per_value_and_band(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    # 2000 orders whose bands all begin at 0 and end within 50, some twice; 1500 lines, nearly all with one of 60 values from 0 on.
    orders = [100003 * k for k in range(1990)] + [100003 * k for k in range(10)]
    inverse = pow(13, -1, 100003)
    lines = [((x - k) * inverse % 100003, k) for x, k in ((rng.randrange(60), rng.randrange(1, 8)) for _ in range(1480))] + [(5, None)] * 10 + [(50000, 3)] * 10
    spark.createDataFrame([(o,) for o in orders], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    written = []

    def noted(df, name="table", write=f.materialize):
        written.append((name, (out := write(df, name)).count()))
        return out

    monkeypatch.setattr(f, "materialize", noted)
    got = {r.line: (r.n, r.matches, r.total) for r in QUERIES["J6_interval_join"](spark, str(tmp_path)).collect()}
    expected = {}
    for key, line in lines:
        x = None if line is None else (key * 13 + line) % 100003
        ids = [o for o in orders if x is not None and o * 7 % 100003 <= x <= o * 7 % 100003 + o % 50]
        n, matches, total = expected.get(line, (0, 0, None))
        expected[line] = (n + max(len(ids), 1), matches + len(ids), (total or 0) + sum(ids) if ids else total)
    assert got == expected
    assert sum(n for n, _, _ in got.values()) > 10**6
    assert max(n for _, n in written) <= len(orders) + len(lines), written
