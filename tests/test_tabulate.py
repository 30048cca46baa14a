import pytest
from conftest import rows
from pyspark.sql import functions as F

from canvass.operators import reshape as rs
from canvass.operators import tabulate as t
from canvass.plans import instruments, reports

SCHEMA = "id int, city string, Q12_1 string, Q12_2 string, Q5 string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([
        (1, "A", "rock", "jazz", "yes"), (2, "A", "rock", None, "no"), (3, "A", None, None, None),
        (4, "B", None, "jazz", "yes"), (5, None, "rock", "jazz", "no"), (6, "B", None, "jazz", "")], SCHEMA)


def test_multi_response_bases(people):
    cases = {(r.city, r.value): (r.n, r.base, r.pct) for r in t.multi_freq(people, ["city"], ["Q12_1", "Q12_2"], "cases").collect()}
    assert cases == {("A", "rock"): (2, 2, 100.0), ("A", "jazz"): (1, 2, 50.0), ("B", "jazz"): (2, 2, 100.0)}
    ticks = {(r.city, r.value): r.base for r in t.multi_freq(people, ["city"], ["Q12_1", "Q12_2"], "responses").collect()}
    assert ticks == {("A", "rock"): 3, ("A", "jazz"): 3, ("B", "jazz"): 2}


def test_tally_counts_every_question_once(people):
    got = {(r.city, r.question, r.value): (r.n, r.answered, r.responses)
           for r in t.tally(people, ["city"], {"Q12": ["Q12_1", "Q12_2"], "Q5": ["Q5"]}, "All").collect()}
    assert got[("All", "Q12", "rock")] == (3, 4 + 1, 7)  # the respondent without a city counts in All
    assert got[("All", "Q5", "")] == (1, 5, 5)
    assert got[("A", "Q5", "yes")] == (1, 2, 2)
    assert all(city is not None for city, _, _ in got)


def test_totals_and_a_null_city(spark):
    df = spark.createDataFrame(
        [("A", "x"), ("A", "y"), ("B", "x"), (None, "x"), ("B", None), (None, None)], "city string, q string")
    counts = t.crosstab(df, ["city"], "q")
    assert rows(counts) == [("A", "x", 1), ("A", "y", 1), ("B", "x", 1)]
    with_total = rs.with_totals(counts, "city", ["q"])
    assert ("Total", "x", 2) in rows(with_total)
    assert ("All", "x", 3) in rows(t.crosstab(df, ["city"], "q", all_token="All"))
    raw = df.groupBy("city", "q").count().withColumnRenamed("count", "n")
    nulls = rs.with_totals(raw, "city", ["q"]).where("city is null and q = 'x'")
    assert rows(nulls) == [(None, "x", 1)]


def test_percentages_add_up(people):
    counts = t.crosstab(people, ["city"], "Q5")
    within = t.pct_within(counts, ["city"]).groupBy("city").agg(F.sum("pct").alias("s")).collect()
    assert all(r.s == pytest.approx(100) for r in within)
    assert t.pct_overall(counts).agg(F.sum("pct")).first()[0] == pytest.approx(100)
    assert t.freq(people, "Q5").agg(F.sum("pct")).first()[0] == pytest.approx(100)


def test_rates_and_counts(people):
    groups = {"Q12": ["Q12_1", "Q12_2"], "Q5": ["Q5"]}
    counts = {r.city: (r.Q12, r.Q5) for r in t.answered_counts(people, ["city"], groups).collect()}
    assert counts == {"A": (2, 2), "B": (2, 2), None: (1, 1)}
    rates = {r.city: r.Q12 for r in t.response_rate(people, ["city"], groups).collect()}
    assert rates["A"] == pytest.approx(200 / 3)


def test_battery_keeps_item_texts(people):
    got = t.battery(people, ["city"], {"Q12_1": "First", "Q12_2": "Second"}).collect()
    assert {(r.city, r.item, r.n, r.base) for r in got} == {("A", "First", 2, 2), ("A", "Second", 1, 2), ("B", "Second", 2, 2)}


def test_round_trip_long_wide(people):
    long = rs.to_long(people, ["id"], ["Q12_1", "Q12_2"])
    back = rs.to_wide(long, ["id"], "question", "value", ["Q12_1", "Q12_2"], F.first)
    assert rows(back) == rows(people.select("id", "Q12_1", "Q12_2"))
    assert long.where("value is null").count() == 5


def test_transpose_twice(spark):
    df = spark.createDataFrame([("A", 1, 2), ("B", 3, None)], "city string, x int, y int")
    once = rs.transpose(df, "city", ["A", "B"])
    assert rows(once) == [("x", 1, 3), ("y", 2, None)]
    assert rows(rs.transpose(once, "name", ["x", "y"], "city")) == rows(df)


def test_wide_measures_are_interleaved(spark):
    df = spark.createDataFrame([("A", "Q1", 1, 10.0), ("B", "Q1", 2, 20.0)], "city string, question string, n int, p double")
    wide = rs.to_wide_measures(df, ["question"], "city", {"n": "n", "%": "p"}, ["A", "B"])
    assert wide.columns == ["question", "A_n", "A_%", "B_n", "B_%"]
    sizes = spark.createDataFrame([("A", 7), ("B", 9)], "city string, n int")
    assert rows(rs.append_sample_row(wide, sizes, "city", ["A", "B"])) == [
        ("Q1", 1, 10.0, 2, 20.0), ("Sample Size", 7, None, 9, None)]


def test_grid(spark):
    df = spark.createDataFrame([(1, 5.0, None, 7.0)], "id int, M34_1_1 double, M34_1_2 double, M34_2_1 double")
    long = rs.grid_to_long(df, ["id"], "M34", [1, 2], [1, 2])
    assert rows(long) == [(1, 1, 1, 5.0), (1, 2, 1, 7.0)]
    assert rows(rs.grid_cell(long, 2, 1)) == [(1, 2, 1, 7.0)]
    assert rs.grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).count() == 6
    assert [r.x for r in rs.expand_seq(spark.range(1), 0, 1, 3).orderBy("x").collect()] == [0.0, 0.5, 1.0]


def test_a_group_called_like_the_total(spark):
    df = spark.createDataFrame([("Total", "x"), ("A", "x"), ("A", "y")], "city string, q string")
    out = reports.crosstab_tables(df, "city", {"q": ["q"]}, ["Total", "A"])
    assert out.columns == ["question", "value", "Total", "A", "Total (all)"]
    assert rows(out) == [("q", "x", 1, 1, 2), ("q", "y", 0, 1, 1)]
    census = instruments.Instrument(group="city", all_token="Total", singles=("q",))
    got = rows(instruments.dashboard(df, census, ("Total",)).select("value", "n", "pct_cases"))
    assert got == [("x", 1, 100.0), ("x", 2, 200 / 3), ("y", 1, 100 / 3)]


def test_venue_options_in_order(spark):
    df = spark.createDataFrame([("A", "Monday,Everyday", "Club", "IP Address"), ("A", "Friday", "test", "IP Address"), ("A", "Friday", "x", "IP Address"), ("A", "Friday", "Bar", "Preview")],
                               "City string, days string, Q21_1 string, Status string")
    out = reports.venue_options(df, instruments.PRE_SNAPSHOT, "days", instruments.WEEKDAYS)
    assert rows(out.select("City", "option", "n", "option_ord")) == [("A", "Everyday", 1, 8), ("A", "Monday", 1, 1)]
