import pytest
from conftest import rows

from canvass.plans import instruments as ins
from canvass.plans import reports as rp


def participation(spark):
    return spark.createDataFrame([
        ("Spain", "Male", "yes", "often", None, "x", 10.0, None), ("Spain", "Female", None, "never", "often", None, None, None),
        ("Italy", "Male", "no", None, None, "other", 4.0, 6.0), ("Italy", None, "no", "often", "often", None, 1.0, 1.0),
    ], "S0 string, S3 string, S9 string, S6_1 string, S6_2 string, S8_9t string, M29_1t double, M29_2t double")


def test_dashboard_counts_singles_and_batteries(spark):
    out = ins.dashboard(participation(spark), ins.PARTICIPATION, ("Spain", "All Countries"), item_texts={"S6_1": "Opera"})
    got = {(r.S0, r.question, r.item, r.value): (r.n, r.pct_cases) for r in out.collect()}
    assert got[("Spain", "S9", None, "yes")] == (1, 100.0)
    assert got[("Spain", "S6", "Opera", "often")] == (1, 50.0)
    assert got[("Spain", "S6", "S6_2", "often")] == (1, 50.0)
    assert got[("All Countries", "S9", None, "no")] == (1, 50.0)  # the unknown gender drops out
    assert not any(q == "S8" for _, q, _, _ in got)  # free text is not an answer
    assert {g for g, _, _, _ in got} == {"Spain", "All Countries"}


def test_spending_table(spark):
    out = ins.spending_table(participation(spark), ins.PARTICIPATION, "events per month", ("Spain", "Italy", "All Countries"))
    assert rows(out) == [("All Countries", 3, 20 / 3, 10.0), ("Italy", 1, 10.0, 10.0), ("Spain", 2, 5.0, 5.0)]


def test_unanswered_totals_drop_out(spark):
    df = participation(spark).withColumnsRenamed({"M29_1t": "M37_1t", "M29_2t": "M37_2t"})
    out = ins.spending_table(df, ins.PARTICIPATION, "listening per month", ("Spain", "All Countries"))
    assert rows(out) == [("All Countries", 2, 10.0, 10.0), ("Spain", 1, 10.0, 10.0)]


def test_strict_totals_drop_partly_answered(spark):
    df = spark.createDataFrame([("Lviv", "Male", 1.0, None), ("Lviv", "Male", 2.0, 3.0)], "City string, Q2 string, Q6_1 double, Q6_2 double")
    assert rows(ins.spending_table(df, ins.CENSUS, "total", ("Lviv",))) == [("Lviv", 1, 5.0, 5.0)]


def test_chosen_and_named_amounts(spark):
    df = spark.createDataFrame([
        ("Spain", "Male", 1.0, None, 5.0, 9.0), ("Spain", "Male", None, None, None, None), ("Italy", "Female", 2.0, 4.0, None, 1.0)],
        "S0 string, S3 string, M69_1t double, M69_2t double, M55 double, M36_2t double")
    table = lambda kind: rows(ins.spending_table(df, ins.PARTICIPATION, kind, ("Spain", "All Countries")))
    assert table("instruments per year") == [("All Countries", 2, 3.5, 3.5), ("Spain", 1, 1.0, 1.0)]
    assert table(["M69_1t"]) == [("All Countries", 2, 1.5, 1.5), ("Spain", 1, 1.0, 1.0)]
    assert table(["M69_1t", "M36_2t"]) == [("All Countries", 2, 6.5, 6.5), ("Spain", 1, 10.0, 10.0)]
    assert table("studies") == [("All Countries", 1, 5.0, 5.0), ("Spain", 1, 5.0, 5.0)]
    with pytest.raises(ValueError):
        table("total income")


def test_bases_of_all_question_groups(spark):
    p = ins.PARTICIPATION
    questions = {*p.batteries, *p.amounts}
    assert len(questions) == 40
    df = spark.createDataFrame([("Spain", "Male", *["x"] * 40), ("Italy", "Male", *[None] * 40), ("Spain", None, *["x"] * 40)],
                               ["S0", "S3", *sorted(questions)])
    assert rows(ins.answered_bases(df, p, ("Spain", "All Countries"))) == sorted(
        (g, q, 1) for g in ("Spain", "All Countries") for q in questions)


def test_grid_names():
    names = ins.grid_names()
    assert len(names) == 24
    assert (names["M34_1t"], names["M34_3t"], names["M34_4t"], names["M34_24t"]) == ("M34_1_1", "M34_1_3", "M34_2_1", "M34_8_3")


def test_wrangling_two_sources(spark):
    df = spark.createDataFrame([
        ("1", "2024-10-12", 1990, "Kyllä", "x"), ("2", "2024-10-12", 1900, "Kyllä", "x"), ("1", "2024-10-01", 1980, "Ei", "x"),
        ("2", "2024-10-20", 2010, "Ei", None), ("9", "2024-10-20", 2010, "Ei", "x"), ("2", "2024-10-20", 2000, "Ei", "x"),
    ], "Q24 string, EndDate string, Q3 int, Q4 string, Q8_1 string")
    out = rp.wrangle(
        df.withColumn("end_date", df.EndDate.cast("timestamp")), "Q24", {"1": "man", "2": "heide"}, {"Q3": "birth_year"},
        {"Q4": [("Kyllä", "Yes", 1)]}, ["man"], {"Q4": [("Ei", "No", 2)]}, ins.SNAPSHOT_DAY, {"Q8": ["Q8_1"]})
    kept = rp.quality.valid_responses(out).select("source", "age", "age_group", "Q4", "Q4_code")
    assert rows(kept) == [("heide", 24, "18-29", "No", 2), ("man", 34, "30-39", "Yes", 1)]


def test_reports_on_a_small_table(spark):
    df = spark.createDataFrame([("A", "x", 1994, "r", 3.0), ("B", "y", 2001, None, 0.0), ("A", "x", 1990, "r", None)],
                               "city string, Q4 string, year int, Q8_1 string, Q6_1 double")
    table = rp.venue_tables(df, "city", {"Q4": ["Q4"], "Q8": ["Q8_1"]}, "year", ["A", "B"])
    assert rows(table) == [("Q4", "x", 2, 0), ("Q4", "y", 0, 1), ("Q8", "r", 2, 0), ("decade", "1990-1999", 2, 0), ("decade", "2000-2009", 0, 1)]
    report = rp.report(df, ["A"], {"Q4": ["Q4"]}, ["Q6_1"])
    assert rows(report["sample"]) == [("A", 2)] and rows(report["mean_spend"]) == [("A", 3.0)]
    assert rows(rp.gender_shares(df, "city", "Q4", ["x", "y"])) == [("A", "x", 1.0), ("B", "y", 1.0)]
