"""Every registered query against its SQL twin, and the shape of the plans."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from canvass.functions.columns import cols
from canvass.plans import views as v
from canvass.plans.catalog import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"]
# Draws, iterated fits and comparisons of fits: compared in test_likelihood.py and test_ordinal.py.
WITHOUT_SQL = {"M3_fit_intervals", "M4_fit_mean_category", "M7_fit_predictive_check", "M8_leave_one_out", "M10_dispersion", "M10_estimated_spread",
               "M11_chosen_slopes", "M11_proportional_odds"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def key(row):
    return [(x is None, f"{x:.9g}" if isinstance(x, float) else str(x)) for x in row]


def ordered(names, rows):
    place = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in place], sorted(([r[i] for i in place] for r in rows), key=key)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names, got = ordered(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    expected_names, expected = ordered([c[0] for c in cur.description], cur.fetchall())
    assert names == expected_names
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_query_but_the_fits_has_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["B2_census_tables", "B9_census_dashboard", "G6_percent_of_cases", "B7_answer_table"])
def test_respondents_are_read_once(spark, name):
    text = plan(QUERIES[name](spark, DIR))
    assert len(re.findall(r"FileScan parquet [^\n]*lineitem", text)) == 1
    assert len(re.findall(r"FileScan parquet [^\n]*orders", text)) == 1


# Queries on written tables do not show the plan that wrote them.
ONE_PLAN = [n for n in sorted(SQL) if n[0] != "S" and n not in ("U4_enrich_text", "W4_group_ids", "W5_batches", "O1_number_rows")]


@pytest.mark.parametrize("name", ONE_PLAN)
def test_no_python_and_no_cartesian_product(spark, name):
    text = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "Python" not in text and "Pandas" not in text


def test_rows_are_not_shuffled_again_to_be_numbered(spark):
    for name in ("O1_number_rows", "W5_batches"):
        df = QUERIES[name](spark, DIR)
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_views_group_in_hash_maps(spark):
    for view in (v.multi, v.battery, v.spending, v.census):
        assert "SortAggregate" not in plan(view(spark, DIR))


def test_filter_and_columns_reach_the_scan(spark):
    text = QUERIES["P4_keep_in"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text
    only = v.census(spark, DIR).select("id", "Q17_1")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in only


def test_properties(spark):
    cases = QUERIES["G6_percent_of_cases"](spark, DIR)
    responses = QUERIES["G7_percent_of_responses"](spark, DIR).withColumnRenamed("pct", "share")
    both = cases.join(responses.select("city", "value", "share"), ["city", "value"])
    assert both.where(F.col("pct") < F.col("share") - 1e-9).count() == 0
    tables = QUERIES["B2_census_tables"](spark, DIR)
    off = sum((F.col(f"`{c}`") for c in v.CITIES), F.lit(0))
    assert tables.where(off != F.col("Total")).count() == 0
    flags = QUERIES["D6_quality_flags"](spark, DIR)
    assert flags.where("screenout <> 1 - exclude").count() == 0
    answered = v.multi(spark, DIR)
    assert len(cols(answered).group("Q12")) == 6
