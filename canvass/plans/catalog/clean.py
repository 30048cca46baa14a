"""Column selection, filters, derived columns and quality flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions import columns as c
from canvass.functions import scalars as s
from canvass.operators import codebook as cb
from canvass.operators import filters as f
from canvass.operators import quality
from canvass.operators import reshape
from canvass.operators.tabulate import response_rate, sample_size, tally
from canvass.plans import views as v
from canvass.plans.catalog import registry as r
from canvass.plans.catalog.registry import query

MULTI_COLUMNS = ", ".join(v.MULTI)


@query("P1_select_columns", f"WITH {r.MULTI} SELECT id, Q12_1, Q12_2, Q12_3, Q12_5, Q12_6 FROM multi")
def select_columns(spark, d):
    df = v.multi(spark, d)
    return df.select("id", *c.cols(df).group("Q12").minus("Q12_4"))


@query("P2_rename", f"WITH {r.RESPONDENTS} SELECT id, city place_new, segment group_new, rating Q11_new FROM respondents")
def rename(spark, d):
    df = v.respondents(spark, d).select("id", "city", "segment", "rating")
    df = c.rename_map(df, {"city": "place", "absent": "x"})
    df = c.rename_all(df, ["id", "place", "group", "Q11"])
    return c.suffix_columns(df, "_new", ["id"])


@query("P2_rename_crosswalk", "SELECT o_orderkey id, o_orderpriority Q4, o_orderstatus FROM orders")
def rename_crosswalk(spark, d):
    book = cb.Codebook.from_rows(
        spark, crosswalk=[("o_orderkey", "id"), ("o_orderpriority", "Q4"), ("not_there", "Q5")], levels=[("Q4", "1-URGENT", "high", 1)])
    return cb.rename_crosswalk(v.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), book)


@query("P3_drop_columns", f"WITH {r.RESPONDENTS} SELECT id, city, country, segment, rating FROM respondents")
def drop_columns(spark, d):
    return c.drop_columns(v.respondents(spark, d), ["end_date", "no_such_column", "gender_code"], contains="birth")


@query("P4_keep_in", "SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '3-MEDIUM') IN ('1-URGENT', '2-HIGH')")
def keep_in(spark, d):
    df = v.table(spark, d, "orders").withColumn("p", F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")))
    return f.keep_in(df, "p", ["1-URGENT", "2-HIGH"]).select("o_orderkey")


@query("P4_drop_in", """SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') p FROM orders
  WHERE nullif(o_orderpriority, '3-MEDIUM') IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def drop_in(spark, d):
    df = v.table(spark, d, "orders").withColumn("p", F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")))
    return f.drop_in(df, "p", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "p")


@query("P5_drop_test_answers", """SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
  AND (nullif(c_name, 'Customer#000000007') IS NULL
       OR (NOT regexp_matches(c_name, '99$') AND c_name NOT IN ('Customer#000000010', 'Customer#000000020')))""")
def drop_test_answers(spark, d):
    df = v.table(spark, d, "customer").withColumn("c_name", F.nullif(F.col("c_name"), F.lit("Customer#000000007")))
    return f.drop_test_answers(
        df, "c_mktsegment", "BUILDING", "c_name", "99$", ["Customer#000000010", "Customer#000000020"]).select("c_custkey")


@query("P6_answered_text", f"WITH {r.OPEN_TEXT} SELECT id, lang, answer FROM open_text WHERE answer <> ''")
def answered_text(spark, d):
    return f.answered_text(v.open_text(spark, d), "answer").select("id", "lang", "answer")


@query("P6_text_answer_rate", f"""WITH {r.OPEN_TEXT} SELECT lang, count(nullif(answer, '')) * 100e0 / count(*) answer FROM open_text GROUP BY 1""")
def text_answer_rate(spark, d):
    return response_rate(f.blank_as_missing(v.open_text(spark, d), ["answer"]), ["lang"], {"answer": ["answer"]})


@query("P7_complete_cases", f"""WITH {r.RESPONDENTS} SELECT id, gender_code, birth_year FROM respondents
  WHERE gender_code IS NOT NULL AND birth_year IS NOT NULL""")
def complete_cases(spark, d):
    return f.complete_cases(v.respondents(spark, d).select("id", "gender_code", "birth_year"))


@query("P8_apply_params", f"""WITH {r.RESPONDENTS} SELECT id, city, gender_code FROM respondents
  WHERE city IN ('ASIA', 'AFRICA') AND gender_code IN (1, 2, 3)""")
def apply_params(spark, d):
    params = f.SurveyParams(("ASIA", "AFRICA"), ("total",), (1, 2, 3), "city", "gender_code")
    return f.apply_params(v.respondents(spark, d), params).select("id", "city", "gender_code")


@query("P9_filter_or_all", f"""WITH {r.POPULATION} SELECT 'chosen' kind, city, segment, n FROM population WHERE city = 'ASIA'
  UNION ALL SELECT 'all', city, segment, n FROM population""")
def filter_or_all(spark, d):
    table = v.population(spark, d)
    chosen = f.filter_or_all(table, "city", ["ASIA"], "All").withColumn("kind", F.lit("chosen"))
    return chosen.unionByName(f.filter_or_all(table, "city", ["ASIA", "All"], "All").withColumn("kind", F.lit("all")))


@query("P10_any_answered", f"""WITH {r.MULTI} SELECT id, coalesce(Q12_1, Q12_2, Q12_3) IS NOT NULL any_answered,
  coalesce(Q12_4, Q12_5, Q12_6) IS NULL all_missing FROM multi""")
def any_answered(spark, d):
    return v.multi(spark, d).select(
        "id", s.any_answered(v.MULTI[:3]).alias("any_answered"), s.all_missing(v.MULTI[3:]).alias("all_missing"))


@query("P11_split_tag", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Mannheim' WHEN 'O' THEN 'Heidelberg' END source
  FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def split_tag(spark, d):
    return f.split_tag(v.table(spark, d, "orders"), "o_orderstatus", {"F": "Mannheim", "O": "Heidelberg"}).select(
        "o_orderkey", "source")


@query("D1_age", f"WITH {r.RESPONDENTS} SELECT id, 2024 - birth_year age FROM respondents")
def age(spark, d):
    return v.respondents(spark, d).select("id", s.age("birth_year", 2024).alias("age"))


@query("D2_age_bands", f"""WITH {r.RESPONDENTS} SELECT id, CASE WHEN a < 18 THEN '0-17' WHEN a < 30 THEN '18-29' WHEN a < 40 THEN '30-39'
  WHEN a < 50 THEN '40-49' WHEN a < 60 THEN '50-59' WHEN a < 70 THEN '60-69' WHEN a >= 70 THEN '70+' END seven,
  CASE WHEN a < 18 THEN NULL WHEN a < 30 THEN '18-29' WHEN a < 40 THEN '30-39'
  WHEN a < 50 THEN '40-49' WHEN a < 60 THEN '50-59' WHEN a < 70 THEN '60-69' WHEN a >= 70 THEN '70+' END adults,
  CASE WHEN a < 18 THEN '<18' WHEN a < 30 THEN '18-29' WHEN a < 50 THEN '30-49' WHEN a < 65 THEN '50-64' WHEN a > 64 THEN '>64' END broad
  FROM (SELECT id, 2024 - birth_year a FROM respondents) t""")
def age_bands(spark, d):
    a = s.age("birth_year", 2024)
    return v.respondents(spark, d).select("id", *[s.age_band(a, k).alias(k) for k in ("seven", "adults", "broad")])


@query("D3_decade", """SELECT o_orderkey, concat(CAST(y // 10 * 10 AS VARCHAR), '-', CAST(y // 10 * 10 + 9 AS VARCHAR)) "decade"
  FROM (SELECT o_orderkey, year(o_orderdate) y FROM orders) t""")
def decade(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", s.decade(F.year("o_orderdate")).alias("decade"))


@query("D4_flag_before", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-10-11' THEN 1 ELSE 0 END test FROM orders")
def flag_before(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", s.flag_before("o_orderdate", "1998-10-11").alias("test"))


Q6_MISSING = "CASE WHEN Q6_1 IS NULL AND Q6_2 IS NULL AND Q6_3 IS NULL AND Q6_4 IS NULL AND Q6_5 IS NULL THEN 1 ELSE 0 END"
Q12_MISSING = "CASE WHEN coalesce(Q12_1, Q12_2, Q12_3, Q12_4, Q12_5, Q12_6) IS NULL THEN 1 ELSE 0 END"


@query("D5_group_missing", f"WITH {r.RESP} SELECT id, {Q6_MISSING} Q6_missing FROM resp")
def group_missing(spark, d):
    return quality.flag_all_missing(v.resp(spark, d), {"Q6": v.SPEND}).select("id", "Q6_missing")


FLAGS = f"""flags AS (SELECT id, city, test, missing_all,
  CASE WHEN a > 99 OR missing_all = 1 THEN 1 WHEN a <= 99 AND missing_all = 0 THEN 0 END bad FROM (
  SELECT id, city, 2024 - birth_year a, CASE WHEN end_date < DATE '1995-06-01' THEN 1 ELSE 0 END test,
  CASE WHEN {Q6_MISSING} = 1 AND {Q12_MISSING} = 1 THEN 1 ELSE 0 END missing_all FROM census) t)"""


def _flagged(spark, d):
    df = v.census(spark, d).withColumn("age", s.age("birth_year", 2024))
    return quality.quality_flags(df, "end_date", "1995-06-01", "age", {"Q6": v.SPEND, "Q12": v.MULTI})


@query("D6_quality_flags", f"""WITH {r.CENSUS}, {FLAGS} SELECT id, test, missing_all, bad, "exclude", 1 - "exclude" screenout FROM (
  SELECT *, CASE WHEN test = 1 OR bad = 1 THEN 1 WHEN bad = 0 THEN 0 END "exclude" FROM flags) t""")
def quality_flags(spark, d):
    return _flagged(spark, d).select("id", "test", "missing_all", "bad", "exclude", "screenout")


@query("D6_valid_responses", f"WITH {r.CENSUS}, {FLAGS} SELECT id, city FROM flags WHERE test = 0 AND bad = 0")
def valid_responses(spark, d):
    return quality.valid_responses(_flagged(spark, d)).select("id", "city")


@query("D7_answered_flags", f"""WITH {r.CENSUS} SELECT id, CASE WHEN {Q6_MISSING} = 0 THEN 1 END Q6, CASE WHEN {Q12_MISSING} = 0 THEN 1 END Q12,
  CASE WHEN coalesce(Q17_1, Q17_2, Q17_3, Q17_4, Q17_5, Q17_6, Q17_7) IS NOT NULL THEN 1 END Q17 FROM census""")
def answered_flags(spark, d):
    df = v.census(spark, d)
    return quality.answered_flags(df, c.question_groups(df, ["Q6", "Q12", "Q17", "Q99"]), ["id"])


@query("D8_row_total_strict", f"WITH {r.RESP} SELECT id, Q6_1 + Q6_2 + Q6_3 + Q6_4 + Q6_5 total FROM resp")
def row_total_strict(spark, d):
    return v.resp(spark, d).select("id", s.row_total(v.SPEND).alias("total"))


LENIENT = " + ".join(f"coalesce(Q6_{k}, 0)" for k in range(1, 6))


@query("D9_row_total_answered", f"WITH {r.RESP} SELECT id, {LENIENT} total FROM resp WHERE {Q6_MISSING} = 0")
def row_total_answered(spark, d):
    return f.answered_any(v.resp(spark, d), v.SPEND).select("id", s.row_total(v.SPEND, strict=False).alias("total"))


@query("D10_row_total_lenient", f"WITH {r.RESP} SELECT id, {LENIENT} total FROM resp")
def row_total_lenient(spark, d):
    return v.resp(spark, d).select("id", s.row_total(v.SPEND, strict=False).alias("total"))


LABEL_SQL = """concat(CAST(n AS VARCHAR), ' (', CASE WHEN t % 10 = 0 THEN CAST(t // 10 AS VARCHAR)
  ELSE concat(CAST(t // 10 AS VARCHAR), '.', CAST(t % 10 AS VARCHAR)) END, '%)')"""


@query("D11_labels", f"""WITH {r.RESPONDENTS}, k AS (SELECT city, rating, count(*) n FROM respondents WHERE rating IS NOT NULL GROUP BY 1, 2),
  w AS (SELECT city, CAST(rating AS VARCHAR) "value", n, CAST(sum(n) OVER (PARTITION BY city) AS BIGINT) total FROM k),
  x AS (SELECT *, (n * 2000 + total) // (2 * total) t FROM w)
  SELECT "value", {LABEL_SQL} bar, concat(city, chr(10), 'N = ', CAST(total AS VARCHAR)) facet FROM x""")
def labels(spark, d):
    counts = tally(v.respondents(spark, d), ["city"], {"rating": ["rating"]})
    return counts.select("value", s.pct_label("n", "answered").alias("bar"), s.n_label("city", "answered").alias("facet"))


@query("D12_extract_text", """SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) host,
  CASE WHEN regexp_matches(url, '/en/') THEN 'english' WHEN regexp_matches(url, '/fr/') THEN 'french' END lang FROM pages""")
def extract_text(spark, d):
    url = F.col("url")
    return v.table(spark, d, "pages").select(
        "page_id", F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"),
        s.classify(url, {"english": "/en/", "french": "/fr/"}).alias("lang"))


@query("D13_rename_regex", f'WITH {r.MULTI} SELECT id, Q12_1 "Q12a1", Q12_2 "Q12a2", Q12_3 "ASIA_n" FROM multi')
def rename_regex(spark, d):
    df = v.multi(spark, d).select("id", *v.MULTI[:3])
    df = c.rename_map(df, {"Q12_3": c.names_glue("{City}_{measure}", City="ASIA", measure="n")})
    return c.rename_regex(df, r"_(\d)$", r"a\1")


@query("D14_cast_where", """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 1 END big, round(o_totalprice / 7, 4) price FROM orders""")
def cast_where(spark, d):
    df = v.table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") > 100000).alias("big"), (F.col("o_totalprice") / 7).alias("price"))
    return c.round_where(c.true_or_null(df), 4)


@query("D15_grid_cell", f"WITH {r.GRID} SELECT id, \"value\" FROM cell_grid WHERE medium = 3 AND place = 'F'")
def grid_cell(spark, d):
    return reshape.grid_cell(v.cell_grid(spark, d), 3, "F").select("id", "value")


BANDS = [(None, 17, "0-17"), (18, 29, "18-29"), (30, 64, "30-64"), (65, None, "65+")]


@query("J6_band_join", f"""WITH {r.RESPONDENTS} SELECT band, count(*) n FROM (SELECT 2024 - birth_year a FROM respondents) t
  LEFT JOIN (VALUES (-1000, 17, '0-17'), (18, 29, '18-29'), (30, 64, '30-64'), (65, 1000, '65+')) b(lo, hi, band)
  ON a BETWEEN lo AND hi GROUP BY 1""")
def band_join(spark, d):
    bands = spark.createDataFrame(BANDS, "lo int, hi int, band string")
    ages = v.respondents(spark, d).select(s.age("birth_year", 2024).alias("age"))
    return sample_size(f.band_join(ages, "age", bands, "lo", "hi"), ["band"])


WIDE_BANDS = [(None, -1, "debt"), (0, 2_000_000, "all"), (0, 499_999, "low"), (500_000, 1_000_000, "mid"), (5, 4, "empty")]


@query("J6_band_join_wide", """SELECT o_orderkey, band FROM orders LEFT JOIN (VALUES (-1e18, -1, 'debt'), (0, 2000000, 'all'), (0, 499999, 'low'),
  (500000, 1000000, 'mid')) b(lo, hi, band) ON CASE WHEN o_orderkey % 10 > 0 THEN (o_orderkey * 7919) % 3000001 - 500000 END BETWEEN lo AND hi""")
def band_join_wide(spark, d):
    """Overlapping bands far wider than the distance of values, and unknown values."""
    bands = spark.createDataFrame(WIDE_BANDS, "lo long, hi long, band string")
    key = F.col("o_orderkey")
    values = v.table(spark, d, "orders").select("o_orderkey", F.when(key % 10 > 0, key * 7919 % 3000001 - 500000).alias("x"))
    return f.band_join(values, "x", bands, "lo", "hi").select("o_orderkey", "band")


@query("J6_interval_join", """WITH b AS (SELECT o_orderkey * 7 % 100003 lo, o_orderkey * 7 % 100003 + o_orderkey % 50 hi, o_orderkey id FROM orders),
  x AS (SELECT l_linenumber line, (l_orderkey * 13 + l_linenumber) % 100003 x FROM lineitem)
  SELECT line, count(*) n, count(id) matches, CAST(sum(id) AS BIGINT) total FROM x LEFT JOIN b ON x.x BETWEEN lo AND hi GROUP BY 1""")
def interval_join(spark, d):
    """A band per order, overlapping, and a value per order line."""
    key = F.col("o_orderkey")
    bands = v.table(spark, d, "orders").select((key * 7 % 100003).alias("lo"), (key * 7 % 100003 + key % 50).alias("hi"), key.alias("id"))
    values = v.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("line"), ((F.col("l_orderkey") * 13 + F.col("l_linenumber")) % 100003).alias("x"))
    # Ids are added up as decimals, as the SQL does: only a result has to fit a bigint.
    sums = {"bands": F.lit(1), "ids": F.col("id").isNotNull().cast("int"), "total": F.col("id").cast("decimal(20,0)")}
    return f.band_join(values, "x", bands, "lo", "hi", sums=sums).groupBy("line").agg(
        F.coalesce(F.sum(F.coalesce("bands", F.lit(1))), F.lit(0)).alias("n"), F.coalesce(F.sum("ids"), F.lit(0)).alias("matches"),
        F.sum("total").cast("bigint").alias("total"))
