"""Reports, dashboards and open answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from canvass.functions.scalars import age, age_band
from canvass.operators import codebook as cb
from canvass.operators import dictionary as dc
from canvass.operators import text as tx
from canvass.operators.filters import SurveyParams, complete_cases
from canvass.operators.numeric import spend_summary
from canvass.operators.reshape import grid_cell
from canvass.operators.tabulate import battery, crosstab, pct_within
from canvass.plans import instruments as ins
from canvass.plans import reports as rp
from canvass.plans import views as v
from canvass.plans.catalog import registry as r
from canvass.plans.catalog.answers import BATTERY_TEXTS
from canvass.plans.catalog.clean import LABEL_SQL, Q6_MISSING, Q12_MISSING
from canvass.plans.catalog.measures import rounded
from canvass.plans.catalog.registry import query
from canvass.plans.catalog.storage import QUESTIONS, value_levels
from canvass.plans.instruments import Instrument, answered_bases, dashboard, spending_table
from canvass.session import scratch_path

ANSWERS = {"gender": ["gender_code"], "rating": ["rating"], "Q12": v.MULTI}


def _long(source: str, where: str = "TRUE", by: str = "city") -> str:
    """Counts of the report questions per group, with bases."""
    ticks = " UNION ALL ".join(
        f"SELECT {by}, 'Q12' question, {c} \"value\" FROM {source} WHERE {c} IS NOT NULL AND {where}" for c in v.MULTI)
    return f"""l AS (SELECT {by}, 'gender' question, CAST(gender_code AS VARCHAR) "value" FROM {source} WHERE gender_code IS NOT NULL AND {where}
  UNION ALL SELECT {by}, 'rating', CAST(rating AS VARCHAR) FROM {source} WHERE rating IS NOT NULL AND {where} UNION ALL {ticks})"""


def entry_query(spark, d):
    """Flagship: rating per city with percents and a total over all cities."""
    counts = crosstab(v.respondents(spark, d), ["city"], "rating", all_token="All Cities")
    return cb.decode(pct_within(counts, ["city"]), {"rating": v.RATING}).orderBy("city", "rating")


@query("B0_flagship", f"""WITH {r.RESPONDENTS}, s AS (SELECT city, rating FROM respondents WHERE rating IS NOT NULL
  UNION ALL SELECT 'All Cities', rating FROM respondents WHERE rating IS NOT NULL)
  SELECT city, {r.RATING_SQL} rating, n, n * 100e0 / sum(n) OVER (PARTITION BY city) pct FROM (SELECT city, rating, count(*) n FROM s GROUP BY 1, 2) t""")
def flagship(spark, d):
    return entry_query(spark, d)


@query("B1_wrangle", f"""WITH {r.CENSUS}, p AS (SELECT c.*, o_orderstatus, o_orderpriority FROM census c JOIN orders ON id = o_orderkey WHERE o_orderstatus IN ('F', 'O')),
  f AS (SELECT id, CASE o_orderstatus WHEN 'F' THEN 'man' ELSE 'heide' END source, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'Yes' ELSE
  CASE o_orderpriority WHEN '5-LOW' THEN 'Low' ELSE o_orderpriority END END Q4,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority = '5-LOW' THEN 5 END Q4_code, 2024 - birth_year age,
  CASE WHEN end_date < DATE '1995-06-01' THEN 1 ELSE 0 END test, {Q6_MISSING} = 1 AND {Q12_MISSING} = 1 m FROM p)
  SELECT id, source, Q4, Q4_code, age, CASE WHEN age < 18 THEN '0-17' WHEN age < 30 THEN '18-29' WHEN age < 40 THEN '30-39'
  WHEN age < 50 THEN '40-49' WHEN age < 60 THEN '50-59' WHEN age < 70 THEN '60-69' ELSE '70+' END age_group
  FROM f WHERE test = 0 AND age <= 99 AND NOT m""")
def wrangle(spark, d):
    orders = v.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    source = v.census(spark, d).join(orders, F.col("id") == F.col("o_orderkey"))
    flagged = rp.wrangle(
        source, "o_orderstatus", {"F": "man", "O": "heide"}, {"o_orderpriority": "Q4"},
        {"Q4": [("1-URGENT", "Yes", 1)]}, ["man"], {"Q4": [("5-LOW", "Low", 5)]}, "1995-06-01",
        {"Q6": v.SPEND, "Q12": v.MULTI})
    return rp.quality.valid_responses(flagged).select("id", "source", "Q4", "Q4_code", "age", "age_group")


def _wide(columns: list[str]) -> str:
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN city = '{c}' THEN n END), 0) AS BIGINT) \"{c}\"" for c in columns)


@query("B2_census_tables", f"""WITH {r.CENSUS}, {_long('census')}, k AS (SELECT city, question, "value", count(*) n FROM l GROUP BY 1, 2, 3)
  SELECT question, "value", {_wide(v.CITIES)}, CAST(sum(n) AS BIGINT) "Total" FROM k GROUP BY 1, 2""")
def census_tables(spark, d):
    return rp.crosstab_tables(v.census(spark, d), "city", ANSWERS, v.CITIES)


@query("B3_city_tables", f"""WITH {r.CENSUS}, {_long('census')}, k AS (SELECT city, question, "value", count(*) n FROM l WHERE city IN ('ASIA', 'EUROPE') GROUP BY 1, 2, 3)
  SELECT question, "value", {_wide(['ASIA', 'EUROPE'])} FROM k GROUP BY 1, 2""")
def city_tables(spark, d):
    return rp.report(v.census(spark, d), ["ASIA", "EUROPE"], ANSWERS, v.SPEND)["answers"]


@query("B3_city_spending", f"WITH {r.RESP} SELECT city, " + ", ".join(
    f"round(avg(CASE WHEN Q6_{k} > 0 THEN Q6_{k} END), 2) \"{t}\"" for k, t in enumerate(
        ["Ticket/entry", "Transportation", "Food/drink", "Merchandise", "Accommodation"], 1)) + " FROM resp WHERE city = 'ASIA' GROUP BY 1")
def city_spending(spark, d):
    # The spending categories of the questionnaire.
    names = dict(zip(v.SPEND, ["Ticket/entry", "Transportation", "Food/drink", "Merchandise", "Accommodation"], strict=True))
    table = rp.report(v.resp(spark, d), ["ASIA"], {"rating": ["rating"]}, v.SPEND)["mean_positive_spend"]
    return rp.rename_map(rounded(table, 2, *v.SPEND), names)


@query("U5_report", f"WITH {r.RESP} SELECT city, count(*) n FROM resp WHERE city IN ('AFRICA', 'MIDDLE EAST') GROUP BY 1")
def report(spark, d):
    return rp.report(v.resp(spark, d), ["AFRICA", "MIDDLE EAST"], {"rating": ["rating"]}, v.SPEND)["sample"]


@query("U5_report_tables", f"""WITH {r.RESP}, k AS (SELECT * FROM resp WHERE city IN ('AFRICA', 'MIDDLE EAST'))
  SELECT 'sample' part, city grp, 'n' item, CAST(count(*) AS DOUBLE) "value" FROM k GROUP BY 2
  UNION ALL SELECT 'answers', city, CAST(rating AS VARCHAR), CAST(count(*) AS DOUBLE) FROM k WHERE rating IS NOT NULL GROUP BY 2, 3
  UNION ALL SELECT 'mean_spend', city, unnest(['Q6_1', 'Q6_2', 'Q6_3', 'Q6_4', 'Q6_5']), unnest([""" + ", ".join(f"round(avg(Q6_{k}), 6)" for k in range(1, 6)) + f"""]) FROM k GROUP BY 2
  UNION ALL SELECT 'mean_positive_spend', city, unnest(['Q6_1', 'Q6_2', 'Q6_3', 'Q6_4', 'Q6_5']), unnest([""" + ", ".join(
    f"round(avg(CASE WHEN Q6_{k} > 0 THEN Q6_{k} END), 6)" for k in range(1, 6)) + """]) FROM k GROUP BY 2""")
def report_tables(spark, d):
    """All four tables of the report for two cities, in long form."""
    cities = ["AFRICA", "MIDDLE EAST"]
    tables = rp.report(v.resp(spark, d), cities, {"rating": ["rating"]}, v.SPEND)
    value = F.col("value").cast("double")
    parts = [tables["sample"].select(F.lit("sample").alias("part"), F.col("city").alias("grp"), F.lit("n").alias("item"), F.col("n").cast("double").alias("value")),
             tables["answers"].drop("question").unpivot("value", cities, "grp", "n").select(F.lit("answers").alias("part"), "grp", F.col("value").alias("item"), F.col("n").cast("double").alias("value"))]
    parts += [rounded(tables[t], 6, *v.SPEND).unpivot("city", v.SPEND, "item", "value").select(F.lit(t).alias("part"), F.col("city").alias("grp"), "item", value.alias("value"))
              for t in ("mean_spend", "mean_positive_spend")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _venue(spark, d, group, names, columns):
    """The census in the form of a venue survey; one city is called Total, and some answers are tests."""
    renamed = [F.col(old).alias(new) for new, old in columns.items()]
    city = F.when(F.col("city") == "AFRICA", "Total").otherwise(F.col("city"))
    name = F.when(F.col("id") % 19 == 0, "my test").when(F.col("id") % 23 == 0, "d").when(F.col("id") % 29 == 0, "moi").otherwise(F.concat(F.lit("Club "), F.col("id")))
    status = F.when(F.col("id") % 31 == 0, "Survey Preview").otherwise("IP Address")
    return v.census(spark, d).select(city.alias(group), status.alias("Status"), name.alias(names), *renamed)


PRE = {"Q6": "rating", "Q7": "birth_year", **{f"Q8_{k}": f"Q12_{k}" for k in range(1, 7)}, **{f"Q9_{k}": f"Q17_{k}" for k in range(1, 8)}, "Q10": "segment", "Q11": "gender_code",
       **{f"Q12_{k}": f"Q17_{k}" for k in range(1, 4)}, "Q13": "country", "Q14_1": "Q12_1", "Q14_2": "Q12_2", "Q14_15_TEXT": "segment", **{f"Q15_{k}": f"Q17_{k}" for k in range(1, 4)}, "Q18": "rating"}
POST = {"Q1": "rating", "Q2": "segment", "Q4": "gender_code", "Q6": "country", **{f"Q8_{k}": f"Q12_{k}" for k in range(1, 4)}, **{f"Q9_{k}": f"Q17_{k}" for k in range(1, 5)},
        "Q10": "segment", **{f"Q12_{k}": f"Q12_{k}" for k in range(4, 7)}, "Q13": "gender_code", **{f"Q14_{k}": f"Q17_{k}" for k in range(5, 8)}, "Q31": "country"}


def _venue_sql(columns, singles, tests):
    parts = []
    for new, old in columns.items():
        if new in ("Q14_15_TEXT", "Q31"):
            continue
        value = f"concat(CAST({old} // 10 * 10 AS VARCHAR), '-', CAST({old} // 10 * 10 + 9 AS VARCHAR))" if new == "Q7" else f"CAST({old} AS VARCHAR)"
        parts.append(f"SELECT town, '{new if new in singles else new.split('_')[0]}' question, {value} \"value\" FROM live WHERE {old} IS NOT NULL")
    cells = ", ".join(f"CAST(count(CASE WHEN town = '{c}' THEN 1 END) AS BIGINT) \"{c}\"" for c in ("Total", "EUROPE"))
    return f"""WITH {r.CENSUS}, live AS (SELECT *, CASE city WHEN 'AFRICA' THEN 'Total' ELSE city END town FROM census WHERE id % 31 > 0 AND id % 19 > 0 AND {tests}
    AND city IN ('AFRICA', 'EUROPE')) SELECT question, "value", {cells} FROM ({" UNION ALL ".join(parts)}) t GROUP BY 1, 2"""


@query("B3_pre_tables", _venue_sql(PRE, ("Q15_1", "Q15_2", "Q15_3"), "(id % 29 > 0 OR id % 23 = 0)"))
def pre_tables(spark, d):
    return rp.venue_report(_venue(spark, d, "City", "Q21_1", PRE), ins.PRE_SNAPSHOT, ["Total", "EUROPE"])


@query("B3_post_tables", _venue_sql(POST, (), "id % 23 > 0"))
def post_tables(spark, d):
    return rp.venue_report(_venue(spark, d, "Q34", "Q30_1", POST), ins.POST_SNAPSHOT, ["Total", "EUROPE"])


@query("B4_venue_tables", f"""WITH {r.CENSUS}, {_long('census')}, dec AS (SELECT city, 'decade' question, concat(CAST(year(end_date) // 10 * 10 AS VARCHAR), '-',
  CAST(year(end_date) // 10 * 10 + 9 AS VARCHAR)) "value" FROM census), k AS (SELECT city, question, "value", count(*) n FROM (SELECT * FROM l UNION ALL SELECT * FROM dec) t GROUP BY 1, 2, 3)
  SELECT question, "value", {_wide(v.CITIES)} FROM k GROUP BY 1, 2""")
def venue_tables(spark, d):
    df = v.census(spark, d).withColumn("year", F.year("end_date"))
    return rp.venue_tables(df, "city", ANSWERS, "year", v.CITIES)


@query("B5_venue_plots", f"""WITH {r.CENSUS}, {_long('census')}, k AS (SELECT city, question, "value", count(*) n FROM l GROUP BY 1, 2, 3)
  SELECT city, question, "value", n, n * 100e0 / sum(n) OVER (PARTITION BY question) pct FROM k""")
def venue_plots(spark, d):
    return rp.venue_plot_data(v.census(spark, d), "city", ANSWERS)


@query("B6_raw_options", f"""WITH {r.OPTIONS_TEXT}, {r.RESPONDENTS}, live AS (SELECT city, opts FROM respondents r JOIN options_text o ON r.id = o.id
  WHERE segment = 'BUILDING' AND NOT regexp_matches(country, '_1$') AND country NOT IN ('NATION_3', 'NATION_4')),
  parts AS (SELECT city, unnest(string_split(regexp_replace(opts, '\\(([^()]*),([^()]*)\\)', '(\\1;\\2)', 'g'), ',')) p FROM live),
  k AS (SELECT city, replace(p, ';', ',') "option", count(*) n FROM parts GROUP BY 1, 2) SELECT city, "option", n, n * 100e0 / sum(n) OVER () pct FROM k""")
def raw_options(spark, d):
    df = v.respondents(spark, d).join(v.options_text(spark, d), "id")
    return rp.raw_option_data(df, "city", "opts", ("segment", "BUILDING"), "country", "_1$", ["NATION_3", "NATION_4"])


QUESTION_GROUPS = {"Q2": ["gender_code"], "Q6": v.SPEND, "Q11": ["rating"], "Q12": v.MULTI}


@query("B7_answer_table", f"""WITH {r.CENSUS}, k AS (SELECT city, count(*) n, count(gender_code) a, count(*) - sum({Q6_MISSING}) b, count(rating) c,
  count(*) - sum({Q12_MISSING}) e FROM census GROUP BY 1), q AS (SELECT city, 'Q2' question, a n, a * 100e0 / n p FROM k
  UNION ALL SELECT city, 'Q6', b, b * 100e0 / n FROM k UNION ALL SELECT city, 'Q11', c, c * 100e0 / n FROM k UNION ALL SELECT city, 'Q12', e, e * 100e0 / n FROM k
  UNION ALL SELECT city, 'Sample Size', n, NULL FROM k) SELECT question, """ + ", ".join(
    f'CAST(max(CASE WHEN city = \'{c}\' THEN n END) AS BIGINT) "{c}_n", max(CASE WHEN city = \'{c}\' THEN p END) "{c}_%"' for c in v.CITIES) + " FROM q GROUP BY 1")
def answer_table(spark, d):
    return rp.answer_table(v.census(spark, d), "city", QUESTION_GROUPS, v.CITIES)


SEGMENT_SQL = "CASE segment WHEN 'FURNITURE' THEN 'Home' WHEN 'HOUSEHOLD' THEN 'Home' ELSE segment END"


@query("B8_population", f"""WITH {r.PLACES}, s AS (SELECT city, {SEGMENT_SQL} segment, count(*) n FROM orders JOIN places ON o_custkey = c_custkey GROUP BY 1, 2),
  p AS (SELECT city, {SEGMENT_SQL} segment, count(*) n FROM places GROUP BY 1, 2),
  a AS (SELECT city, segment, n / CAST(sum(n) OVER (PARTITION BY city) AS DOUBLE) sample_share FROM s),
  b AS (SELECT city, segment, n / CAST(sum(n) OVER (PARTITION BY city) AS DOUBLE) population_share FROM p)
  SELECT city, segment, sample_share, population_share, coalesce(sample_share, 0) - coalesce(population_share, 0) difference FROM a FULL JOIN b USING (city, segment)""")
def population_report(spark, d):
    mapping = spark.createDataFrame(
        [("europe", "segment", "FURNITURE", "Home"), ("europe", "segment", "HOUSEHOLD", "Home")],
        "dataset string, variable string, original string, mapped string")
    orders = v.table(spark, d, "orders").join(v.places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    return rp.population_report(orders, v.population(spark, d), mapping, "europe", "city", "segment", "n")


PARAMS = SurveyParams(("ASIA", "All Cities"), ("total",), (1, 2), "city", "gender_code")


@query("B9_census_dashboard", f"""WITH {r.CENSUS}, f AS (SELECT * FROM census WHERE gender_code IN (1, 2)), twice AS (SELECT * FROM f UNION ALL
  SELECT * REPLACE ('All Cities' AS city) FROM f), {_long('twice', "city IN ('ASIA', 'All Cities')")},
  k AS (SELECT city, question, "value", count(*) n FROM l GROUP BY 1, 2, 3),
  b AS (SELECT city, 'gender' question, count(gender_code) total FROM twice GROUP BY 1 UNION ALL SELECT city, 'rating', count(rating) FROM twice GROUP BY 1
        UNION ALL SELECT city, 'Q12', count(coalesce({', '.join(v.MULTI)})) FROM twice GROUP BY 1),
  x AS (SELECT k.*, total, (n * 2000 + total) // (2 * total) t, sum(n) OVER (PARTITION BY k.city, k.question) responses FROM k JOIN b ON k.city = b.city AND k.question = b.question)
  SELECT city, question, "value", n, n * 100e0 / total pct_cases, n * 100e0 / responses pct_responses, {LABEL_SQL} label,
  concat(city, chr(10), 'N = ', CAST(total AS VARCHAR)) facet FROM x""")
def census_dashboard(spark, d):
    return rp.dashboard_answers(v.census(spark, d), PARAMS, ANSWERS, "All Cities")


DASH_TOTALS = f"""src AS (SELECT city, Q6_1 + Q6_2 + Q6_3 + Q6_4 + Q6_5 x FROM resp WHERE gender_code IN (1, 2)),
  twice AS (SELECT * FROM src WHERE city = 'ASIA' UNION ALL SELECT 'All Cities', x FROM src)"""


@query("B9_dashboard_spending", f"""WITH {r.RESP}, {DASH_TOTALS} SELECT city, count(*) n, round(avg(x), 4) mean, round(median(x), 4) median
  FROM twice WHERE x IS NOT NULL GROUP BY 1""")
def dashboard_spending(spark, d):
    table = rp.dashboard_spending(v.resp(spark, d), PARAMS, v.SPEND, "All Cities")
    return rounded(table, 4, "mean", "median")


@query("B9_dashboard_histogram", f"""WITH {r.RESP}, {DASH_TOTALS}, t2 AS (SELECT * FROM twice WHERE x IS NOT NULL), lim AS (SELECT min(x) lo, max(x) hi FROM t2),
  w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 19 ELSE 0.1e0 END width FROM lim), o AS (SELECT width, width / 2 + floor((lo - width / 2) / width) * width origin FROM w),
  b AS (SELECT city, CAST(greatest(ceil((x - origin) / width - 1e-8) - 1, 0) AS INT) bin, count(*) n FROM t2, o GROUP BY 1, 2),
  f AS (SELECT city, total, CAST(i AS INT) bin FROM (SELECT city, sum(n) total FROM b GROUP BY 1) t, range(20) g(i))
  SELECT f.city, f.bin, round(origin + f.bin * width, 4) xmin, round(origin + (f.bin + 1) * width, 4) xmax, CAST(coalesce(b.n, 0) AS BIGINT) n,
  round(coalesce(b.n, 0) / (total * width), 12) density FROM f CROSS JOIN o LEFT JOIN b ON f.city = b.city AND f.bin = b.bin""")
def dashboard_histogram(spark, d):
    table = rp.dashboard_distribution(v.resp(spark, d), PARAMS, v.SPEND, "All Cities")
    return rounded(rounded(table, 4, "xmin", "xmax"), 12, "density")


COUNTRY_BATTERY = f"""{r.LINE}, {r.BATTERY}, {r.RESPONDENTS}, j AS (SELECT r.country, b.* FROM respondents r JOIN battery b ON r.id = b.id),
  twice AS (SELECT * FROM j UNION ALL SELECT * REPLACE ('All Countries' AS country) FROM j), l AS ({r.long_sql('twice', 'id, country', v.BATTERY)})"""


@query("B10_battery_by_country", f"""WITH {COUNTRY_BATTERY}, b AS (SELECT country, count(DISTINCT id) base FROM l GROUP BY 1)
  SELECT k.country, CASE item WHEN 'Q17_1' THEN 'Seen a ballet' WHEN 'Q17_2' THEN 'Been to the cinema' ELSE item END item, "value", n, base, n * 100e0 / base pct
  FROM (SELECT country, item, "value", count(*) n FROM l GROUP BY 1, 2, 3) k JOIN b ON k.country = b.country""")
def battery_by_country(spark, d):
    df = v.respondents(spark, d).select("id", "country").join(v.battery(spark, d), "id")
    return battery(df, ["country"], {c: BATTERY_TEXTS.get(c, c) for c in v.BATTERY}, "All Countries")


@query("B10_spending_by_country", f"""WITH {r.RESP}, src AS (SELECT country, {' + '.join(f'coalesce({c}, 0)' for c in v.SPEND)} x FROM resp WHERE {Q6_MISSING} = 0),
  twice AS (SELECT * FROM src UNION ALL SELECT 'All Countries', x FROM src)
  SELECT country, count(*) n, round(avg(x), 4) mean, round(median(x), 4) median FROM twice GROUP BY 1""")
def spending_by_country(spark, d):
    totals = rp.answered_any(v.resp(spark, d), v.SPEND).select("country", rp.row_total(v.SPEND, strict=False).alias("total"))
    return rounded(spend_summary(totals, "country", "total", "All Countries"), 4, "mean", "median")


@query("B10_grid_minutes", f"""WITH {r.GRID}, {r.RESPONDENTS} SELECT country, count(*) n, round(avg("value"), 4) mean, round(median("value"), 4) median
  FROM cell_grid g JOIN respondents r ON g.id = r.id WHERE medium = 2 AND place = 'O' GROUP BY 1""")
def grid_minutes(spark, d):
    cell = grid_cell(v.cell_grid(spark, d), 2, "O").select("id", "value")
    joined = cell.join(v.respondents(spark, d).select("id", "country"), "id")
    return rounded(spend_summary(joined, "country", "value"), 4, "mean", "median")


@query("B11_statistic_series", """SELECT r_name geo, TIME_PERIOD, "values" FROM (SELECT n_regionkey geo, year(o_orderdate) TIME_PERIOD, count(*) "values"
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) t JOIN region ON geo = r_regionkey
  WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA')""")
def statistic_series(spark, d):
    located = (
        v.table(spark, d, "orders").join(v.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(v.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")))
    values = located.groupBy(F.col("n_regionkey").alias("geo"), F.year("o_orderdate").alias("TIME_PERIOD")).agg(
        F.count(F.lit(1)).alias("values"))
    codes = v.table(spark, d, "region").select(
        F.lit("geo").alias("variable"), F.col("r_regionkey").alias("code"), F.col("r_name").alias("label"))
    return rp.statistic_series(values, codes, ["geo"], {"geo": ["ASIA", "EUROPE", "AFRICA"]})


@query("B12_questionnaire", f"""WITH {r.RESPONDENTS}, k AS (SELECT count(*) n FROM respondents) SELECT position, "variable", question, qtype, "options" FROM k, (VALUES
  (0, 'gender_code', 'What is your gender?', 'single choice', 'Female [1] | Male [2] | Another gender identity [3]'),
  (1, 'rating', 'How do you rate the scene?', 'single choice', 'Very poor [1] | Poor [2] | Fair [3] | Good [4] | Very good [5]'),
  (2, 'birth_year', 'birth_year', 'numeric/open', NULL), (3, 'country', 'country', 'text', NULL)) t(position, "variable", question, qtype, "options") WHERE n > 0""")
def questionnaire(spark, d):
    df = v.respondents(spark, d).select("gender_code", "rating", "birth_year", "country")
    return dc.questionnaire(df, QUESTIONS, value_levels(spark)).drop("option_list")


@query("B13_open_answers", f"""WITH {r.OPEN_TEXT}, f AS (SELECT * FROM open_text WHERE answer <> '') SELECT f.id, lang, answer, quality FROM f LEFT JOIN labels ON f.id = doc_id""")
def open_answers(spark, d):
    results = v.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return rp.open_answers(v.open_text(spark, d), results, "id", "answer", ["lang"])


@query("J3_attach_by_id", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def attach(spark, d):
    return tx.attach_by_id(v.table(spark, d, "documents").select("doc_id", "lang"), v.table(spark, d, "labels"), "doc_id")


@query("U4_enrich_text", f"""WITH {r.OPEN_TEXT} SELECT id, answer, CASE WHEN answer <> '' THEN replace(answer, 'e', 'E') END result,
  CASE WHEN answer = '' THEN 'blank answer' END error FROM open_text WHERE answer IS NOT NULL""")
def enrich_text(spark, d):
    def mark(texts):
        """Stand-in for a translation service: rejects blank answers."""
        if any(not t for t in texts):
            raise ValueError("blank answer")
        return [t.replace("e", "E") for t in texts]

    return tx.enrich_text(v.open_text(spark, d), "id", "answer", mark, batch=5)


@query("U4_enrich_resumable", f"""WITH {r.OPEN_TEXT} SELECT id, answer, CASE WHEN answer <> '' THEN replace(answer, 'n', 'N') END result,
  CASE WHEN answer = '' THEN 'blank answer' END error FROM open_text WHERE answer IS NOT NULL""")
def enrich_resumable(spark, d):
    def mark(texts):
        """Stand-in for a translation service: rejects blank answers."""
        if any(not t for t in texts):
            raise ValueError("blank answer")
        return [t.replace("n", "N") for t in texts]

    return tx.enrich_resumable(v.open_text(spark, d), "id", "answer", mark, scratch_path(spark, "ledger"), parts=4)


@query("B8_age_shares", f"""WITH {r.RESPONDENTS}, k AS (SELECT city, CASE WHEN 2024 - birth_year < 18 THEN '<18' WHEN 2024 - birth_year < 30 THEN '18-29' WHEN 2024 - birth_year < 50 THEN '30-49'
  WHEN 2024 - birth_year < 65 THEN '50-64' WHEN 2024 - birth_year > 64 THEN '>64' END age_group, count(*) n FROM respondents WHERE birth_year IS NOT NULL GROUP BY 1, 2)
  SELECT city, age_group, n / CAST(sum(n) OVER (PARTITION BY city) AS DOUBLE) share FROM k""")
def age_shares(spark, d):
    df = complete_cases(v.respondents(spark, d).select(
        "city", age_band(age("birth_year", 2024), "broad").alias("age_group")))
    return rp.coarsen_share(crosstab(df, ["city"], "age_group"), "n", ["city"], ["city", "age_group"])


VIEWS = Instrument(
    group="city", all_token="All Cities", gender="gender_code", genders=(1, 2, 3), singles=("gender_code", "rating"),
    groups=("Q12",), batteries=("Q17",), amounts=("Q6",), spending={"total": tuple(v.SPEND)}, strict_totals=False)
SHOWN = ("EUROPE", "All Cities")
TWICE = """f AS (SELECT * FROM census WHERE gender_code IN (1, 2, 3)), twice AS (SELECT * FROM f UNION ALL SELECT * REPLACE ('All Cities' AS city) FROM f)"""


@query("B10_dashboard", f"""WITH {r.CENSUS}, {TWICE}, l AS (
  SELECT id, city, 'gender_code' question, NULL item, CAST(gender_code AS VARCHAR) "value" FROM twice WHERE gender_code IS NOT NULL
  UNION ALL SELECT id, city, 'rating', NULL, CAST(rating AS VARCHAR) FROM twice WHERE rating IS NOT NULL
  UNION ALL SELECT id, city, 'Q12', NULL, "value" FROM ({r.long_sql('twice', 'id, city', v.MULTI)}) a
  UNION ALL SELECT id, city, 'Q17', CASE item WHEN 'Q17_1' THEN 'Seen a ballet' WHEN 'Q17_2' THEN 'Been to the cinema' ELSE item END, "value"
    FROM ({r.long_sql('twice', 'id, city', v.BATTERY)}) b),
  t AS (SELECT city, question, count(DISTINCT id) answered, count(*) responses FROM l GROUP BY 1, 2)
  SELECT l.city, l.question, item, "value", count(*) n, count(*) * 100e0 / any_value(answered) pct_cases, count(*) * 100e0 / any_value(responses) pct_responses
  FROM l JOIN t ON l.city = t.city AND l.question = t.question WHERE l.city IN ('EUROPE', 'All Cities') GROUP BY 1, 2, 3, 4""")
def whole_dashboard(spark, d):
    return dashboard(v.census(spark, d), VIEWS, SHOWN, item_texts=BATTERY_TEXTS)


@query("B10_spending_table", f"""WITH {r.RESP}, f AS (SELECT city, {' + '.join(f'coalesce({c}, 0)' for c in v.SPEND)} x FROM resp WHERE gender_code IN (1, 2) AND {Q6_MISSING} = 0),
  twice AS (SELECT * FROM f WHERE city = 'EUROPE' UNION ALL SELECT 'All Cities', x FROM f)
  SELECT city, count(*) n, round(avg(x), 4) mean, round(median(x), 4) median FROM twice GROUP BY 1""")
def spending(spark, d):
    return rounded(spending_table(v.resp(spark, d), VIEWS, "total", SHOWN, (1, 2)), 4, "mean", "median")


@query("B10_chosen_spending", f"""WITH {r.RESP}, f AS (SELECT city, coalesce(Q6_2, 0) + coalesce(Q6_4, 0) x FROM resp WHERE gender_code IN (1, 2) AND coalesce(Q6_2, Q6_4) IS NOT NULL),
  twice AS (SELECT * FROM f WHERE city = 'EUROPE' UNION ALL SELECT 'All Cities', x FROM f)
  SELECT city, count(*) n, round(avg(x), 4) mean, round(median(x), 4) median FROM twice GROUP BY 1""")
def chosen_spending(spark, d):
    """The total of the categories that a user picks."""
    return rounded(spending_table(v.resp(spark, d), VIEWS, ["Q6_2", "Q6_4"], SHOWN, (1, 2)), 4, "mean", "median")


@query("B10_place_amounts", f"""WITH {r.RESP}, f AS (SELECT city, Q6_3 x FROM resp WHERE gender_code IN (1, 2, 3) AND Q6_3 IS NOT NULL),
  twice AS (SELECT * FROM f WHERE city = 'EUROPE' UNION ALL SELECT 'All Cities', x FROM f)
  SELECT city, count(*) n, round(avg(x), 4) mean, round(median(x), 4) median FROM twice GROUP BY 1""")
def place_amounts(spark, d):
    """The amounts of one place."""
    return rounded(spending_table(v.resp(spark, d), VIEWS, ["Q6_3"], SHOWN), 4, "mean", "median")


@query("B10_answered_bases", f"""WITH {r.CENSUS}, {TWICE}, k AS (SELECT city, count(*) - sum({Q6_MISSING}) a, count(*) - sum({Q12_MISSING}) b,
  count(coalesce({', '.join(v.BATTERY)})) c FROM twice WHERE city IN ('EUROPE', 'All Cities') GROUP BY 1)
  SELECT city, 'Q6' question, CAST(a AS BIGINT) answered FROM k UNION ALL SELECT city, 'Q12', CAST(b AS BIGINT) FROM k UNION ALL SELECT city, 'Q17', c FROM k""")
def bases(spark, d):
    """How many answered each question group."""
    return answered_bases(v.census(spark, d), VIEWS, SHOWN)
