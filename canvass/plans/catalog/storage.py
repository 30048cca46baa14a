"""Sources and sinks: written to the shared folder, read back and compared."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from canvass.functions.columns import rename_map
from canvass.operators.codebook import Codebook, harmonize_all
from canvass.operators.dictionary import (
    profile, profile_categories, questionnaire, questionnaire_blocks,
)
from canvass.operators.filters import SurveyParams, answered_text
from canvass.plans import views as v
from canvass.plans.catalog import registry as r
from canvass.plans.catalog.registry import SQL, query
from canvass.session import scratch_path
from canvass.sources import readers, writers

STATUS = [("o_orderstatus", "F", "Finished"), ("o_orderstatus", "O", "Open"), ("o_orderstatus", "P", "Pending")]
PARAMS = SurveyParams(
    groups=("ASIA", "EUROPE"), genders=("total",), all_genders=(1, 2), group_col="city", gender_col="gender_code")
QUESTIONS = {"gender_code": "What is your gender?", "rating": "How do you rate the scene?", "city": "Where do you live?"}


def value_levels(spark):
    rows = [("gender_code", k, t) for k, t in v.GENDER.items()] + [("rating", k, t) for k, t in v.RATING.items()]
    return spark.createDataFrame(rows, "variable string, code int, label string")


@query("S1_read_survey", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open'
  WHEN 'P' THEN 'Pending' END o_orderstatus, o_orderpriority FROM orders""")
def read_survey(spark, d):
    levels = spark.createDataFrame(STATUS, "variable string, code string, label string")
    survey = readers.read_survey(spark, f"{d}/orders.parquet", levels=levels)
    return survey.decoded().select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("S2_read_surveys", """SELECT 'customer' source, c_custkey key, c_name name, c_nationkey place FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey FROM supplier""")
def read_surveys(spark, d):
    both = readers.read_surveys(
        spark, d, pattern="*er.parquet",
        schema="c_custkey bigint, c_name string, c_nationkey int, s_suppkey bigint, s_name string, s_nationkey int")
    return both.select(
        "source", F.coalesce("c_custkey", "s_suppkey").alias("key"), F.coalesce("c_name", "s_name").alias("name"),
        F.coalesce("c_nationkey", "s_nationkey").alias("place"))


@query("S2_read_survey_files", """SELECT 'part' source, p_partkey key, p_name name, NULL nation FROM part
  UNION ALL SELECT 'customer', c_custkey, c_name, c_nationkey FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey FROM supplier""")
def read_survey_files(spark, d):
    columns = {
        "part": {"p_partkey": "key", "p_name": "name"},
        "customer": {"c_custkey": "key", "c_name": "name", "c_nationkey": "nation"},
        "supplier": {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation"},
    }
    return readers.read_survey_files(spark, {s: f"{d}/{s}.parquet" for s in columns}, columns=columns)


@query("S3_codebook", """SELECT o_orderkey id, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high'
  WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END Q4,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 END Q4_code FROM orders""")
def codebook(spark, d):
    book = Codebook.from_rows(
        spark, crosswalk=[("o_orderkey", "id"), ("o_orderpriority", "Q4")],
        levels=[("Q4", "1-URGENT", "high", 1), ("Q4", "2-HIGH", "high", 1), ("Q4", "5-LOW", "low", 2)])
    folder = scratch_path(spark, "codebook")
    book.save(folder)
    loaded = Codebook.load(spark, folder)
    orders = rename_map(v.table(spark, d, "orders"), loaded.crosswalk())
    return harmonize_all(orders, loaded.changes("levels")).select("id", "Q4", "Q4_code")


@query("S4_two_header", """SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name, c_mktsegment, 'Key of the customer' key_label,
  'Name of the customer' name_label FROM customer""")
def two_header(spark, d):
    texts = {"c_custkey": "Key of the customer", "c_name": "Name of the customer", "c_mktsegment": "Segment"}

    def with_texts(frames):
        yield pd.DataFrame([texts])
        yield from frames

    source = v.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_mktsegment")
    path = scratch_path(spark, "export")
    source.mapInPandas(with_texts, source.schema).write.option("header", "true").csv(path)
    data, labels = readers.read_two_header(spark, path)
    text = lambda c: labels.where(F.col("variable") == c).select("label").scalar()
    return data.withColumns({"key_label": text("c_custkey"), "name_label": text("c_name")})


@query("S5_csv_renamed", "SELECT c_name AS \"Customer name\", c_acctbal AS \"Balance (EUR)\" FROM customer")
def csv_renamed(spark, d):
    path = scratch_path(spark, "csv")
    writers.write_csv(v.table(spark, d, "customer").select("c_name", "c_acctbal"), path)
    return readers.read_csv_renamed(
        spark, path, "c_name string, c_acctbal double", {"c_name": "Customer name", "c_acctbal": "Balance (EUR)"})


@query("S6_write_csv", f"WITH {r.RESPONDENTS} SELECT id, city, gender_code, birth_year FROM respondents")
def write_csv(spark, d):
    rows = v.respondents(spark, d).select("id", "city", "gender_code", "birth_year")
    path = scratch_path(spark, "csv")
    writers.write_csv(rows, path)
    return spark.read.option("header", "true").schema("id bigint, city string, gender_code int, birth_year int").csv(path)


@query("S7_export_extract", f"""WITH {r.RESPONDENTS} SELECT id, city, gender_code, rating FROM respondents
  WHERE city IN ('ASIA', 'EUROPE') AND gender_code IN (1, 2)""")
def export_extract(spark, d):
    rows = v.respondents(spark, d).select("id", "city", "gender_code", "rating")
    path = scratch_path(spark, "extract")
    writers.export_extract(rows, PARAMS, path)
    return spark.read.option("header", "true").schema("id bigint, city string, gender_code int, rating int").csv(path)


@query("S8_save_table", f"WITH {r.RESP} SELECT id, city, segment, Q6_1, Q6_2 FROM resp")
def save_table(spark, d):
    path = scratch_path(spark, "saved")
    writers.save_table(v.resp(spark, d).select("id", "city", "segment", "Q6_1", "Q6_2"), path, ["city"])
    return spark.read.parquet(path).select("id", "city", "segment", "Q6_1", "Q6_2")


@query("S9_write_tables", f"""WITH {r.OPEN_TEXT} SELECT 'answers' tab, id, lang FROM open_text WHERE answer <> ''
  UNION ALL SELECT 'pages', page_id, NULL FROM pages""")
def write_tables(spark, d):
    answers = answered_text(v.open_text(spark, d), "answer").select("id", "lang", "answer")
    pages = v.table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    paths = writers.write_tables({"answers": answers, "pages": pages}, scratch_path(spark, "tables"))
    parts = [spark.read.parquet(p).withColumn("tab", F.lit(name)) for name, p in paths.items()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).select("tab", "id", "lang")


@query("S10_codebook_xml", f"""WITH {r.RESPONDENTS}
  SELECT 'gender_code' AS name, 'What is your gender?' labl, count(gender_code) valid, 3 categories FROM respondents
  UNION ALL SELECT 'rating', 'How do you rate the scene?', count(rating), 5 FROM respondents
  UNION ALL SELECT 'city', 'Where do you live?', count(city), 0 FROM respondents
  UNION ALL SELECT 'birth_year', 'birth_year', count(birth_year), 0 FROM respondents""")
def codebook_xml(spark, d):
    rows = v.respondents(spark, d).select("gender_code", "rating", "city", "birth_year")
    elements = writers.codebook_elements(
        profile(rows), profile_categories(rows, value_levels(spark), ["gender_code", "rating"]), QUESTIONS)
    path = scratch_path(spark, "xml")
    writers.write_codebook_xml(elements, path)
    schema = ("_name string, labl string, sumStat array<struct<_type string, _VALUE string>>, "
              "catgry array<struct<catValu string, labl string>>")
    back = spark.read.format("xml").option("rowTag", "var").schema(schema).load(path)
    valid = F.filter("sumStat", lambda s: s["_type"] == "vald")[0]["_VALUE"].cast("bigint")
    return back.select(F.col("_name").alias("name"), "labl", valid.alias("valid"),
                       F.coalesce(F.array_size("catgry"), F.lit(0)).alias("categories"))


@query("S11_questionnaire", r"""SELECT position, "variable", concat('## ', "variable", chr(10), '**Question:** ', q, chr(10),
  '**Type:** ', t, chr(10), CASE WHEN o IS NULL THEN '' ELSE concat('**Options:**', chr(10), '- ', replace(o, ' | ', concat(chr(10), '- '))) END,
  chr(10), chr(10), '---', chr(10)) block FROM (VALUES
  (0, 'gender_code', 'What is your gender?', 'single choice', 'Female [1] | Male [2] | Another gender identity [3]'),
  (1, 'rating', 'How do you rate the scene?', 'single choice', 'Very poor [1] | Poor [2] | Fair [3] | Good [4] | Very good [5]'),
  (2, 'city', 'Where do you live?', 'text', NULL), (3, 'birth_year', 'birth_year',
  CASE WHEN (SELECT count(*) FROM orders) > 0 THEN 'numeric/open' END, NULL)) t(position, "variable", q, t, o)""")
def questionnaire_text(spark, d):
    rows = v.respondents(spark, d).select("gender_code", "rating", "city", "birth_year")
    spec = questionnaire(rows, QUESTIONS, value_levels(spark))
    writers.write_questionnaire(spec, scratch_path(spark, "questionnaire"))
    return questionnaire_blocks(spec)


@query("S10_codebook_statistics", f"""WITH {r.RESPONDENTS} """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS name, CAST(count({c}) AS DOUBLE) vald, CAST(count(*) - count({c}) AS DOUBLE) invd, CAST(min({c}) AS DOUBLE) "min", CAST(max({c}) AS DOUBLE) "max",
  round(avg({c}), 6) mean, round(stddev_samp({c}), 6) stdev FROM respondents""" for c in ("gender_code", "rating", "birth_year")) + """
  UNION ALL SELECT 'city', CAST(count(city) AS DOUBLE), CAST(count(*) - count(city) AS DOUBLE), NULL, NULL, NULL, NULL FROM respondents""")
def codebook_statistics(spark, d):
    """All six statistics of every variable, read back from the written document."""
    rows = v.respondents(spark, d).select("gender_code", "rating", "city", "birth_year")
    path = scratch_path(spark, "xml")
    writers.write_codebook_xml(writers.codebook_elements(profile(rows), profile_categories(rows, value_levels(spark), ["gender_code", "rating"]), QUESTIONS), path)
    back = spark.read.format("xml").option("rowTag", "var").schema("_name string, sumStat array<struct<_type string, _VALUE double>>").load(path)
    of = lambda kind: F.get(F.filter("sumStat", lambda s: s["_type"] == kind), F.lit(0))["_VALUE"]
    return back.select(F.col("_name").alias("name"), *[F.round(of(k), 6).alias(k) if k in ("mean", "stdev") else of(k).alias(k) for k in ("vald", "invd", "min", "max", "mean", "stdev")])


@query("S11_questionnaire_file", SQL["S11_questionnaire"].replace("SELECT position", "SELECT line, count(*) n FROM (SELECT unnest(string_split(block, chr(10))) line FROM (SELECT position", 1)
       + " UNION ALL SELECT -1, '', concat('# Questionnaire', chr(10))) b) l GROUP BY 1")
def questionnaire_file(spark, d):
    """The lines of the written questionnaire, read back."""
    rows = v.respondents(spark, d).select("gender_code", "rating", "city", "birth_year")
    path = scratch_path(spark, "questionnaire")
    writers.write_questionnaire(questionnaire(rows, QUESTIONS, value_levels(spark)), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))
