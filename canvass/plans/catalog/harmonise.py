"""Codebook-driven recoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.operators import codebook as cb
from canvass.operators.tabulate import crosstab
from canvass.plans import views as v
from canvass.plans.catalog import registry as r
from canvass.plans.catalog.registry import query
from canvass.plans.catalog.storage import QUESTIONS

YES_NO = [("1-URGENT", "Yes", 1), ("2-HIGH", "Yes", 1), ("4-NOT SPECIFIED", "No", 2)]


@query("H1_harmonize_values", """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN CASE o_orderpriority
  WHEN '1-URGENT' THEN 'Yes' WHEN '2-HIGH' THEN 'Yes' WHEN '4-NOT SPECIFIED' THEN 'No' ELSE o_orderpriority END
  ELSE o_orderpriority END Q4,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1
  WHEN '4-NOT SPECIFIED' THEN 2 END END Q4_code FROM orders""")
def harmonize_values(spark, d):
    orders = v.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "Q4")
    return cb.harmonize_values(orders, "Q4", YES_NO, "o_orderstatus", ["F", "O"]).select("o_orderkey", "Q4", "Q4_code")


@query("H2_harmonize_all", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Yes' WHEN '2-HIGH' THEN 'Yes'
  WHEN '4-NOT SPECIFIED' THEN 'No' ELSE o_orderpriority END Q4, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1
  WHEN '4-NOT SPECIFIED' THEN 2 END Q4_code, CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'P' THEN 'Partly' ELSE o_orderstatus END Q5,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 END Q5_code FROM orders""")
def harmonize_all(spark, d):
    orders = v.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("Q4"), F.col("o_orderstatus").alias("Q5"))
    return cb.harmonize_all(orders, {"Q4": YES_NO, "Q5": [("F", "Done", 1), ("P", "Partly", 2)], "Q9": [("x", "y", 1)]})


@query("H3_label_variables", f"""WITH {r.RESPONDENTS}, n AS (SELECT count(*) answers FROM respondents)
  SELECT "variable", label, answers FROM n, (VALUES ('gender_code', 'What is your gender?'), ('rating', 'How do you rate the scene?'),
  ('birth_year', NULL)) t("variable", label)""")
def label_variables(spark, d):
    df = cb.label_variables(v.respondents(spark, d).select("gender_code", "rating", "birth_year"), QUESTIONS)
    return cb.variable_labels(df).withColumn("answers", df.agg(F.count(F.lit(1))).scalar())


@query("H4_decode", f"WITH {r.RESPONDENTS} SELECT id, {r.GENDER_SQL} gender_code, {r.RATING_SQL} rating, CAST(birth_year AS VARCHAR) birth_year FROM respondents")
def decode(spark, d):
    df = v.respondents(spark, d).select("id", "gender_code", "rating", "birth_year")
    return cb.decode(df, {"gender_code": v.GENDER, "rating": v.RATING}, ["gender_code", "rating", "birth_year"])


@query("H5_remap", f"""WITH {r.PLACES} SELECT c_custkey, CASE city WHEN 'ASIA' THEN 'East' WHEN 'MIDDLE EAST' THEN 'East' ELSE city END city,
  CASE segment WHEN 'MACHINERY' THEN 'Goods' ELSE segment END segment FROM places""")
def remap(spark, d):
    mapping = spark.createDataFrame(
        [("survey", "city", "ASIA", "East"), ("survey", "city", "MIDDLE EAST", "East"),
         ("survey", "segment", "MACHINERY", "Goods"), ("other", "segment", "BUILDING", "Wrong")],
        "dataset string, variable string, original string, mapped string")
    return cb.remap(v.places(spark, d), mapping, "survey", ["city", "segment"]).select("c_custkey", "city", "segment")


ITEMS = {"ECONOMY": "Economy class", "LARGE": "Large size"}


@query("H6_recode_items", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Economy class' WHEN 'LARGE' THEN 'Large size' ELSE p_type END p_type FROM part")
def recode_items(spark, d):
    return cb.recode_items(v.table(spark, d, "part").select("p_partkey", "p_type"), "p_type", ITEMS)


@query("H7_relabel", f"""WITH {r.RESPONDENTS} SELECT id, CASE gender_code WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' WHEN 3 THEN 'Another' END gender
  FROM respondents""")
def relabel(spark, d):
    df = cb.decode(v.respondents(spark, d), {"gender_code": v.GENDER}).select("id", F.col("gender_code").alias("gender"))
    return cb.relabel(df, "gender", {"Another gender identity": "Another"})


@query("H8_label_codes", "SELECT c_custkey, n_name c_nationkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey")
def label_codes(spark, d):
    codes = v.table(spark, d, "nation").select(
        F.lit("c_nationkey").alias("variable"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return cb.label_codes(v.table(spark, d, "customer"), codes, ["c_nationkey"]).select("c_custkey", "c_nationkey", "c_acctbal")


@query("H9_with_order", """SELECT o_orderpriority, n, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 END o_orderpriority_ord
  FROM (SELECT o_orderpriority, count(*) n FROM orders GROUP BY 1) t""")
def with_order(spark, d):
    counts = crosstab(v.table(spark, d, "orders"), [], "o_orderpriority")
    return cb.with_order(counts, "o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"])


@query("H10_caption", f"""WITH {r.RESPONDENTS} SELECT 'rating' question, rating, count(*) n, 'How do you rate the scene?' caption
  FROM respondents WHERE rating IS NOT NULL GROUP BY rating""")
def caption(spark, d):
    captions = spark.createDataFrame(list(QUESTIONS.items()), "question string, caption string")
    counts = crosstab(v.respondents(spark, d), [], "rating").withColumn("question", F.lit("rating"))
    return cb.with_caption(counts, captions)


@query("J2_dictionary_join", f"""WITH {r.PLACES} SELECT city, country, coalesce(m, segment) segment FROM (
  SELECT *, CASE segment WHEN 'FURNITURE' THEN 'Home' WHEN 'HOUSEHOLD' THEN 'Home' END m FROM places) t""")
def dictionary_join(spark, d):
    mapping = spark.createDataFrame(
        [("survey", "segment", "FURNITURE", "Home"), ("survey", "segment", "HOUSEHOLD", "Home")],
        "dataset string, variable string, original string, mapped string")
    return cb.remap(v.places(spark, d), mapping, "survey", ["segment"]).select("city", "country", "segment")
