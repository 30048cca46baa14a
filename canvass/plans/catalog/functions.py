"""One query per family of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.plans import views as v
from canvass.plans.catalog.registry import query


@query("X_string_functions", r"""SELECT page_id, concat_ws('-', CAST(page_id AS VARCHAR), regexp_extract(url, '^(https?)', 1)) pasted,
  split_part(url, '/', 3) host, regexp_replace(url, '\d+', '#') replaced, starts_with(url, 'https') secure, regexp_matches(url, 'page=') paged FROM pages""")
def strings(spark, d):
    url = F.col("url")
    return v.table(spark, d, "pages").select(
        "page_id", F.concat_ws("-", F.col("page_id").cast("string"), F.regexp_extract(url, "^(https?)", 1)).alias("pasted"),
        F.split(url, "/")[2].alias("host"), F.regexp_replace(url, F.lit("^(\\D*)\\d+"), F.lit("$1#")).alias("replaced"),
        url.startswith("https").alias("secure"), url.rlike("page=").alias("paged"))


@query("X_collapse", """SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def collapse(spark, d):
    # Nations per region: a fixed list of 25, so collecting them per group is bounded.
    nations = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("nations"))


@query("X_math_functions", """SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) low, CAST(ceil(o_totalprice / 1000) AS BIGINT) high, round(ln(o_totalprice), 10) logged,
  round(exp(o_totalprice / 1e6), 10) risen, abs(o_totalprice - 200000) away FROM orders""")
def maths(spark, d):
    x = F.col("o_totalprice")
    return v.table(spark, d, "orders").select(
        "o_orderkey", F.floor(x / 1000).alias("low"), F.ceil(x / 1000).alias("high"), F.round(F.log(x), 10).alias("logged"),
        F.round(F.exp(x / 1e6), 10).alias("risen"), F.abs(x - 200000).alias("away"))


@query("X_conditional_functions", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END level,
  coalesce(nullif(o_orderstatus, 'P'), 'unknown') status FROM orders""")
def conditionals(spark, d):
    return v.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 200000, "high").otherwise("low").alias("level"),
        F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("unknown")).alias("status"))


@query("X_date_and_cast", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "day", CAST(substr(o_orderpriority, 1, 1) AS INT) rating,
  CAST(o_custkey AS VARCHAR) code, CAST(o_orderdate AS DATE) >= DATE '1998-10-11' live FROM orders""")
def dates(spark, d):
    day = F.to_date("o_orderdate")
    return v.table(spark, d, "orders").select(
        "o_orderkey", day.cast("string").alias("day"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        F.col("o_custkey").cast("string").alias("code"), (day >= F.lit("1998-10-11").cast("date")).alias("live"))
