"""Amounts, distributions, populations and data dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions.scalars import row_total
from canvass.operators import dictionary as dc
from canvass.operators import numeric as nm
from canvass.operators.compare import compare_to_population, population
from canvass.operators.codebook import remap
from canvass.operators.tabulate import sample_size
from canvass.plans import views as v
from canvass.plans.catalog import registry as r
from canvass.plans.catalog.registry import query
from canvass.plans.catalog.storage import value_levels

STRICT = "Q6_1 + Q6_2 + Q6_3 + Q6_4 + Q6_5"
TWICE = "twice AS (SELECT city, x FROM src UNION ALL SELECT 'All Cities', x FROM src)"


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def prices(spark, d):
    return (
        v.table(spark, d, "orders").join(v.places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
        .select("city", F.col("o_totalprice").alias("x"))
    )


PRICES = f"{r.PLACES}, src AS (SELECT city, o_totalprice x FROM orders JOIN places ON o_custkey = c_custkey)"


@query("G12_spend_summary", f"""WITH {r.RESP}, src AS (SELECT city, {STRICT} x FROM resp WHERE {STRICT} IS NOT NULL), {TWICE}
  SELECT city, count(*) n, round(avg(x), 4) mean, round(median(x), 4) median FROM twice GROUP BY 1""")
def spend_summary(spark, d):
    df = v.resp(spark, d).withColumn("total", row_total(v.SPEND))
    return rounded(nm.spend_summary(df, "city", "total", "All Cities"), 4, "mean", "median")


@query("G12_spend_summary_prices", f"""WITH {PRICES}, {TWICE}
  SELECT city, count(*) n, round(avg(x), 4) mean, round(median(x), 4) median FROM twice GROUP BY 1""")
def spend_summary_prices(spark, d):
    return rounded(nm.spend_summary(prices(spark, d), "city", "x", "All Cities"), 4, "mean", "median")


@query("G13_mean_by", f"WITH {r.RESP} SELECT city, " + ", ".join(
    f"round(avg(Q6_{k}), 4) Q6_{k}" for k in range(1, 6)) + " FROM resp GROUP BY 1")
def mean_by(spark, d):
    return rounded(nm.mean_by(v.resp(spark, d), "city", v.SPEND), 4, *v.SPEND)


@query("G14_mean_positive_by", f"WITH {r.RESP} SELECT city, " + ", ".join(
    f"round(avg(CASE WHEN Q6_{k} > 0 THEN Q6_{k} END), 4) Q6_{k}" for k in range(1, 6)) + " FROM resp GROUP BY 1")
def mean_positive_by(spark, d):
    return rounded(nm.mean_positive_by(v.resp(spark, d), "city", v.SPEND), 4, *v.SPEND)


HISTOGRAM = """lim AS (SELECT min(x) lo, max(x) hi FROM src), w AS (SELECT lo, (hi - lo) / {steps} width FROM lim),
  o AS (SELECT width, width / 2 + floor((lo - width / 2) / width) * width origin FROM w),
  b AS (SELECT city, CAST(greatest(ceil((x - origin) / width - 1e-8) - 1, 0) AS INT) bin, {amount} n FROM src, o GROUP BY 1, 2),
  f AS (SELECT city, total, CAST(i AS INT) bin FROM (SELECT city, sum(n) total FROM b GROUP BY 1) t, range({bins}) g(i))
  SELECT f.city, f.bin, origin + f.bin * width xmin, origin + (f.bin + 1) * width xmax, CAST(coalesce(b.n, 0) AS BIGINT) n"""
HISTOGRAM_TAIL = " FROM f CROSS JOIN o LEFT JOIN b ON f.city = b.city AND f.bin = b.bin"


@query("G16_histogram", f"WITH {PRICES}, " + HISTOGRAM.format(steps=19, amount="count(*)", bins=20)
       + ", coalesce(b.n, 0) / (total * width) density" + HISTOGRAM_TAIL)
def histogram(spark, d):
    return nm.histogram(prices(spark, d), ["city"], "x", bins=20, density=True)


@query("G16_histogram_limits", f"WITH {PRICES.replace('src AS', 'wide AS')}, src AS (SELECT * FROM wide WHERE x BETWEEN 100000 AND 300000), "
       + HISTOGRAM.format(steps=29, amount="count(*)", bins=30).replace("min(x) lo, max(x) hi", "100000e0 lo, 300000e0 hi")
       .replace("FROM src), w", "), w") + HISTOGRAM_TAIL)
def histogram_limits(spark, d):
    return nm.histogram(prices(spark, d), ["city"], "x", bins=30, lo=100000, hi=300000)


@query("G23_weighted_histogram", f"WITH {r.PLACES}, src AS (SELECT city, CAST(year(o_orderdate) AS DOUBLE) x, count(*) n0 FROM orders "
       "JOIN places ON o_custkey = c_custkey GROUP BY 1, 2), " + HISTOGRAM.format(steps=4, amount="sum(n0)", bins=5) + HISTOGRAM_TAIL)
def weighted_histogram(spark, d):
    df = v.table(spark, d, "orders").join(v.places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    counted = sample_size(df.select("city", F.year("o_orderdate").alias("x")), ["city", "x"])
    return nm.histogram(counted, ["city"], "x", bins=5, weight="n")


@query("G17_density", f"""WITH {PRICES.replace('src AS', 'plain AS')}, src AS (SELECT city, CASE WHEN city = 'ASIA' THEN x * 1000 ELSE x END x FROM plain),
  lim AS (SELECT min(x) lo, (max(x) - min(x)) / 63 pace FROM src),
  stat AS (SELECT city, count(*) n, stddev_samp(x) sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) iqr FROM src GROUP BY 1),
  bw AS (SELECT city, n, 0.9e0 * least(sd, iqr / 1.34e0) * pow(CAST(n AS DOUBLE), -0.2e0) bw FROM stat),
  placed AS (SELECT city, n, bw, (x - lo) / (bw / 64) place FROM src JOIN bw USING (city), lim),
  c AS (SELECT city, n, bw, floor(place) cell, count(*) k, sum(place - floor(place)) up FROM placed GROUP BY 1, 2, 3, 4),
  w AS (SELECT city, n, bw, cell, k - up weight FROM c UNION ALL SELECT city, n, bw, cell + 1, up FROM c)
  SELECT city, CAST(point AS INT) point, round(lo + point * pace, 4) x, round(sum(weight * exp(-0.5e0 * pow((point * pace - cell * bw / 64) / bw, 2))) / (n * bw * sqrt(2 * pi())), 14) density
  FROM w, lim, range(64) p(point) GROUP BY city, point, lo, pace, n, bw""")
def density(spark, d):
    """One group's values are a thousand times those of the others: each group has cells of its own width."""
    values = prices(spark, d).withColumn("x", F.when(F.col("city") == "ASIA", F.col("x") * 1000).otherwise(F.col("x")))
    return rounded(rounded(nm.density(values, ["city"], "x", points=64), 14, "density"), 4, "x")


@query("G17_density_cells", f"""WITH {PRICES}, lim AS (SELECT min(x) lo, max(x) hi FROM src), g AS (SELECT lo, hi, (hi - lo) / 256 step FROM lim),
  stat AS (SELECT city, count(*) n, stddev_samp(x) sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) iqr FROM src GROUP BY 1),
  bw AS (SELECT city, n, 0.9e0 * least(sd, iqr / 1.34e0) * pow(CAST(n AS DOUBLE), -0.2e0) bw FROM stat),
  placed AS (SELECT city, (x - lo) / step place, least(floor((x - lo) / step), 255) cell FROM src, g),
  c AS (SELECT city, cell, count(*) n, sum(place - cell) up FROM placed GROUP BY 1, 2),
  w AS (SELECT city, cell, n - up weight FROM c UNION ALL SELECT city, cell + 1, up FROM c),
  p AS (SELECT i point, lo + i * ((hi - lo) / 63) x FROM g, range(64) t(i))
  SELECT w.city, CAST(point AS INT) point, x, round(sum(weight * exp(-0.5e0 * pow((x - (lo + cell * step)) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 14) density
  FROM w JOIN bw ON w.city = bw.city, g, p GROUP BY 1, 2, 3""")
def density_cells(spark, d):
    return rounded(nm.density(prices(spark, d), ["city"], "x", points=64, cells=256), 14, "density")


NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("G18_profile", " UNION ALL ".join(
    f"""SELECT '{c}' "variable", 'numeric' "type", count({c}) valid, count(*) - count({c}) missing, CAST(min({c}) AS DOUBLE) "min",
  CAST(max({c}) AS DOUBLE) "max", round(avg({c}), 4) mean, round(stddev_samp({c}), 4) sd FROM orders""" for c in NUMBERS) + """
  UNION ALL SELECT 'o_orderstatus', 'character', count(o_orderstatus), 0, NULL, NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'priority', 'character', count(p), count(*) - count(p), NULL, NULL, NULL, NULL FROM (SELECT nullif(o_orderpriority, '5-LOW') p FROM orders) t""")
def profile(spark, d):
    df = v.table(spark, d, "orders").select(
        *NUMBERS, "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"))
    return rounded(dc.profile(df), 4, "mean", "sd")


@query("G18_profile_categories", f"""WITH {r.RESPONDENTS}, k AS (
  SELECT 'gender_code' "variable", CAST(gender_code AS VARCHAR) code, {r.GENDER_SQL} label, count(*) n FROM respondents WHERE gender_code IS NOT NULL GROUP BY 2, 3
  UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), {r.RATING_SQL}, count(*) FROM respondents WHERE rating IS NOT NULL GROUP BY 2, 3)
  SELECT * FROM k""")
def profile_categories(spark, d):
    return dc.profile_categories(v.respondents(spark, d), value_levels(spark), ["gender_code", "rating"])


@query("G19_infer_qtype", """SELECT 'quality' "variable", CASE WHEN min(quality) >= 0 AND max(quality) <= 1 THEN 'multiple (dichotomous)' ELSE 'unknown' END qtype FROM labels
  UNION ALL SELECT 'id', CASE WHEN count(*) > 0 THEN 'numeric/open' END FROM documents UNION ALL SELECT 'lang', CASE WHEN count(*) > 0 THEN 'single choice' END FROM documents
  UNION ALL SELECT 'toxic', CASE WHEN count(*) > 0 THEN 'numeric/open' END FROM labels""")
def infer_qtype(spark, d):
    levels = spark.createDataFrame(
        [("quality", "1", "good"), ("lang", "en", "English"), ("lang", "fr", "French")], "variable string, code string, label string")
    return dc.infer_qtype(v.scored(spark, d), levels)


@query("G20_options_string", """SELECT 'o_orderpriority' "variable", string_agg(concat(p, ' [', CAST(c AS VARCHAR), ']'), ' | ' ORDER BY c) "options"
  FROM (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) c, substr(o_orderpriority, 3) p FROM orders) t""")
def options_string(spark, d):
    levels = v.table(spark, d, "orders").select(
        F.lit("o_orderpriority").alias("variable"), F.substring("o_orderpriority", 1, 1).cast("int").alias("code"),
        F.substring("o_orderpriority", 3, 100).alias("label")).distinct()
    return dc.options_string(levels)


@query("G20_group_by_question", """SELECT p_brand "variable", question, (g = 'Is it small?') has_multiple, dense_rank() OVER (ORDER BY question) group_id,
  string_agg(p_brand, ', ') OVER (PARTITION BY question ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) variables_in_group
  FROM (SELECT p_brand, min(p_partkey) position, CASE WHEN avg(p_size) < 25 THEN 'Is it small?' ELSE 'Is it large?' END question,
        CASE WHEN avg(p_size) < 25 THEN 'Is it small?' ELSE 'Is it large?' END g FROM part GROUP BY 1) t""")
def group_by_question(spark, d):
    small = F.avg("p_size") < 25
    spec = v.table(spark, d, "part").groupBy(F.col("p_brand").alias("variable")).agg(
        F.min("p_partkey").alias("position"), F.when(small, "Is it small?").otherwise("Is it large?").alias("question"),
        F.when(small, "multiple (dichotomous)").otherwise("numeric/open").alias("qtype"))
    return dc.group_by_question(spec).select("variable", "question", "has_multiple", "group_id", "variables_in_group")


@query("G21_population", f"""WITH {r.POPULATION} SELECT CASE segment WHEN 'FURNITURE' THEN 'Home' WHEN 'HOUSEHOLD' THEN 'Home' ELSE segment END segment,
  city, CAST(sum(n) AS BIGINT) n FROM population GROUP BY 1, 2""")
def remapped_population(spark, d):
    mapping = spark.createDataFrame(
        [("survey", "segment", "FURNITURE", "Home"), ("survey", "segment", "HOUSEHOLD", "Home")],
        "dataset string, variable string, original string, mapped string")
    return population(remap(v.population(spark, d), mapping, "survey", ["segment"]), ["city", "segment"], "n")


@query("J4_compare_to_population", f"""WITH {r.POPULATION}, sample AS (SELECT city, segment, count(*) k FROM orders JOIN places ON o_custkey = c_custkey
  WHERE segment <> 'MACHINERY' GROUP BY 1, 2),
  a AS (SELECT city, segment, k / CAST(sum(k) OVER (PARTITION BY city) AS DOUBLE) sample_share FROM sample),
  b AS (SELECT city, segment, n / CAST(sum(n) OVER (PARTITION BY city) AS DOUBLE) population_share FROM population)
  SELECT city, segment, sample_share, population_share, coalesce(sample_share, 0) - coalesce(population_share, 0) difference
  FROM a FULL JOIN b USING (city, segment)""")
def compare_populations(spark, d):
    orders = v.table(spark, d, "orders").join(v.places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    sample = sample_size(orders.where(F.col("segment") != "MACHINERY"), ["city", "segment"])
    return compare_to_population(sample, v.population(spark, d).withColumnRenamed("n", "values"), "city", "segment")


@query("G24_economic_table", f"""WITH {r.PLACES}, t AS (SELECT country, segment, count(*) visits, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100e0 yearly
  FROM orders JOIN places ON o_custkey = c_custkey GROUP BY 1, 2),
  e AS (SELECT country, segment, visits, yearly, yearly / visits expense FROM t)
  SELECT country, segment, visits, yearly, expense, round(sum(yearly) OVER (PARTITION BY country), 2) country_total, round(expense * visits - yearly, 4) + 0e0 gap FROM e""")
def economic_table(spark, d):
    orders = v.table(spark, d, "orders").join(v.places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    spent = orders.groupBy("country", "segment").agg(
        F.count(F.lit(1)).alias("visits"), (F.sum(v.cents("o_totalprice")) / 100.0).alias("yearly"))
    spent = spent.withColumn("expense", F.col("yearly") / F.col("visits"))
    out = nm.economic_table(spent, "country", "expense", "visits", "yearly")
    return out.withColumns({"country_total": F.round("country_total", 2), "gap": F.round("gap", 4) + F.lit(0.0)})
