"""Counts, percentages, rates and windows over counted answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.functions.ranking import group_ids
from canvass.operators import tabulate as t
from canvass.operators.compare import coarsen_share
from canvass.operators.text import batches
from canvass.plans import views as v
from canvass.plans.catalog import registry as r
from canvass.plans.catalog.registry import query
from canvass.plans.catalog.shapes import COUNTS, GROUPS, SURVEYED, located, priority_counts, surveyed

LONG = "long AS (" + r.long_sql("surveyed", "id, city", v.MULTI) + ")"
TICKS = f"{SURVEYED}, {LONG}, ticks AS (SELECT city, \"value\", count(*) n FROM long GROUP BY 1, 2)"
CASES = f"""{TICKS}, bases AS (SELECT city, count(coalesce({', '.join(v.MULTI)})) base FROM surveyed GROUP BY 1)"""


@query("G1_freq", "SELECT priority, n, n * 100e0 / sum(n) OVER () pct FROM (SELECT o_orderpriority priority, count(*) n FROM orders GROUP BY 1) t")
def freq(spark, d):
    return t.freq(v.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "priority"), "priority")


@query("G2_crosstab", f"WITH {r.RESPONDENTS} SELECT city, rating, count(*) n FROM respondents WHERE rating IS NOT NULL GROUP BY 1, 2")
def crosstab(spark, d):
    return t.crosstab(v.respondents(spark, d), ["city"], "rating")


@query("G3_pct_within", f"WITH {COUNTS} SELECT city, priority, n, n * 100e0 / sum(n) OVER (PARTITION BY city) pct FROM counts")
def pct_within(spark, d):
    return t.pct_within(priority_counts(spark, d), ["city"])


@query("G4_pct_overall", f"WITH {COUNTS} SELECT city, priority, n, n * 100e0 / sum(n) OVER () pct FROM counts")
def pct_overall(spark, d):
    return t.pct_overall(priority_counts(spark, d))


@query("G5_multi_freq", f"WITH {TICKS} SELECT city, \"value\", n FROM ticks")
def multi_freq(spark, d):
    return t.multi_freq(surveyed(spark, d), ["city"], v.MULTI)


@query("G6_percent_of_cases", f"""WITH {CASES} SELECT k.city, "value", n, base, n * 100e0 / base pct FROM ticks k JOIN bases b ON k.city = b.city""")
def percent_of_cases(spark, d):
    return t.multi_freq(surveyed(spark, d), ["city"], v.MULTI, base="cases")


@query("G7_percent_of_responses", f"""WITH {TICKS} SELECT city, "value", n, CAST(sum(n) OVER (PARTITION BY city) AS BIGINT) base,
  n * 100e0 / sum(n) OVER (PARTITION BY city) pct FROM ticks""")
def percent_of_responses(spark, d):
    return t.multi_freq(surveyed(spark, d), ["city"], v.MULTI, base="responses")


BATTERY = f"""{r.LINE}, {r.BATTERY}, {r.RESPONDENTS},
  answered AS (SELECT r.city, b.* FROM respondents r JOIN battery b ON r.id = b.id),
  long AS ({r.long_sql('answered', 'id, city', v.BATTERY)})"""
BATTERY_TEXTS = {"Q17_1": "Seen a ballet", "Q17_2": "Been to the cinema"}


def battery_answers(spark, d):
    return v.respondents(spark, d).select("id", "city").join(v.battery(spark, d), "id")


@query("G8_battery", f"""WITH {BATTERY}, bases AS (SELECT city, count(DISTINCT id) base FROM long GROUP BY 1)
  SELECT k.city, CASE item WHEN 'Q17_1' THEN 'Seen a ballet' WHEN 'Q17_2' THEN 'Been to the cinema' ELSE item END item, "value", n, base,
  n * 100e0 / base pct FROM (SELECT city, item, "value", count(*) n FROM long GROUP BY 1, 2, 3) k JOIN bases b ON k.city = b.city""")
def battery(spark, d):
    texts = {c: BATTERY_TEXTS.get(c, c) for c in v.BATTERY}
    return t.battery(battery_answers(spark, d), ["city"], texts)


@query("G9_answered_counts", f"""WITH {SURVEYED} SELECT city, count(coalesce(Q12_1, Q12_2, Q12_3)) Q12a,
  count(coalesce(Q12_4, Q12_5, Q12_6)) Q12b FROM surveyed GROUP BY 1""")
def answered_counts(spark, d):
    return t.answered_counts(surveyed(spark, d), ["city"], GROUPS)


@query("G10_response_rate", f"""WITH {r.SCORED} SELECT lang, count(quality) * 100e0 / count(*) quality, count(toxic) * 100e0 / count(*) toxic
  FROM scored GROUP BY 1""")
def response_rate(spark, d):
    return t.response_rate(v.scored(spark, d), ["lang"], {"quality": ["quality"], "toxic": ["toxic"]})


@query("G11_sample_size", f"WITH {r.RESPONDENTS} SELECT city, count(*) n FROM respondents GROUP BY 1")
def sample_size(spark, d):
    return t.sample_size(v.respondents(spark, d), ["city"])


@query("G15_with_all", f"""WITH {COUNTS} SELECT CASE WHEN grouping(city) = 1 THEN 'All Cities' ELSE city END city, priority, CAST(sum(n) AS BIGINT) n
  FROM counts GROUP BY GROUPING SETS ((city, priority), (priority))""")
def with_all(spark, d):
    return t.crosstab(located(spark, d), ["city"], "priority", all_token="All Cities")


@query("J1_with_denominator", f"""WITH {CASES} SELECT k.city, "value", n, base, n * 100e0 / base pct FROM ticks k LEFT JOIN bases b ON k.city = b.city""")
def with_denominator(spark, d):
    df = surveyed(spark, d)
    counts = t.multi_freq(df, ["city"], v.MULTI)
    return t.with_denominator(counts, t.answered_counts(df, ["city"], {"Q12": v.MULTI}), "city", "Q12")


@query("W1_share", f"WITH {COUNTS} SELECT city, priority, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY city) AS DOUBLE) share FROM counts")
def share(spark, d):
    return t.share(priority_counts(spark, d), "n", ["city"])


@query("W2_number_within", f"WITH {COUNTS} SELECT city, priority, row_number() OVER (PARTITION BY city ORDER BY priority) number FROM counts")
def number_within(spark, d):
    return t.number_within(priority_counts(spark, d), ["city"], ["priority"]).select("city", "priority", "number")


@query("W3_cumulative_share", f"""WITH {COUNTS} SELECT city, priority, n, CAST(sum(n) OVER (PARTITION BY city ORDER BY priority) AS DOUBLE)
  / CAST(sum(n) OVER (PARTITION BY city) AS DOUBLE) cum_share FROM counts""")
def cumulative_share(spark, d):
    return t.cumulative_share(priority_counts(spark, d), ["city"], ["priority"])


@query("W4_group_ids", "SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_name) group_id FROM part")
def same_text(spark, d):
    return group_ids(v.table(spark, d, "part").select("p_partkey", "p_name"), "p_name")


@query("W5_batches", "SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) + 4) // 5 batch FROM documents")
def text_batches(spark, d):
    return batches(v.table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 5)


@query("W6_coarsen_share", f"""WITH {r.POPULATION} SELECT city, round(sum(s), 12) share FROM (SELECT city, segment,
  CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY segment) AS DOUBLE) s FROM population) t GROUP BY 1""")
def coarse_share(spark, d):
    return coarsen_share(v.population(spark, d), "n", ["segment"], ["city"]).withColumn("share", F.round("share", 12))


@query("G2_tally", f"""WITH {CASES}, p AS (SELECT city, 'priority' question, priority "value", count(*) n FROM surveyed GROUP BY 1, 3)
  SELECT city, question, "value", n, CAST(sum(n) OVER (PARTITION BY city) AS BIGINT) answered, CAST(sum(n) OVER (PARTITION BY city) AS BIGINT) responses FROM p
  UNION ALL SELECT k.city, 'Q12', "value", n, base, CAST(sum(n) OVER (PARTITION BY k.city) AS BIGINT) FROM ticks k JOIN bases b ON k.city = b.city""")
def tally(spark, d):
    return t.tally(surveyed(spark, d), ["city"], {"priority": ["priority"], "Q12": v.MULTI})
