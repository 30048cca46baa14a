"""Long and wide forms, exploded options, totals, grids, order and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canvass.functions.ranking import number_rows
from canvass.operators import reshape as rs
from canvass.operators.codebook import order_keys, ordered
from canvass.operators.tabulate import crosstab, sample_size
from canvass.plans import views as v
from canvass.plans.catalog import registry as r
from canvass.plans.catalog.registry import query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
GROUPS = {"Q12a": v.MULTI[:3], "Q12b": v.MULTI[3:]}

SURVEYED = f"""{r.MULTI}, {r.PLACES}, surveyed AS (SELECT o_orderkey id, city, o_orderpriority priority, m.* EXCLUDE (id)
  FROM orders JOIN places ON o_custkey = c_custkey LEFT JOIN multi m ON m.id = o_orderkey)"""
COUNTS = f"""{r.PLACES}, counts AS (SELECT city, o_orderpriority priority, count(*) n
  FROM orders JOIN places ON o_custkey = c_custkey GROUP BY 1, 2)"""
BY_CITY = ", ".join(f'max(CASE WHEN city = \'{c}\' THEN n END) "{c}"' for c in v.CITIES)


def located(spark, d):
    """Orders with city and priority."""
    return (
        v.table(spark, d, "orders").join(v.places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("o_orderkey").alias("id"), "city", F.col("o_orderpriority").alias("priority"))
    )


def surveyed(spark, d):
    """Located orders with the multi-response group."""
    return located(spark, d).join(v.multi(spark, d), "id", "left")


def priority_counts(spark, d):
    return crosstab(located(spark, d), ["city"], "priority")


@query("R1_to_long", f"WITH {r.MULTI} " + " UNION ALL ".join(
    f"SELECT id, 'Q12_{i}' question, Q12_{i} \"value\" FROM multi" for i in range(1, 7)))
def to_long(spark, d):
    return rs.to_long(v.multi(spark, d), ["id"], v.MULTI)


RATES = """rates AS (SELECT city, count(coalesce(Q12_1, Q12_2, Q12_3)) a, count(coalesce(Q12_4, Q12_5, Q12_6)) b, count(*) n
  FROM surveyed GROUP BY 1)"""


def measured(spark, d):
    """Counts and rates per city as a wide table with ``{question}_{measure}`` columns."""
    df = surveyed(spark, d)
    flags = [F.count(F.when(F.coalesce(*names).isNotNull(), 1)).alias(f"{q}_count") for q, names in GROUPS.items()]
    rates = [
        (F.count(F.when(F.coalesce(*names).isNotNull(), 1)) * 100.0 / F.count(F.lit(1))).alias(f"{q}_perc")
        for q, names in GROUPS.items()]
    return df.groupBy("city").agg(*flags, *rates)


@query("R2_to_long_measures", f"""WITH {SURVEYED}, {RATES}
  SELECT city, 'Q12a' question, a "count", a * 100e0 / n perc FROM rates
  UNION ALL SELECT city, 'Q12b', b, b * 100e0 / n FROM rates""")
def to_long_measures(spark, d):
    return rs.to_long_measures(measured(spark, d), ["city"], ["count", "perc"])


@query("R3_to_wide", f"WITH {COUNTS} SELECT city, " + ", ".join(
    f'max(CASE WHEN priority = \'{p}\' THEN n END) "{p}"' for p in PRIORITIES) + " FROM counts GROUP BY 1")
def to_wide(spark, d):
    return rs.to_wide(priority_counts(spark, d), ["city"], "priority", "n", PRIORITIES)


@query("R4_to_wide_measures", f"WITH {SURVEYED}, {RATES}, q AS (SELECT city, 'Q12a' question, a n, a * 100e0 / n p FROM rates UNION ALL "
       "SELECT city, 'Q12b', b, b * 100e0 / n FROM rates) SELECT question, " + ", ".join(
           f'max(CASE WHEN city = \'{c}\' THEN n END) "{c}_n", max(CASE WHEN city = \'{c}\' THEN p END) "{c}_%"'
           for c in v.CITIES) + " FROM q GROUP BY 1")
def to_wide_measures(spark, d):
    long = rs.to_long_measures(measured(spark, d), ["city"], ["count", "perc"])
    return rs.to_wide_measures(long, ["question"], "city", {"n": "count", "%": "perc"}, v.CITIES)


@query("R5_transpose", f"WITH {COUNTS} SELECT priority AS name, {BY_CITY} FROM counts GROUP BY 1")
def transpose(spark, d):
    wide = rs.to_wide(priority_counts(spark, d), ["city"], "priority", "n", PRIORITIES)
    return rs.transpose(wide, "city", v.CITIES)


@query("R6_explode_options", f"""WITH {r.OPTIONS_TEXT}, parts AS (SELECT unnest(string_split(opts, ',')) opt FROM options_text)
  SELECT opt, count(*) n FROM parts GROUP BY 1""")
def explode_options(spark, d):
    return crosstab(rs.explode_options(v.options_text(spark, d), "opts", name="opt"), [], "opt")


@query("R7_explode_paren_aware", f"""WITH {r.OPTIONS_TEXT}, parts AS (
  SELECT id, unnest(string_split(regexp_replace(opts, '\\(([^()]*),([^()]*)\\)', '(\\1;\\2)', 'g'), ',')) p FROM options_text)
  SELECT id, replace(p, ';', ',') opt FROM parts""")
def explode_paren_aware(spark, d):
    return rs.explode_options(v.options_text(spark, d), "opts", paren_aware=True, name="opt").select("id", "opt")


@query("R7_nested_options", f"""WITH RECURSIVE {r.OPTIONS_TEXT}, deep AS (SELECT id, replace(opts, '(new, used)', '(new, (as new, (boxed, sealed)), used (a, b))') o FROM options_text),
  walk AS (SELECT id, o, 0 i, 0 depth, 1 part, '' piece FROM deep UNION ALL
    SELECT id, o, i + 1, depth + CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END, CASE WHEN c = ',' AND depth = 0 THEN part + 1 ELSE part END,
      CASE WHEN c = ',' AND depth = 0 THEN '' ELSE piece || c END FROM (SELECT *, substr(o, i + 1, 1) c FROM walk WHERE i < length(o)) t),
  ends AS (SELECT id, part, max(i) i FROM walk GROUP BY 1, 2)
  SELECT w.id, w.piece opt FROM walk w JOIN ends USING (id, part, i)""")
def nested_options(spark, d):
    nested = v.options_text(spark, d).withColumn("opts", F.replace("opts", F.lit("(new, used)"), F.lit("(new, (as new, (boxed, sealed)), used (a, b))")))
    return rs.explode_options(nested, "opts", paren_aware=True, name="opt").select("id", "opt")


@query("R8_with_totals", f"""WITH {COUNTS} SELECT CASE WHEN grouping(city) = 1 THEN 'Total' ELSE city END city, priority, CAST(sum(n) AS BIGINT) n
  FROM counts GROUP BY GROUPING SETS ((city, priority), (priority))""")
def with_totals(spark, d):
    return rs.with_totals(priority_counts(spark, d), "city", ["priority"])


@query("R9_fill_absent", f"""WITH {COUNTS} SELECT city, coalesce(max(CASE WHEN priority = '1-URGENT' AND city <> 'ASIA' THEN n END), 0) "1-URGENT",
  coalesce(max(CASE WHEN priority = '5-LOW' THEN n END), 0) "5-LOW" FROM counts GROUP BY 1""")
def fill_absent(spark, d):
    counts = priority_counts(spark, d).where(~((F.col("city") == "ASIA") & (F.col("priority") == "1-URGENT")))
    return rs.fill_absent(rs.to_wide(counts, ["city"], "priority", "n", ["1-URGENT", "5-LOW"]))


@query("R10_sample_row", f"WITH {SURVEYED}, {RATES}, q AS (SELECT city, 'Q12a' question, a n, a * 100e0 / n p FROM rates UNION ALL "
       "SELECT city, 'Q12b', b, b * 100e0 / n FROM rates UNION ALL SELECT city, 'Sample Size', n, NULL FROM rates) SELECT question, "
       + ", ".join(f'max(CASE WHEN city = \'{c}\' THEN n END) "{c}_n", max(CASE WHEN city = \'{c}\' THEN p END) "{c}_%"'
                   for c in v.CITIES) + " FROM q GROUP BY 1")
def sample_row(spark, d):
    table = to_wide_measures(spark, d)
    return rs.append_sample_row(table, sample_size(surveyed(spark, d), ["city"]), "city", v.CITIES)


@query("R11_grid", f"""WITH {COUNTS} SELECT c.city, p.priority, coalesce(n, 0) n FROM
  (SELECT unnest(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST', 'ANTARCTICA']) city) c
  CROSS JOIN (SELECT DISTINCT o_orderpriority priority FROM orders) p LEFT JOIN counts k ON k.city = c.city AND k.priority = p.priority""")
def complete_grid(spark, d):
    return rs.complete_grid(
        priority_counts(spark, d), {"city": [*v.CITIES, "ANTARCTICA"], "priority": PRIORITIES}, {"n": 0})


@query("J5_grid_of_levels", f"WITH {COUNTS} SELECT city, priority, n, i * 0.5e0 x FROM counts CROSS JOIN range(5) t(i)")
def grid_of_levels(spark, d):
    return rs.expand_seq(priority_counts(spark, d), 0, 2, 5)


@query("O1_ordered", f"""WITH {COUNTS} SELECT city, priority, n,
  row_number() OVER (ORDER BY CASE priority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 ELSE 5 END, city) pos
  FROM counts""")
def ordered_crosstab(spark, d):
    levels = {"priority": PRIORITIES[::-1]}
    # A cross-tab has one row per city and answer; the position makes its order visible.
    keys = order_keys(levels, "priority", "city")
    numbered_rows = priority_counts(spark, d).withColumn("pos", F.row_number().over(Window.orderBy(*keys)))
    return ordered(numbered_rows, levels, "priority", "city")


@query("O1_number_rows", """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) pos FROM orders""")
def numbered(spark, d):
    df = v.table(spark, d, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("_down"))
    return number_rows(df, [], ["_down", "o_orderkey"], "pos").drop("_down")


@query("O2_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 6")
def first_rows(spark, d):
    return rs.first_rows(v.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 6, "o_orderkey")


@query("O3_bind_rows", """SELECT 'customer' source, c_custkey key, c_acctbal balance, c_mktsegment segment FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def bind_rows(spark, d):
    customers = v.table(spark, d, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"))
    suppliers = v.table(spark, d, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.lit("supplier").alias("source"))
    return rs.bind_rows(customers, suppliers)


@query("O4_rbind", """SELECT c_nationkey nation, count(*) n FROM customer GROUP BY 1
  UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1""")
def rbind(spark, d):
    a = v.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    b = v.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("m"))
    return rs.rbind(a, b)


@query("G22_distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, d):
    return rs.distinct_values(v.table(spark, d, "part"), "p_brand", "p_type")
