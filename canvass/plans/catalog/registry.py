"""The registry and the SQL forms of the survey views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def _columns(pattern: str, n: int) -> str:
    return ", ".join(pattern.format(k=k) for k in range(1, n + 1))


LINE = """line AS (SELECT l_orderkey id, l_linenumber k,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100e0 amt, max(l_returnflag) flag
  FROM lineitem GROUP BY 1, 2)"""

PLACES = """places AS (SELECT c_custkey, r_name city, n_name country, c_mktsegment segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SPENDING = "spending AS (SELECT id, " + _columns(
    "max(CASE WHEN k = {k} THEN CASE WHEN id % 7 = {k} THEN 0e0 ELSE amt END END) AS Q6_{k}", 5
) + " FROM line GROUP BY 1)"

RESP_ONLY = """respondents AS (SELECT o_orderkey id, city, country, segment,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END gender_code,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(1920 + o_orderkey % 90 AS INT) END birth_year,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) END rating,
  o_orderdate end_date
  FROM orders JOIN places ON o_custkey = c_custkey)"""

RESP = f"""{PLACES}, {LINE}, {SPENDING}, {RESP_ONLY},
  resp AS (SELECT r.*, s.Q6_1, s.Q6_2, s.Q6_3, s.Q6_4, s.Q6_5 FROM respondents r LEFT JOIN spending s ON r.id = s.id)"""

RESPONDENTS = f"{PLACES}, {RESP_ONLY}"

OPTION_NAMES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
MULTI = "multi AS (SELECT l_orderkey id, " + ", ".join(
    f"max(CASE WHEN p_type = '{o}' THEN p_type END) AS Q12_{i}" for i, o in enumerate(OPTION_NAMES, 1)
) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"

BATTERY = "battery AS (SELECT id, " + _columns(
    "max(CASE WHEN k = {k} THEN flag END) AS Q17_{k}", 7) + " FROM line GROUP BY 1)"

CENSUS = f"""{RESP}, {MULTI}, {BATTERY},
  census AS (SELECT r.*, m.* EXCLUDE (id), b.* EXCLUDE (id)
  FROM resp r LEFT JOIN multi m ON r.id = m.id LEFT JOIN battery b ON r.id = b.id)"""

GRID = """cell_grid AS (SELECT l_orderkey id, l_linenumber medium, l_linestatus place, sum(l_quantity) "value"
  FROM lineitem GROUP BY 1, 2, 3)"""

OPTIONS_TEXT = MULTI + ", options_text AS (SELECT id, concat_ws(',', " + ", ".join(
    f"CASE WHEN Q12_{i} IS NOT NULL THEN concat(Q12_{i}, ' (new, used)') END" if i % 2 else f"Q12_{i}"
    for i in range(1, 7)) + ") opts FROM multi)"

OPEN_TEXT = """open_text AS (SELECT doc_id id, lang, source,
  CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 1 THEN NULL ELSE text END answer FROM documents)"""

POPULATION = PLACES + ", population AS (SELECT city, segment, count(*) n FROM places GROUP BY 1, 2)"

DRAWS = """draws AS (SELECT draw, grp, category, s / CAST(sum(s) OVER (PARTITION BY draw, grp) AS DOUBLE) p
  FROM (SELECT event_id % 50 draw, user_id % 5 grp, event_type category,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) s FROM events GROUP BY 1, 2, 3) t)"""

SCORED = "scored AS (SELECT doc_id id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"

GENDER_SQL = "CASE gender_code WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' WHEN 3 THEN 'Another gender identity' END"
RATING_SQL = ("CASE rating WHEN 1 THEN 'Very poor' WHEN 2 THEN 'Poor' WHEN 3 THEN 'Fair' "
              "WHEN 4 THEN 'Good' WHEN 5 THEN 'Very good' END")


def long_sql(source: str, key: str, names: list[str]) -> str:
    """Non-null entries of a column group in long form."""
    return " UNION ALL ".join(
        f"SELECT {key}, '{c}' item, CAST({c} AS VARCHAR) \"value\" FROM {source} WHERE {c} IS NOT NULL" for c in names)
