"""Survey-shaped views over the star-schema tables.

Each view reads only the columns it needs and groups respondents on the order key. Money is added up
in whole cents, so that sums do not depend on the order in which executors finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Labels, cities and the options of the multi-response question, in order.
GENDER = {1: "Female", 2: "Male", 3: "Another gender identity"}
RATING = {1: "Very poor", 2: "Poor", 3: "Fair", 4: "Good", 5: "Very good"}
CITIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
OPTIONS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SPEND = [f"Q6_{k}" for k in range(1, 6)]
MULTI = [f"Q12_{k}" for k in range(1, 7)]
BATTERY = [f"Q17_{k}" for k in range(1, 8)]


# Schemas already read from file footers, so that a report over many views lists and opens files once.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("bigint")


def places(spark: SparkSession, d: str) -> DataFrame:
    """Customers with city (region), country (nation) and segment."""
    nation = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("r_name").alias("city"), F.col("n_name").alias("country"),
                F.col("c_mktsegment").alias("segment"))
    )


def respondents(spark: SparkSession, d: str) -> DataFrame:
    """Census responses without the spending columns."""
    key = F.col("o_orderkey")
    return (
        table(spark, d, "orders").join(places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            key.alias("id"), "city", "country", "segment",
            F.when(key % 13 == 0, None).when(F.col("o_orderstatus") == "F", 1)
            .when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("gender_code"),
            F.when(key % 17 == 0, None).otherwise((F.lit(1920) + key % 90).cast("int")).alias("birth_year"),
            F.when(key % 11 == 0, None).otherwise(F.substring("o_orderpriority", 1, 1).cast("int")).alias("rating"),
            F.col("o_orderdate").alias("end_date"))
    )


def spending(spark: SparkSession, d: str) -> DataFrame:
    """Spending columns per order, from one grouping of the lines."""
    key, k = F.col("l_orderkey"), F.col("l_linenumber")

    def amount(i: int) -> Column:
        total = F.sum(F.when(k == i, cents("l_extendedprice"))) / 100.0
        return F.when(key % 7 == i, total * 0.0).otherwise(total).alias(f"Q6_{i}")

    return (
        table(spark, d, "lineitem").where(k <= 5).groupBy(key).agg(*[amount(i) for i in range(1, 6)])
        .withColumnRenamed("l_orderkey", "line_id")
    )


def resp(spark: SparkSession, d: str) -> DataFrame:
    """Census responses: one row per order."""
    return respondents(spark, d).join(
        spending(spark, d), F.col("id") == F.col("line_id"), "left").drop("line_id")


# A maximum over text would make Spark sort all order lines before it can group them; over numbers and
# truth values it groups in hash maps and shuffles one short row per order. Text is restored after.

def _ticks() -> list[Column]:
    return [F.max(F.col("p_type") == o).alias(c) for c, o in zip(MULTI, OPTIONS, strict=True)]


def _tick_labels() -> dict[str, Column]:
    return {c: F.when(F.col(c), F.lit(o)) for c, o in zip(MULTI, OPTIONS, strict=True)}


def _item_codes() -> list[Column]:
    k = F.col("l_linenumber")
    return [F.max(F.when(k == i, F.ascii("l_returnflag"))).alias(c) for i, c in enumerate(BATTERY, 1)]


def _item_answers() -> dict[str, Column]:
    return {c: F.char(F.col(c)) for c in BATTERY}


def multi(spark: SparkSession, d: str) -> DataFrame:
    """Multi-response question: an option's label if ticked, else null."""
    return (
        table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
        .join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("id")).agg(*_ticks()).withColumns(_tick_labels())
    )


def battery(spark: SparkSession, d: str) -> DataFrame:
    """Item battery with answers A, N and R."""
    return (
        table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(*_item_codes())
        .withColumns(_item_answers())
    )


def census(spark: SparkSession, d: str) -> DataFrame:
    """Census responses with spending, multi-response group and battery.

    All three question groups come out of one grouping of the order lines.
    """
    k = F.col("l_linenumber")
    lines = (
        table(spark, d, "lineitem")
        .select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag")
        .join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
    )
    answers = lines.groupBy(F.col("l_orderkey").alias("line_id")).agg(
        *[F.sum(F.when(k == i, cents("l_extendedprice"))).alias(c) for i, c in enumerate(SPEND, 1)],
        *_ticks(), *_item_codes(),
    ).withColumns({
        c: F.when(F.col("line_id") % 7 == i, F.col(c) * 0.0).otherwise(F.col(c) / 100.0)
        for i, c in enumerate(SPEND, 1)
    } | _tick_labels() | _item_answers())
    return respondents(spark, d).join(answers, F.col("id") == F.col("line_id"), "left").drop("line_id")


def cell_grid(spark: SparkSession, d: str) -> DataFrame:
    """Two-level grid: order × medium × place."""
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("medium"),
                 F.col("l_linestatus").alias("place"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def options_text(spark: SparkSession, d: str) -> DataFrame:
    """Delimited multi-select text; options 1, 3 and 5 carry a comma in parentheses."""
    parts = [
        F.when(F.col(c).isNotNull(), F.concat(F.col(c), F.lit(" (new, used)"))) if i % 2 else F.col(c)
        for i, c in enumerate(MULTI, 1)
    ]
    return multi(spark, d).select("id", F.concat_ws(",", *parts).alias("opts"))


def open_text(spark: SparkSession, d: str) -> DataFrame:
    """Open answers: some null, some blank."""
    key = F.col("doc_id")
    return table(spark, d, "documents").select(
        key.alias("id"), "lang", "source",
        F.when(key % 10 == 0, "").when(key % 10 == 1, None).otherwise(F.col("text")).alias("answer"))


def population(spark: SparkSession, d: str) -> DataFrame:
    """Population by place × category."""
    return places(spark, d).groupBy("city", "segment").agg(F.count(F.lit(1)).alias("n"))


def draws(spark: SparkSession, d: str) -> DataFrame:
    """Posterior draws: probabilities add up to 1 per draw and group."""
    sums = (
        table(spark, d, "events")
        .groupBy((F.col("event_id") % 50).alias("draw"), (F.col("user_id") % 5).alias("grp"),
                 F.col("event_type").alias("category"))
        .agg(F.sum(cents("value")).alias("s"))
    )
    whole = sums.groupBy(F.col("draw").alias("_d"), F.col("grp").alias("_g")).agg(F.sum("s").alias("whole"))
    return (
        sums.join(whole, (F.col("draw") == F.col("_d")) & (F.col("grp") == F.col("_g")))
        .select("draw", "grp", "category", (F.col("s") / F.col("whole")).alias("p"))
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Partly answered items."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id", "left")
