"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the white space of the contracts, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(df: DataFrame, name: str) -> str:
    """The name, or with underscores behind it one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, modulus: int, wanted: int) -> Column:
    """Is crc32(id as text) mod ``modulus`` the wanted one? A null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == wanted, F.lit(False))
