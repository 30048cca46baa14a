"""The corpus pipeline: quality, exact copies, near copies, mixture, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
reads back as the next stage's documents. All stages but the last return the columns of their documents,
further ones included, whatever their names; the last adds ``pieces`` (a column of that name is
replaced). A null text counts as an empty one; rows with a null id are judged like others and never
near copies of each other; of repeated rows exact deduplication keeps one; an empty table goes through
all stages and stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm import exact_dedup, minhash, mixing, pieces, quality
from canvass.llm.common import free, table
from canvass.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network, fitted on the labels of this stage's documents, does not reject."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on shingles of five words."""
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at the same share of characters; documents are repeated or left out as drawn."""
    return mixing.mix(docs, seed=7)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the numbers of their pieces, under seeded merge dropout that differs between copies."""
    # Equal rows: it makes no difference which of them has which number.
    name = free(docs, "_copy")
    numbered = docs.withColumn(name, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.lit(1))))
    return pieces.encoded(numbered, seed=1, copy_col=name).drop(name)


STAGES = [
    ("quality", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: A fitted network, sketches and segmentation are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
