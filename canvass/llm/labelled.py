"""Bounded samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import col


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_bytes: int) -> tuple[list[str], list[int], float]:
    """Texts, labels and the share of label 1 among all usable labels.

    At most ``per_class`` texts of each class are taken, those with the smallest hash of their id, none
    longer than ``max_bytes``: that bounds what reaches the driver. ``usable`` is a condition on
    ``doc_id``. Rows with a null id, text or label are not used, nor labels other than 0 and 1; of
    an id's several rows the one with the smallest label is.
    """
    marked = labels.select(col("doc_id").alias("doc_id"), col(label).cast("int").alias("label")).where(
        usable & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = dict(marked.groupBy("label").count().collect())
    order = F.xxhash64("doc_id")
    # Twice as many ids as wanted: some have no document, or one that is too long.
    ids = [marked.where(F.col("label") == y).orderBy(order, "doc_id").limit(2 * per_class) for y in (0, 1)]
    texts = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text")).where(F.octet_length("text") <= max_bytes)
    found = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").dropDuplicates(["doc_id"])
    rows = [r for y in (0, 1) for r in found.where(F.col("label") == y).orderBy(order, "doc_id").limit(per_class).collect()]
    total = sum(counts.values())
    return [r["text"] for r in rows], [r["label"] for r in rows], counts.get(1, 0) / total if total else 0.5
