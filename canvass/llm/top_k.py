"""Exact top-k search by inner product of whole numbers: columnar branch and bound.

Queries meet all rows in cells of one block of queries and one of candidates, both of bounded size. In a
cell the candidates lie dimension by dimension. A query takes the blocks of ``WIDTH`` dimensions in which
it has most mass first and adds up partial products; what the blocks left can still add is at most the
sum of the products of both sides' masses in them (the Cauchy-Schwarz bound of each). Candidates that
cannot reach the query's k-th best lower bound any more are dropped, and the survivors are compacted.

Before that every query has met one block of candidates: its k-th score there is a bound that prunes in all
other cells. A cell returns k rows per query at most. No result is approximate: the bounds have room
for rounding, and products are added in a type that holds them exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import col
from canvass.session import materialize

SCALE, WIDTH = 1024, 8
#: Most components in a block of queries or candidates, on average.
BLOCK = 1 << 21
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Sound rows with a row number of their own: row, vec_id, dims, and floor(1024 * x) of each component as ``vector``."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    plain = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("v"))
    sound = plain.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    number = lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(MOST)), F.lit(LEAST))
    return materialize(sound.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dims"), F.transform("v", number).alias("vector")), "vectors")


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which no inner product of rows of both is rounded."""
    if not a.size or not b.size:
        return np.int64
    largest = max(-int(a.min()), int(a.max())) * max(-int(b.min()), int(b.max())) * a.shape[1]
    return np.float64 if largest < 1 << 53 else np.int64 if largest <= MOST else object


def masses(x: np.ndarray) -> np.ndarray:
    """Norms of the blocks of dimensions, one row each, rounded up a little."""
    squares = x.astype(np.float64) ** 2
    return np.stack([np.sqrt(squares[:, i: i + WIDTH].sum(axis=1)) for i in range(0, x.shape[1], WIDTH)] or [np.zeros(len(x))]) * (1 + 1e-12)


def best(query: np.ndarray, mass: np.ndarray, columns: np.ndarray, rest_of: np.ndarray, out: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact products of all candidates that may be among the k best; ``columns`` has one row per dimension.

    ``out`` has the places that do not take part; ``bound`` is a score that k candidates reach anywhere.
    """
    alive = np.delete(np.arange(columns.shape[1]), out)
    partial = np.zeros(len(alive), columns.dtype)
    rest = mass @ rest_of if not len(out) else mass @ rest_of[:, alive]
    room = 1e-9 * rest.max(initial=0) + 1
    whole = not len(out)
    for b in np.argsort(-mass, kind="stable") if columns.shape[0] else []:
        part = slice(b * WIDTH, (b + 1) * WIDTH)
        partial = partial + query[part] @ (columns[part] if whole else columns[part, alive])
        rest = rest - mass[b] * (rest_of[b] if whole else rest_of[b, alive])
        if len(alive) > k:
            low = partial - rest
            bound = max(bound, np.partition(low, len(low) - k)[len(low) - k] - room)
        keep = partial + rest >= bound - room
        if 2 * np.count_nonzero(keep) <= len(keep):
            alive, partial, rest, whole = alive[keep], partial[keep], rest[keep], False
    return alive, partial


def search_cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a cell for each of its queries: query_row, query_id, row, vec_id, score."""
    names = ["query_row", "query_id", "row", "vec_id", "score"]
    if not len(queries) or not len(rows):
        return pd.DataFrame(columns=names, dtype="int64")
    q, x = (np.stack(d["vector"].to_numpy()).astype(np.int64).reshape(len(d), -1) for d in (queries, rows))
    kind = exact_type(q, x)
    ids, number = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
    where = {n: i for i, n in enumerate(number.tolist())}
    found = []
    if kind is not object:
        columns, rest_of, mass = np.ascontiguousarray(x.T.astype(kind)), masses(x), masses(q).T
    q = q.astype(kind)
    for i, (own, query_id, bound) in enumerate(zip(queries["row"].tolist(), queries["vec_id"].tolist(), queries["bound"].tolist(), strict=True)):
        out = np.array([where[own]] if own in where else [], dtype=np.int64)
        if kind is object:
            alive = np.delete(np.arange(len(x)), out)
            scores = np.array([min(max(s, LEAST), MOST) for s in (x[alive].astype(object) @ q[i]).tolist()], dtype=np.int64)
        else:
            alive, scores = best(q[i], mass[i], columns, rest_of, out, -np.inf if bound is None or np.isnan(bound) else bound, k)
            scores = scores.astype(np.int64)
        if len(scores) > k:
            top = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            alive, scores = alive[top], scores[top]
        order = np.lexsort((number[alive], ids[alive], -scores.astype(object) if kind is object else -scores))[:k]
        found.append(np.stack([np.full(len(order), own), np.full(len(order), query_id), number[alive][order], ids[alive][order], scores[order]], axis=1))
    return pd.DataFrame(np.concatenate(found).astype(np.int64), columns=names)


def top_k(vectors: DataFrame, asked: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the largest inner products for each row for which ``asked``, a condition on ``vec_id``, holds:
    query_id, rank, vec_id, score; all other rows, if there are fewer. Ties go to the smaller vec_id.

    Components are floor(1024 * x). Rows without id or vector, and those with null or non-finite
    components, take no part. A query's own row is no candidate; a repeated row is, and asks for
    itself if it is a query. Only vectors of the same length are compared; empty ones have product 0.
    Numbers and scores beyond 64 bits become the nearest one within. An empty table gives an empty one;
    other columns are not read.
    """
    rows = whole_numbers(vectors, id_col, vector_col)
    size = rows.agg(F.coalesce(F.sum("dims"), F.lit(0)), F.coalesce(F.sum(F.when(asked, F.col("dims"))), F.lit(0))).first()
    # Cells of bounded size, and enough of them for all tasks; the numbers change nothing in the result.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_rows, n_asked = max(-(-size[0] // BLOCK), tasks), max(-(-size[1] // BLOCK), 1)
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["dims", "asked", "block"]
    queries = rows.where(asked).select("dims", block(n_asked, 1).alias("asked"), "row", "vec_id", "vector")
    candidates = rows.select("dims", block(n_rows, 2).alias("block"), "row", "vec_id", "vector")
    types = "query_row long, query_id long, row long, vec_id long, score long"

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            return search_cell(q, x, k)
        left = left.select([F.col(c).alias(c) for c in left.columns])  # columns of its own, as both sides come from one table
        return left.groupBy(*cell).cogroup(right.withColumn("asked", each(n_asked)).groupBy(*cell)).applyInPandas(search, types)

    none = F.lit(None).cast("double")
    seeds = materialize(meet(queries.withColumn("block", F.lit(0)).withColumn("bound", none), candidates.where("block = 0")), "seeds")
    bounds = seeds.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("bound"))
    others = meet(queries.join(bounds, "row", "left").withColumn("block", each(n_rows)).where("block > 0"), candidates.where("block > 0"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    ranked = seeds.unionByName(others).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
