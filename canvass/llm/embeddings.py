"""Near-duplicate embeddings by counting collisions in one-dimensional projections.

Vectors are projected on random directions. The projections of two unit vectors at distance d differ
by a normal number of standard deviation d, so a window about the query's own projection catches a
near one with known probability in every projection, and a far one seldom. The number of windows that
catch a pair is binomial; pairs with at least the count that a pair of the wanted cosine reaches with
probability 1 - ``miss`` are verified exactly.

The first projection also deals out the work: it is cut into cells as wide as its own window, so a
pair lies in one cell or in two neighbouring ones. Cells are split into blocks of bounded size, and
every two blocks that may hold a pair meet in one task, which sorts the other projections, counts
collisions and verifies. Tasks return sums and spanning links per vector, never the pairs. Equal
vectors are one class with a count.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import col
from canvass.llm.components import blocks, components
from canvass.llm.minhash import Sets
from canvass.session import materialize

PROJECTIONS, BLOCK = 32, 1024
#: Half width of a counted window, in distances of the least similar pair wanted.
WINDOW = 1.5


def directions(dims: int, seed: int = 11) -> np.ndarray:
    """One dealing and PROJECTIONS counting directions."""
    return np.random.default_rng(seed).normal(size=(dims, PROJECTIONS + 1))


def least_count(miss: float) -> int:
    """The largest count that a pair at the limit reaches with probability 1 - miss or more."""
    p, below = 2 * NormalDist().cdf(WINDOW) - 1, 0.0
    for k in range(PROJECTIONS + 1):
        below += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if below > miss:
            return k
    return PROJECTIONS


def collisions(queries: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """In how many projections each of the others falls into the window about each query."""
    count = np.zeros((len(queries), len(others)), np.uint8)
    for k in range(queries.shape[1]):
        order = np.argsort(others[:, k])
        line = others[order, k]
        low = np.searchsorted(line, queries[:, k] - half)
        high = np.searchsorted(line, queries[:, k] + half, "right")
        for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            count[i, order[a:b]] += 1
    return count


def near_groups(vectors: DataFrame, cosine: float = 0.98, miss: float = 1e-9, id_col: str = "vec_id",
                vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of one label and length link if their cosine in double precision is at least ``cosine``.
    Vectors that are null, empty or zero, or hold null or non-finite components, and those without
    label link with nothing. Repeated rows are vectors of their own, which link with each other. The
    component of a null id's row is the smallest other id of its group, null if there is none.
    """
    rows = vectors.select(
        col(id_col).cast("long").alias("vec_id"), col(label_col).alias("label"), col(vector_col).cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.withColumn("sound", sound), "vectors")
    reach = math.sqrt(2 - 2 * cosine)
    wide = reach * -NormalDist().inv_cdf(miss / 2)
    classes = rows.where("sound").groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("vector")), "classes")

    @F.pandas_udf("long")
    def cell_of(series: pd.Series) -> pd.Series:
        known: dict[int, np.ndarray] = {}
        out = []
        for v in series:
            first = known.setdefault(len(v), directions(len(v))[:, 0]) if len(v) not in known else known[len(v)]
            v = np.asarray(v, float)
            v = v / np.abs(v).max()
            out.append(int(np.floor(v @ first / np.linalg.norm(v) / wide)))
        return pd.Series(out, dtype="int64")

    placed = materialize(classes.select("label", "dims", "node", "copies", "vector", cell_of("vector").alias("cell")), "cells")
    sizes = materialize(placed.groupBy("label", "dims", "cell").agg(blocks(F.count(F.lit(1)), BLOCK).alias("own")), "sizes")
    near = lambda name, step: sizes.select("label", "dims", (F.col("cell") + step).alias("cell"), F.col("own").alias(name))
    around = sizes.join(near("before", 1), ["label", "dims", "cell"], "left").join(near("after", -1), ["label", "dims", "cell"], "left").fillna(0, ["before", "after"])
    here = lambda c, s: F.struct(c.alias("cell"), s.alias("block"))
    me = here(F.col("cell"), F.col("block"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    dealt = placed.join(around, ["label", "dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("own")).cast("int")).select(
        "label", "dims", "node", "copies", "vector", me.alias("me"), F.explode(F.concat(
            F.transform(upto("own"), lambda t: F.struct(F.least(me, here(F.col("cell"), t)).alias("a"), F.greatest(me, here(F.col("cell"), t)).alias("b"))),
            F.transform(upto("before"), lambda t: F.struct(here(F.col("cell") - 1, t).alias("a"), me.alias("b"))),
            F.transform(upto("after"), lambda t: F.struct(me.alias("a"), here(F.col("cell") + 1, t).alias("b"))))).alias("at"))
    dealt = dealt.select("label", "dims", F.col("at.a").alias("a"), F.col("at.b").alias("b"), (F.col("me") == F.col("at.a")).alias("left"), "node", "copies", "vector")
    least = least_count(miss)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["vector"].to_numpy()).astype(float)
        scaled = x / np.abs(x).max(axis=1, keepdims=True)
        scaled /= np.linalg.norm(scaled, axis=1, keepdims=True)
        line = scaled @ directions(x.shape[1])[:, 1:]
        left = part["left"].to_numpy()
        same = bool(left.all())
        q, o = np.flatnonzero(left), np.flatnonzero(left) if same else np.flatnonzero(~left)
        i, j = np.nonzero(collisions(line[q], line[o], WINDOW * reach) >= least)
        if same:
            i, j = i[i < j], j[i < j]
        i, j = q[i], o[j]
        linked = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            linked[s] = np.einsum("ij,ij->i", scaled[i[s]], scaled[j[s]]) >= cosine
        i, j = i[linked], j[linked]
        node, copies = part["node"].to_numpy(), part["copies"].to_numpy()
        n = np.bincount(i, copies[j], len(part)) + np.bincount(j, copies[i], len(part))
        union = Sets(len(part))
        tree = [(min(node[a], node[b]), max(node[a], node[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True) if union.join(a, b)]
        has = np.flatnonzero(n)
        return pd.DataFrame({
            "node": np.append(node[has], [a for a, _ in tree]).astype("int64"), "n": np.append(n[has], np.zeros(len(tree))).astype("int64"),
            "other": pd.array([None] * len(has) + [b for _, b in tree], dtype="Int64")})

    found = materialize(dealt.groupBy("label", "dims", "a", "b").applyInPandas(compare, "node long, n long, other long"), "found")
    groups = components(found.where("other IS NOT NULL"), "node", "other")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    of_class = named.join(first, "component").join(counts, "node", "left").select(
        F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("first").alias("component_id"))
    joined = rows.where("sound").join(of_class, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")))
    alone = rows.where("NOT sound").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    result = ["vec_id", "n_links", "component_id"]
    return joined.select(*result).unionByName(alone.select(*result)).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
