"""Near-duplicate documents by MinHash bands and odd sketches.

Documents with equal sets of word shingles are one class. Bands of the MinHash values of a class bring
classes together; their number and width follow from the wanted similarity, so that a pair of just this
similarity shares none with a probability of ``MISS`` at most. The first ``SAMPLES`` values make the
sketch. Within a bucket the odd sketches decide which pairs are
candidates. An odd sketch folds the MinHash values into a bitmap of parities: equal values cancel in
the exclusive or of two sketches, so its population count estimates how many values differ, which for
similar sets is precise. Links found so far hold a bucket together, so a bucket passes on fewer links
than it has classes, never its pairs.

The classes that candidate links connect form clusters. Every class is in one cluster, goes there once
with its full set, and pairs whose sketches allow the wanted similarity are confirmed on the sets,
most similar ones first; a pair that confirmed links already connect needs no test. Components of the
confirmed links are the groups. Buckets and clusters beyond a fixed size are dealt to tasks as pairs
of blocks, in which every two rows meet once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import col, free
from canvass.llm.components import block_pairs, blocks, components
from canvass.session import materialize

#: Probability with which bands may miss a pair of the wanted similarity; most values in a band; values that narrower bands save.
MISS, ROWS, VALUES = 5e-7, 6, 185
SAMPLES = 126
SKETCH = 512  # bits
#: Standard deviations of the estimate by which a candidate may fall short of the wanted similarity: 3e-7 of a normal law are beyond.
SLACK = 5.0
REMEMBERED = 400_000
BUCKET, CLUSTER = 1024, 256

def layout(similarity: float) -> tuple[int, int]:
    """Values in a band and bands: the widest bands of ROWS values or less that need no more than VALUES, single values otherwise."""
    for rows in range(ROWS, 0, -1):
        same = similarity**rows
        bands = 1 if same >= 1 else math.ceil(math.log(MISS) / math.log1p(-same))
        if rows * bands <= VALUES:
            break
    return rows, bands


def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of so many hash functions; fewer are the first of more."""
    draws = np.random.default_rng(20240917).integers(0, 1 << 32, (count, 2), dtype=np.uint64).astype(np.uint32)
    return draws[:, 0] | np.uint32(1), draws[:, 1].copy()


class Shingler:
    """Sorted 64-bit hashes of a text's distinct word shingles."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for w in text.encode().lower().split() if text else ():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        h = np.array(out, np.uint64)
        if not len(h):
            return h
        width = min(self.width, len(h))
        s = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            s = (s ^ h[k: k + len(s)]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(32)
        return np.unique(s)


def samples(sets: list[np.ndarray], count: int = SAMPLES) -> np.ndarray:
    """MinHash values of sets that are not empty, one row each."""
    begin = np.cumsum([0, *(len(s) for s in sets)])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), count), np.uint32)
    for k, (factor, offset) in enumerate(zip(*functions(count), strict=True)):
        out[:, k] = np.minimum.reduceat(x * factor + offset, begin[:-1])
    return out


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Bitmaps in which each (place, value) flips one bit."""
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    bit = (x >> np.uint64(32)) % np.uint64(SKETCH)
    flips = np.bincount((np.arange(len(values))[:, None] * SKETCH + bit.astype(np.int64)).ravel(), minlength=len(values) * SKETCH)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(values), SKETCH), axis=1)


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each sketch of ``a`` (8-byte words) with each of ``b``."""
    z = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        z += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    odd = np.minimum(1 - 2 * np.arange(SKETCH + 1) / SKETCH, 1)
    return (1 + SKETCH / (4 * SAMPLES) * np.log(np.maximum(odd, 1e-3)))[z]


def least_estimate(similarity: float) -> float:
    """Lower estimates are too unlikely for a pair of this similarity."""
    error = np.sqrt(similarity * (1 - similarity) / SAMPLES + (SKETCH / (4 * SAMPLES)) ** 2 * 4 * SAMPLES * (1 - similarity) / SKETCH**2 * 2)
    return similarity - SLACK * error


def band_keys(values: np.ndarray, rows: int, bands: int) -> list[list[int]]:
    keys = np.zeros((len(values), bands), np.uint64)
    for k in range(rows):
        keys = (keys ^ values[:, k: rows * bands: rows].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    keys += np.arange(bands, dtype=np.uint64)
    return keys.view(np.int64).tolist()


def describe(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set, sketch and band keys; empty sets have none of these."""
    shape = layout(similarity)
    count = max(SAMPLES, shape[0] * shape[1])

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at: at + 512]
                sets = [shingle(t) for t in part["text"]]
                full = [s for s in sets if len(s)]
                sketch, keys = [None] * len(sets), [None] * len(sets)
                if full:
                    values = samples(full, count)
                    where = [i for i, s in enumerate(sets) if len(s)]
                    for i, s, k in zip(where, odd_sketches(values[:, :SAMPLES]), band_keys(values, *shape), strict=True):
                        sketch[i], keys[i] = s.tobytes(), k
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets],
                    "digest": [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], "sketch": sketch, "keys": keys})

    return docs.mapInPandas(prints, "doc_id long, n_shingles long, digest binary, sketch binary, keys array<long>")


class Sets:
    """Union of numbered things, by the root of each."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """Links between classes that share a band and whose sketches allow the similarity: a forest of each bucket."""
    least = least_estimate(similarity)
    keyed = classes.select("node", F.explode("keys").alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    block = F.pmod(F.xxhash64("node"), F.col("count")).cast("int")
    dealt = (
        keyed.join(sizes.select("key", blocks(F.col("size"), BUCKET).alias("count")), "key")
        .join(classes.select("node", "sketch"), "node")
        .select("key", "node", "sketch", F.explode(block_pairs(block, F.col("count"))).alias("at"))
        .select("key", "at.first", "at.second", "node", "sketch"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rest is None or not len(rest):
                continue
            group = (rest[["key", "first", "second"]].ne(rest[["key", "first", "second"]].shift())).any(axis=1).to_numpy().cumsum()
            complete = len(rest) if batch is None else int(np.searchsorted(group, group[-1]))
            if not complete:
                continue
            words = np.frombuffer(b"".join(rest["sketch"].iloc[:complete]), np.uint64).reshape(complete, -1)
            nodes = rest["node"].to_numpy()[:complete]
            heads = np.append(np.flatnonzero(np.diff(group[:complete], prepend=0)), complete)
            out = []
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                if b - a == 2:
                    out.append((a, b - 1) if similarities(words[a: b - 1], words[b - 1: b])[0, 0] >= least else None)
                elif b - a > 2:
                    near, left = similarities(words[a:b], words[a:b]) >= least, np.ones(b - a, bool)
                    # From the smallest node outwards, so that the buckets of a group find the same links.
                    for root in range(b - a):
                        front = [root] if left[root] else []
                        left[root] = False
                        for i in front:
                            new = np.flatnonzero(near[i] & left)
                            left[new] = False
                            front += new.tolist()
                            out += [(a + i, a + j) for j in new.tolist()]
            out = np.array([o for o in out if o], dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": nodes[out].min(axis=1), "b": nodes[out].max(axis=1)}).drop_duplicates()
            rest = rest.iloc[complete:]

    return dealt.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second", "node").mapInPandas(link, "a long, b long").distinct()


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def confirmed(docs: DataFrame, members: DataFrame, similarity: float, width: int) -> DataFrame:
    """Links whose full sets reach the similarity; they connect what all such links of the clusters connect.

    ``members`` has node, doc_id of a document of the class, digest, sketch and cluster.
    """
    percent, least = round(similarity * 100), least_estimate(similarity)
    sizes = members.groupBy("cluster").agg(blocks(F.count(F.lit(1)), CLUSTER).alias("count"))
    block = F.pmod(F.xxhash64("node"), F.col("count")).cast("int")
    dealt = members.join(sizes, "cluster").withColumn("at", block_pairs(block, F.col("count"))).drop("count").withColumnRenamed("doc_id", "member_id")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at: at + 256]
                sets = [shingle(t).tobytes() for t in part["text"]]
                same = [xxhash.xxh128_digest(s) == d for s, d in zip(sets, part["digest"], strict=True)]
                yield part.drop(columns=["text", "digest"]).assign(hashes=sets)[same]

    texts = docs.join(dealt, docs["doc_id"] == dealt["member_id"]).select("text", "digest", "cluster", "node", "sketch", "at").mapInPandas(
        sets_of, "cluster long, node long, sketch binary, at array<struct<first int, second int>>, hashes binary")
    grouped = texts.select("cluster", F.explode("at").alias("at"), "node", "sketch", "hashes").select(
        "cluster", "at.first", "at.second", "node", "sketch", "hashes")

    def confirm(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        nodes, n = rows["node"].to_numpy(), len(rows)
        sets = [np.frombuffer(b, np.uint64) for b in rows["hashes"]]
        size = np.array([len(s) for s in sets])
        words = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(n, -1)
        estimate = similarities(words, words)
        fits = 100 * np.minimum(size[:, None], size[None]) >= percent * np.maximum(size[:, None], size[None])
        i, j = np.nonzero(np.triu((estimate >= least) & fits, 1))
        order = np.argsort(-estimate[i, j], kind="stable")
        union, out = Sets(n), []
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if union.root(x) != union.root(y):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    union.join(x, y)
                    out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return grouped.groupBy("cluster", "first", "second").applyInPandas(confirm, "a long, b long")


def near_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents link if the sets of their shingles of ``width`` words (A-Z in lower case) have at least
    this Jaccard similarity, in whole percent; a text with fewer words is one shingle. Null, empty and
    blank texts link with nothing. Rows that repeat an id and text are equal documents. A row with a
    null id links others but has its own group if it has no other id: its component_id is null and it
    is kept.
    """
    plain = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    rows = materialize(describe(plain, width, similarity), "prints")
    classes = materialize(
        rows.where("digest IS NOT NULL").groupBy("digest").agg(
            F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
        .where("doc_id IS NOT NULL").withColumn("node", F.monotonically_increasing_id()), "classes")
    cluster = components(candidates(classes, similarity)).withColumnRenamed("component", "cluster")
    members = materialize(classes.join(cluster, "node").select("node", "doc_id", "digest", "sketch", "cluster"), "members")
    groups = components(confirmed(plain, members, similarity, width))
    first = members.join(groups, "node").groupBy("component").agg(F.min("doc_id").alias("first"))
    named = groups.join(first, "component").select("node", "first")
    of_class = classes.select("digest", "node", F.col("doc_id").alias("least")).join(named, "node", "left").select(
        F.col("digest").alias("of"), F.coalesce("first", "least").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "digest").join(of_class, F.col("digest") == F.col("of"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with its columns.

    Ids are taken to identify documents; rows with a null id all stay. See ``near_groups`` for the rest;
    all columns come through, whatever their names.
    """
    name = free(docs, "_gone")
    gone = materialize(near_groups(docs, similarity, width, id_col, text_col).where("NOT kept").select(
        F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, col(id_col) == F.col(name), "left_anti")
