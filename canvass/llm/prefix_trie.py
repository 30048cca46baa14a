"""Trie of the prefixes that conversations share, and what storing them once would save.

Distinct turns (role and text) are numbered, so a conversation is a sequence of whole numbers. Equal
sequences are counted first. The distinct ones are range-partitioned and sorted; every run of ``SHARD``
of them goes into a ternary search tree, by medians, so that its searches stay short. A traversal
without recursion adds up members, leaves and savings from the ends to the root.

Only nodes on the way to a shard's first or last sequence can also lie in another shard. They are not
finished there: what their inner children add up to goes, with their path, into the next round, which
is a trie of far fewer sequences, until one shard holds the rest. So neither the root's members nor
the copies of a conversation ever meet in one task.

Sequences are cut into chunks of ``CHUNK`` turns. Chunks after the first form tries of their own, one
for each distinct beginning, which hang from the trie before them; they are finished first.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.ranking import number_rows
from canvass.llm.common import col
from canvass.session import materialize

CHUNK, SHARD, SEGMENT = 256, 16_384, 1 << 16
#: A turn that makes up more than one in ``COMMON`` of all turns is numbered by a broadcast of at most COMMON turns.
COMMON = 512

SUMS = ("n", "least", "children", "leaves", "saved", "class")
RECORD = "trie string, path array<long>, sizes array<long>, n long, least long, children long, leaves long, saved long, class string"
FOLDED = f"{RECORD}, depth int, final boolean, up long, shard long, place int, above int"


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn (number of the distinct role and text) and the text's bytes; ties of turn go by role, then text.

    Null roles and texts are empty; rows without conv_id are left out; repeated rows are turns of their own.
    """
    empty = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    plain = conversations.select(
        col("conv_id").cast("long").alias("conv_id"), col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).where("conv_id IS NOT NULL")
    named = plain.withColumns({
        "digest": F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)), "bytes": F.octet_length("text").cast("long")})
    numbered = materialize(number_rows(named, ["conv_id"], ["turn", "role", "text"], "n", keep=["digest", "bytes"]), "turns")
    names = materialize(numbered.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).withColumn("number", F.monotonically_increasing_id()), "names")
    total = names.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    common = F.broadcast(names.where(F.col("times") * COMMON > total).select("digest", F.col("number").alias("common")))
    # Common turns need no partner in the second join; a key of their own row spreads them.
    own = F.concat_ws(":", "conv_id", "n").cast("binary")
    placed = numbered.join(common, "digest", "left").withColumn("key", F.when(F.col("common").isNull(), F.col("digest")).otherwise(own))
    placed = placed.join(names.select(F.col("digest").alias("key"), "number"), "key", "left")
    return materialize(placed.select("conv_id", (F.col("n") - 1).alias("pos"), F.coalesce("common", "number").alias("turn"), "bytes"), "encoded")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that begin like conversation c - c % 5 for crc32(c) % 9 turns (all, if that has
    fewer; none, if it is absent) and go on with their own turns after as many."""
    borrowed = F.crc32(F.col("conv_id").cast("string")) % 9
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    convs = lengths.select("conv_id", borrowed.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("there")), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    convs = materialize(convs, "convs")
    heads = turns.where("pos < 8").select(F.col("conv_id").alias("base"), "pos", "turn", "bytes")
    front = convs.where("taken > 0").join(heads, "base").where("pos < taken").select("conv_id", "pos", "turn", "bytes")
    # One row per conversation on one side: a hot conversation's turns are split by adaptive execution.
    back = turns.where(F.col("pos") >= borrowed).join(convs, "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn", "bytes")
    return front.unionByName(back), convs.select("conv_id")


def medians(low: int, high: int) -> Iterator[int]:
    """The numbers from low to high, the middle of every range before its halves."""
    ranges = deque([(low, high)])
    while ranges:
        low, high = ranges.popleft()
        if low < high:
            middle = (low + high) // 2
            yield middle
            ranges += [(low, middle), (middle + 1, high)]


class Ternary:
    """Ternary search trees of several tries; a node's ``equal`` is the root of the search tree of its children."""

    def __init__(self) -> None:
        self.key, self.low, self.equal, self.high, self.up, self.size, self.depth = [], [], [], [], [], [], []
        self.n, self.least, self.children, self.leaves, self.saved, self.name, self.trie = [], [], [], [], [], [], []

    def node(self, key: int, up: int, size: int, trie: str) -> int:
        for column, value in ((self.key, key), (self.low, -1), (self.equal, -1), (self.high, -1), (self.up, up), (self.size, size),
                              (self.depth, self.depth[up] + 1 if up >= 0 else 0), (self.n, 0), (self.least, None), (self.children, 0),
                              (self.leaves, 0), (self.saved, 0), (self.name, None), (self.trie, trie)):
            column.append(value)
        return len(self.key) - 1

    def child(self, up: int, key: int, size: int = -1) -> int:
        """The child with this key, made if it is missing."""
        side, at = self.equal, up
        while side[at] >= 0:
            at = side[at]
            if key == self.key[at]:
                return at
            side = self.low if key < self.key[at] else self.high
        side[at] = self.node(key, up, size, self.trie[up])
        return side[at]

    def add(self, root: int, path, sizes, n: int, least, children: int, leaves: int, saved: int, name) -> None:
        at = root
        for key, size in zip(path, sizes, strict=True):
            at = self.child(at, key, size)
        self.put(at, n, least, children, leaves, saved)
        self.name[at] = self.name[at] or name

    def put(self, at: int, n: int, least, children: int, leaves: int, saved: int) -> None:
        self.n[at] += n
        self.least[at] = least if self.least[at] is None else self.least[at] if least is None else min(self.least[at], least)
        self.children[at] += children
        self.leaves[at] += leaves
        self.saved[at] += saved

    def outward(self, root: int) -> list[int]:
        """All nodes of a trie, each after those above it."""
        order, todo = [], [root]
        while todo:
            at = todo.pop()
            order.append(at)
            todo += [x for x in (self.low[at], self.high[at], self.equal[at]) if x >= 0]
        return order


def grown(rows: list[tuple], shard: int, whole: bool, paths: bool) -> list[tuple]:
    """The nodes of a shard's sorted records: finished ones, and those that other shards may share unless the shard is the whole."""
    tree, roots, edge = Ternary(), [], set()
    starts = [i for i in range(len(rows)) if not i or rows[i][0] != rows[i - 1][0]]
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
        roots.append(tree.node(-1, -1, 0, rows[a][0]))
        for i in medians(a, b):
            tree.add(roots[-1], *rows[i][1:])
    if not whole:
        for root, row in ((roots[0], rows[0]), (roots[-1], rows[-1])):
            edge.add(root)
            for key in row[1]:
                edge.add(root := tree.child(root, key))
    order = [at for root in roots for at in tree.outward(root)]
    for at in reversed(order):
        if at not in edge:
            tree.leaves[at] = tree.leaves[at] if tree.children[at] else 1
            tree.saved[at] += (tree.n[at] - 1) * tree.size[at]
            if tree.up[at] >= 0:
                tree.put(tree.up[at], tree.n[at], tree.least[at], 1, tree.leaves[at], tree.saved[at])
    out, way, sizes = [], {}, {}
    for at in order:
        up, final = tree.up[at], at not in edge
        if paths or not final:
            way[at], sizes[at] = ([*way[up], tree.key[at]], [*sizes[up], tree.size[at]]) if up >= 0 else ([], [])
        out.append((tree.trie[at], way.get(at), sizes.get(at), tree.n[at], tree.least[at], tree.children[at], tree.leaves[at], tree.saved[at], tree.name[at],
                    tree.depth[at], final, tree.least[up] if up >= 0 and up not in edge else None, shard, at, up if up >= 0 and up in edge else None))
    return out


def folded(records: DataFrame, size: int, parts: int | None = None) -> DataFrame:
    """One round: every shard of the sorted records as finished nodes and records of those it may share.

    ``parts`` is the number of partitions; with 0 all records, no more than ``size``, are one shard. Later rounds keep the paths of finished nodes.
    """
    key, whole, paths = ["trie", "path"], parts == 0, parts is not None
    names = [f.split()[0] for f in FOLDED.split(", ")]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count, held = TaskContext.get().partitionId(), 0, []

        def shards(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal count, held
            while held and (last or (len(held) >= size and not whole)):
                run, held = (held, []) if whole else (held[:size], held[size:])
                out = grown(run, (part << 32) + count, whole, paths)
                count += 1
                for at in range(0, len(out), 50_000):
                    frame = pd.DataFrame(out[at: at + 50_000], columns=names)
                    yield frame.astype({c: "Int64" for c in ("least", "up", "above")})

        for batch in batches:
            held += [(t, p.tolist(), s.tolist(), *rest) for t, p, s, *rest in zip(*[batch[c].astype(object).where(batch[c].notna(), None) if c in ("least", "class") else batch[c] for c in batch.columns], strict=True)]
            yield from shards(False)
        yield from shards(True)

    dealt = records.repartition(1) if whole else records.repartitionByRange(*([parts] if parts else []), *key)
    return materialize(dealt.sortWithinPartitions(*key).mapInPandas(build, FOLDED), "folded")


def tries(records: DataFrame) -> DataFrame:
    """All nodes of the records' tries, the roots included: trie, depth, n, least, up (the parent's least member), children, leaves, saved, class."""
    first = folded(records, SHARD)
    shared = first.where("NOT final").select([f.split()[0] for f in RECORD.split(", ")])
    # A shard passes on 2 * (CHUNK + 1) records at most, so every round of shards of this size has at most half as many.
    size, higher = max(SHARD, 8 * (CHUNK + 1)), []
    while (left := shared.count()) > size:
        level = folded(shared, size, left // size + 1)
        higher.append(level.where("final"))
        shared = level.where("NOT final").select(shared.columns)
    higher.append(folded(shared, size, 0))
    upper = higher[0]
    for more in higher[1:]:
        upper = upper.unionByName(more)
    upper = materialize(upper.select("trie", "path", "depth", *SUMS), "upper")
    above = upper.select("trie", F.col("path").alias("over"), F.col("least").alias("up"))
    over = F.when(F.col("depth") > 0, F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))))
    result = ["trie", "depth", *SUMS, "up"]
    known = upper.withColumn("over", over).join(above, ["trie", "over"], "left").select(result)
    # A shard's nodes below a shared one look it up by shard and place, so no key has more than a shard's nodes.
    places = first.where("NOT final").select("trie", "path", "shard", F.col("place").alias("above")).join(
        upper.select("trie", "path", F.col("least").alias("up")), ["trie", "path"]).select("shard", "above", "up")
    inner = first.where("final")
    below = inner.where("above IS NOT NULL").drop("up").join(places, ["shard", "above"]).select(result)
    return known.unionByName(inner.where("above IS NULL").select(result)).unionByName(below)


def ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the conversation ids of each class, ascending and joined by commas: class, ends_sha256.

    Ids are joined in runs where they lie; a class's task, as SHA-256 has no parallel form, only reads the runs.
    """
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, current = [], None
            for name, conv in zip(batch["class"].tolist(), batch["conv_id"].tolist(), strict=True):
                if name != current or len(out[-1][2]) >= SEGMENT:
                    out.append([name, conv, str(conv)])
                    current = name
                else:
                    out[-1][2] += f",{conv}"
            yield pd.DataFrame(out, columns=["class", "first", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, hasher, out = None, None, []
        for batch in batches:
            for name, ids in zip(batch["class"].tolist(), batch["ids"].tolist(), strict=True):
                if name != current:
                    if hasher:
                        out.append((current, hasher.hexdigest()))
                    current, hasher = name, hashlib.sha256(ids.encode())
                else:
                    hasher.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["class", "ends_sha256"])
            out = []
        if hasher:
            yield pd.DataFrame([(current, hasher.hexdigest())], columns=["class", "ends_sha256"])

    joined = members.repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id").mapInPandas(runs, "class string, first long, ids string")
    return joined.repartition("class").sortWithinPartitions("class", "first").mapInPandas(digest, "class string, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``convs`` (conv_id), whose ``turns`` have conv_id, pos, turn and bytes.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Conversations without turns are members of the root only. Without conversations there is no node.
    """
    cut = turns.withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    chunks = materialize(cut.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "bytes"))).alias("t")).select(
        "conv_id", "chunk", F.col("t.turn").alias("path"), F.col("t.bytes").alias("sizes")), "chunks")
    rounds = (chunks.agg(F.max("chunk")).first()[0] or 0) + 1
    none = F.array().cast("array<long>")
    here = convs.join(chunks.where("chunk = 0").drop("chunk"), "conv_id", "left").select(
        "conv_id", F.lit("").alias("trie"), F.coalesce("path", none).alias("path"), F.coalesce("sizes", none).alias("sizes"))
    parts = []
    for k in range(rounds):
        if k:
            here = parts[-1].where("more").select("conv_id", F.col("class").alias("trie")).join(chunks.where(F.col("chunk") == k).drop("chunk"), "conv_id")
        later = chunks.where(F.col("chunk") == k + 1).select("conv_id", F.lit(True).alias("more"))
        here = here.join(later, "conv_id", "left") if k + 1 < rounds else here.withColumn("more", F.lit(False))
        # The digest of everything up to here: sequences are equal exactly if it is.
        name = F.sha2(F.concat_ws(",", F.lit(k).cast("string"), "trie", F.col("path").cast("array<string>")), 256)
        parts.append(materialize(here.withColumns({"more": F.coalesce("more", F.lit(False)), "class": name}), "sequences"))
    zero = F.lit(0).cast("long")
    counted = lambda df: df.groupBy("trie", "path", "class").agg(F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    order = [f.split()[0] for f in RECORD.split(", ")]
    out, hung = None, None
    for k in reversed(range(rounds)):
        records = counted(parts[k].where("NOT more")).withColumns({"children": zero, "leaves": zero, "saved": zero}).select(order)
        if hung is not None:
            records = records.unionByName(counted(parts[k].where("more")).join(hung, "class").select(order))
        nodes = materialize(tries(records), "nodes")
        if k:
            hung = nodes.where("depth = 0").select(F.col("trie").alias("class"), "children", "leaves", "saved")
            # Some members of the node from which the trie hangs end there.
            over = parts[k - 1].groupBy(F.col("class").alias("trie")).agg(F.min("conv_id").alias("up"))
            nodes = nodes.where("depth > 1").unionByName(nodes.where("depth = 1").drop("up").join(over, "trie").select(nodes.columns)).withColumn("depth", F.col("depth") + k * CHUNK)
        out = nodes if out is None else out.unionByName(nodes)
    members = parts[0].where("NOT more").select("class", "conv_id")
    for part in parts[1:]:
        members = members.unionByName(part.where("NOT more").select("class", "conv_id"))
    nobody = F.lit(hashlib.sha256().hexdigest())
    named = out.where("class IS NULL").select(*out.columns, nobody.alias("ends_sha256")).unionByName(out.where("class IS NOT NULL").join(ends(members), "class", "left").select(*out.columns, F.coalesce("ends_sha256", nobody).alias("ends_sha256")))
    return named.select(F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


def shared(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are; see ``encoded`` for nulls, ties and repeated rows and ``trie`` for the columns."""
    turns = encoded(conversations)
    return trie(turns, turns.select("conv_id").distinct())


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as ``rebuilt`` makes them; an empty table gives an empty one, other columns are not read."""
    return trie(*rebuilt(encoded(conversations)))
