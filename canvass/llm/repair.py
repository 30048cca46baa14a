"""Repair of the structure of conversations by divide and conquer.

A repaired conversation has the role initials ``(s?(ua)+)?``. Each of its rows is kept, given another
role or deleted, and empty rows may be inserted; the cheapest edits are wanted and, of equally cheap
ones, those whose audit (the initials K, R, D, I of the edits in order) comes first in ASCII order.
After each row the repaired part is in one of four states: nothing yet, or after a system, user or
assistant row.

As in Hirschberg's method no table of all rows is kept: a vector of four costs is carried forward from
the start and another backward from the end; they meet in the middle, the best state there is chosen,
and both halves are done the same way. Forward vectors also carry the order of the least audits that
lead to the four states, which settles ties: audits of different states always differ before one of
them ends, so the order after a row follows from the order before it.

Conversations are cut into blocks of ``BLOCK`` rows, however long they are. A block acts on the states
like a single row does; ``FAN`` blocks make one node of the next level, until one is left, and the
chosen states go down the same way. No task holds more than a block or the nodes of a parent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.ranking import number_rows
from canvass.llm.common import SPACE, col
from canvass.session import materialize

BLOCK, FAN = 4096, 256
# Costs of the edits, and what a truncated row adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# States and role initials have the same numbers. The one role that may be inserted after each state.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
# A row's code is 3 times the number of its initial (0: another one) plus its fault.
SOUND, SHORT, MUST_GO = range(3)
#: Number of the part after the last block of a conversation that has several.
TAIL = 1 << 40
EDITS = T.StructType([T.StructField("audit", T.StringType()), T.StructField("cost", T.LongType())])

Steps = list[tuple[int, int, int, object]]


def steps_of(code: int) -> Steps:
    """How a row leads from state to state: (from, to, cost, letters), the cheapest and then least of each kind."""
    initial, fault = divmod(code, 3)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        at, cost, letters = start, 0, ""
        for _ in range(3):  # a third insertion leads back to a state that was there before
            ways = [(at, DELETE, "D")]
            if fault != MUST_GO:
                extra = TRUNCATED if fault == SHORT else 0
                if initial == NEXT[at] or (at == NOTHING and initial == SYSTEM):
                    ways.append((initial, extra, "K"))
                ways.append((NEXT[at], REROLE + extra, "R"))
            for to, more, letter in ways:
                way = (cost + more, letters + letter)
                best[start, to] = min(best.get((start, to), way), way)
            at, cost, letters = NEXT[at], cost + INSERT, letters + "I"
    return [(a, b, cost, letters) for (a, b), (cost, letters) in best.items()]


STEPS = [steps_of(code) for code in range(12)]
LETTERS = [{(a, b): letters for a, b, _, letters in steps} for steps in STEPS]
COSTS = [{(a, b): cost for a, b, cost, _ in steps} for steps in STEPS]
# What must follow the last row in each state.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
NEVER = float("inf")


def forward(parts: list[Steps], low: int, high: int, start: int) -> tuple[list[float], list[int]]:
    """Least costs of the four states after parts low to high, and the order of their least audits."""
    costs, ranks = [NEVER] * 4, [0] * 4
    costs[start] = 0
    for k in range(low, high):
        best: list = [None] * 4
        for a, b, cost, key in parts[k]:
            if costs[a] < NEVER:
                way = (costs[a] + cost, ranks[a], key)
                if best[b] is None or way < best[b]:
                    best[b] = way
        costs = [w[0] if w else NEVER for w in best]
        ranks = [0] * 4
        for rank, (_, b) in enumerate(sorted((w[1:], b) for b, w in enumerate(best) if w)):
            ranks[b] = rank
    return costs, ranks


def backward(parts: list[Steps], low: int, high: int, end: int) -> list[float]:
    """Least costs from the four states before parts low to high to the end state."""
    costs = [NEVER] * 4
    costs[end] = 0
    for k in range(high - 1, low - 1, -1):
        before = [NEVER] * 4
        for a, b, cost, _ in parts[k]:
            before[a] = min(before[a], costs[b] + cost)
        costs = before
    return costs


def crossings(parts: list[Steps], start: int, end: int) -> list[int]:
    """The states between the parts on the cheapest and then least way, with start and end."""
    states = [start] + [end] * len(parts)
    todo = [(0, len(parts))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        costs, ranks = forward(parts, low, middle, states[low])
        rest = backward(parts, middle, high, states[high])
        states[middle] = min((costs[s] + rest[s], ranks[s], s) for s in range(4) if costs[s] < NEVER)[2]
        todo += [(middle, high), (low, middle)]
    return states


def best_end(parts: list[Steps]) -> int:
    costs, ranks = forward(parts, 0, len(parts), NOTHING)
    return min((costs[s] + ENDS[s][0], ranks[s], s) for s in range(4) if costs[s] < NEVER)[2]


def audit(codes: list[int], start: int, end: int) -> tuple[str, int]:
    """Letters and cost of the edits of a block between two states."""
    states = crossings([STEPS[c] for c in codes], start, end)
    moves = list(zip(codes, pairwise(states), strict=True))
    return "".join(LETTERS[c][m] for c, m in moves), sum(COSTS[c][m] for c, m in moves)


def flat(parts: list[Steps]) -> list[int]:
    """The parts as a single one, whose keys are the order of the audits from each state, in one list."""
    out: list[int] = []
    for start in range(4):
        costs, ranks = forward(parts, 0, len(parts), start)
        for end in range(4):
            if costs[end] < NEVER:
                out += [start, end, int(costs[end]), ranks[end]]
    return out


def unflat(values) -> Steps:
    values = [int(v) for v in values]
    return [tuple(values[i: i + 4]) for i in range(0, len(values), 4)]


@F.pandas_udf(EDITS)
def whole_audit(codes: pd.Series) -> pd.DataFrame:
    """Edits of conversations of one block."""
    known: dict[bytes, tuple[str, int]] = {}
    out = []
    for c in codes:
        c = c.tolist()
        if (key := bytes(c)) not in known:
            end = best_end([STEPS[x] for x in c])
            letters, cost = audit(c, NOTHING, end)
            known[key] = letters + ENDS[end][1], cost + ENDS[end][0]
        out.append(known[key])
    return pd.DataFrame(out, columns=["audit", "cost"])


@F.pandas_udf(EDITS)
def block_audit(codes: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([audit(c.tolist(), s, e) for c, s, e in zip(codes, start, end, strict=True)], columns=["audit", "cost"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def block_steps(codes: pd.Series) -> pd.Series:
    return pd.Series([flat([STEPS[x] for x in c.tolist()]) for c in codes])


@F.pandas_udf(T.ArrayType(T.LongType()))
def node_steps(children: pd.Series) -> pd.Series:
    return pd.Series([flat([unflat(c) for c in parts]) for parts in children])


@F.pandas_udf(T.IntegerType())
def root_end(steps: pd.Series) -> pd.Series:
    return pd.Series([best_end([unflat(s)]) for s in steps], dtype="int32")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def child_states(children: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([crossings([unflat(c) for c in parts], s, e) for parts, s, e in zip(children, start, end, strict=True)])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by crc32(conv_id:turn) % 20; a null is one space, but a null turn stays null.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats
    it, 4 makes it a user's. Equal rows are damaged alike.
    """
    space = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    return conversations.select(
        col("conv_id").alias("conv_id"), col("turn").alias("turn"),
        F.when(draw == 4, "user").otherwise(space("role")).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text")).alias("text"),
        F.explode(F.when(draw == 0, F.array().cast("array<int>")).when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    ).drop("again")


def keyed(conv_id: Column) -> Column:
    """A key that a null id has too."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("null"))


def lined_up(conversations: DataFrame) -> DataFrame:
    """The rows with the key of their conversation and their row in it from 0, by turn (nulls first), role and text.

    A null role or text is one space. Written down once.
    """
    space = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    plain = conversations.select(keyed(col("conv_id")).alias("key"), col("turn").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    numbered = number_rows(plain, ["key"], ["turn", "role", "text"], "n")
    return materialize(numbered.select("key", (F.col("n") - 1).alias("row"), "turn", "role", "text"), "rows")


def coded(rows: DataFrame) -> DataFrame:
    """Key, row, number of the role's initial and faults of each row; the first fault of a row counts."""
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    first = rows.groupBy("key", "role", F.sha2("text", 256).alias("digest")).agg(F.min("row").alias("row")).select(
        "key", "row", F.lit(True).alias("first"))
    blank = ~F.col("text").rlike("[^" + SPACE[1:-1] + "]")
    flagged = rows.select("key", "row", number.alias("initial"), blank.alias("blank"), (~F.col("text").rlike(r"[.!?]" + SPACE + r"*\z")).alias("open"))
    flagged = flagged.join(first, ["key", "row"], "left")
    repeats = ~F.col("blank") & F.col("first").isNull()
    return materialize(flagged.select("key", "row", "initial", "blank", repeats.alias("duplicate"), (~F.col("blank") & ~repeats & F.col("open")).alias("truncated")), "coded")


def in_blocks(codes: DataFrame) -> DataFrame:
    """One row per block: its codes in order."""
    code = F.col("initial") * 3 + F.when(F.col("blank") | F.col("duplicate"), MUST_GO).when(F.col("truncated"), SHORT).otherwise(SOUND)
    gathered = codes.groupBy("key", F.floor(F.col("row") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("row", code.cast("int").alias("code"))))["code"].alias("codes"))
    return materialize(gathered, "blocks")


def edits(blocks: DataFrame) -> DataFrame:
    """Per block its state before, the audit of its edits and their cost; a conversation of several blocks has
    another, empty one at ``TAIL`` for what is inserted after its last row."""
    short = (F.col("block") == 0) & (F.size("codes") < BLOCK)
    done = blocks.where(short).select("key", "block", F.lit(NOTHING).alias("start"), whole_audit("codes").alias("e")).select("key", "block", "start", "e.*")
    long = blocks.where(~short)
    if long.isEmpty():
        return done
    level = materialize(long.select("key", F.col("block").alias("node"), block_steps("codes").alias("steps")), "steps")
    families = []
    while level.agg(F.max("node")).first()[0] > 0 or not families:
        family = materialize(level.groupBy("key", F.floor(F.col("node") / FAN).alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct("node", "steps")))["steps"].alias("children")), "family")
        families.append(family)
        level = materialize(family.select("key", F.col("parent").alias("node"), node_steps("children").alias("steps")), "steps")
    states = level.select("key", "node", F.lit(NOTHING).alias("start"), root_end("steps").alias("end"))
    tails = states.select("key", F.lit(TAIL).cast("long").alias("block"), F.col("end").alias("start"),
                          F.element_at(F.array(*[F.lit(t) for _, t in ENDS]), F.col("end") + 1).alias("audit"),
                          F.element_at(F.array(*[F.lit(c).cast("long") for c, _ in ENDS]), F.col("end") + 1).alias("cost"))
    for family in reversed(families):
        chosen = family.join(states.withColumnRenamed("node", "parent"), ["key", "parent"]).select(
            "key", "parent", child_states("children", "start", "end").alias("s"))
        states = chosen.select("key", "parent", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 2)).alias("i")).select(
            "key", (F.col("parent") * FAN + F.col("i")).alias("node"), F.get("s", F.col("i")).alias("start"), F.get("s", F.col("i") + 1).alias("end"))
    parts = long.join(states.withColumnRenamed("node", "block"), ["key", "block"]).select(
        "key", "block", "start", block_audit("codes", "start", "end").alias("e")).select("key", "block", "start", "e.*")
    return done.unionByName(parts).unionByName(tails)


def edited(rows: DataFrame, changes: DataFrame, whole: bool = False) -> DataFrame:
    """The repaired rows and those deleted: key, row, part, edit, role and text after the edit, in order by (row, part).

    The edits of a block meet its rows in one pass over sorted partitions. With ``whole`` a conversation
    lies in one partition, in order; otherwise its blocks spread.
    """
    none = F.lit(None).cast("string")
    marks = changes.select("key", "block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("row"), F.col("start").cast("int"), "audit", none.alias("role"), none.alias("text"))
    texts = rows.select("key", F.floor(F.col("row") / BLOCK).alias("block"), F.lit(1).alias("kind"), "row", F.lit(0).alias("start"), none.alias("audit"), "role", "text")
    order = ["key", "block", "kind", "row"]
    both = marks.unionByName(texts).repartition(*(["key"] if whole else ["key", "block"])).sortWithinPartitions(*order)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, place, state, at = "", 0, NOTHING, ("", 0)
        names = ["key", "row", "part", "edit", "role", "text"]

        def inserted(out: list) -> None:
            nonlocal place, state
            part = 0
            while place < len(letters) and letters[place] == "I":
                state = NEXT[state]
                out.append((*at, part, "I", NAMES[state], ""))
                place, part = place + 1, part + 1

        for batch in batches:
            out: list = []
            for key, block, kind, row, start, told, role, text in batch.itertuples(index=False, name=None):
                if kind == 0:
                    inserted(out)
                    letters, place, state, at = told, 0, int(start), (key, int(block) * BLOCK)
                    continue
                at = (key, int(row))
                inserted(out)
                letter = letters[place]
                place += 1
                if letter == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                elif letter == "R":
                    state = NEXT[state]
                    role = NAMES[state]
                # Behind any insertions before the row; those after the last row of a block come later still.
                out.append((*at, 3, letter, role, text))
                at = (key, int(row) + 1)
            if out:
                yield pd.DataFrame(out, columns=names)
        out = []
        inserted(out)
        if out:
            yield pd.DataFrame(out, columns=names)

    return both.mapInPandas(apply, "key string, row long, part int, edit string, role string, text string")


def digests(ordered: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's repaired ``role:text`` lines. SHA-256 has no parallel form, so the rows of a
    conversation stream through one task; none are held."""
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, hasher, out = None, None, []
        for batch in batches:
            for key, edit, role, text in zip(batch["key"], batch["edit"], batch["role"], batch["text"], strict=True):
                if key != current:
                    if hasher:
                        out.append((current, hasher.hexdigest()))
                    current, hasher, lines = key, hashlib.sha256(), 0
                if edit != "D":
                    hasher.update((("\n" if lines else "") + f"{role}:{text}").encode())
                    lines += 1
            if out:
                yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
                out = []
        if hasher:
            yield pd.DataFrame([(current, hasher.hexdigest())], columns=["key", "repaired_sha256"])

    return ordered.mapInPandas(digest, "key string, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, row, part, edit, role, text; ``row`` and ``part`` order the rows of one.

    Rows are taken by turn (nulls first), then role and text; repeated rows are rows of their own, so all
    but the first of them go. A null role or text is one space, a role that begins with none of s, u, a is
    replaced or its row deleted. Null ids are one conversation. An empty table gives an empty one; other
    columns are not read.
    """
    rows = lined_up(conversations)
    names = conversations.select(keyed(col("conv_id")).alias("key"), col("conv_id").alias("conv_id")).distinct()
    return edited(rows, edits(in_blocks(coded(rows)))).where("edit <> 'D'").join(names, "key").select("conv_id", "row", "part", "edit", "role", "text")


def report(original: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``original``: faults found in the rows of ``conversations``, cost and audit of the repair and
    the digest of the result. Conversations without rows have zeros, an empty audit and the digest of an empty text.

    See ``repaired`` for nulls, ties, repeated rows and empty tables.
    """
    rows = lined_up(conversations)
    codes = coded(rows)
    blocks = in_blocks(codes)
    changes = materialize(edits(blocks), "edits")
    # Initials before and at a row, that of an earlier block's last row for the first one.
    initials = F.transform("codes", lambda c: F.floor(c / 3).cast("int"))
    legal = lambda a, b: (4 * a + b).isin(4 * SYSTEM + USER, 4 * USER + ASSISTANT, 4 * ASSISTANT + USER)
    pairs = F.zip_with(F.slice("i", 1, F.size("i") - 1), F.slice("i", 2, F.greatest(F.size("i") - 1, F.lit(0))), lambda a, b: F.when(legal(a, b), 0).otherwise(1))
    inner = blocks.select("key", "block", initials.alias("i")).select(
        "key", "block", F.get("i", F.lit(0)).alias("first"), F.element_at("i", -1).alias("last"), F.aggregate(pairs, F.lit(0), lambda s, x: s + x).alias("n"))
    previous = inner.select("key", (F.col("block") + 1).alias("block"), F.col("last").alias("before"))
    illegal = inner.join(previous, ["key", "block"], "left").groupBy("key").agg(
        F.sum(F.col("n") + F.when(F.col("before").isNotNull() & ~legal(F.col("before"), F.col("first")), 1).otherwise(0)).alias("illegal"))
    counts = codes.groupBy("key").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    gaps = rows.where("turn IS NOT NULL").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg(
        (F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.count("turn")).alias("gaps"))
    told = changes.groupBy("key").agg(F.sum("cost").alias("cost"), F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit")))["audit"], "").alias("audit"))
    out = original.select(col("conv_id").alias("conv_id"), keyed(col("conv_id")).alias("key")).distinct()
    for part in (gaps, counts, illegal, told, digests(edited(rows, changes, whole=True))):
        out = out.join(part, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
