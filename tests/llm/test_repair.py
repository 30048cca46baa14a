import functools
import hashlib
import random
import zlib

import pytest

from canvass.llm import repair
from canvass.llm.common import table
from canvass.llm.queries import LLM_QUERIES

SPACES = " \t\n\v\f\r"
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def cheapest(rows):
    """Cost, audit and lines of the repair by trying all edits; rows are (role, text, fault)."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for to in set(follows[state]) - {"s"}:
                cost, letters, lines = best(i, to, inserted + 1)
                ways.append((cost + 2, "I" + letters, (f"{NAMES[to]}:", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, letters, lines = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + letters, lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] and role[0] in follows[state]:
                    cost, letters, lines = best(i + 1, role[0], 0)
                    ways.append((cost + extra, "K" + letters, (f"{role}:{text}", *lines)))
                for to in set(follows[state]) - {"s"}:
                    cost, letters, lines = best(i + 1, to, 0)
                    ways.append((cost + extra + 2, "R" + letters, (f"{NAMES[to]}:{text}", *lines)))
        return min(ways, default=(10**9, "~", ()))

    return best(0, "", 0)


def brute(original, rows):
    out = []
    for conv in {r[0] for r in original}:
        own = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv))
        seen, marked = set(), []
        for _, _, role, text in own:
            plain = text.rstrip(SPACES)
            fault = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, lines = cheapest(tuple(marked))
        turns = [t for known, t, _, _ in own if known]
        count = lambda f: sum(m[2] == f for m in marked)
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), bad,
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def many(n, longest, seed=3):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "Hi."), (None, None, None, None), (900, None, "", "A."), (901, None, None, "B"), (902, 3, "Spoof", "x.")]
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "ua", None, ""]),
                         rng.choice(["One.", "Two!", "half", " \t\n", "", None, "Öde? ", "x" + "." * 40, str(rng.random()) + "."])))
    return rows


@pytest.mark.parametrize(("block", "fan"), [(4096, 256), (3, 2), (1, 3)])
def test_brute_force(spark, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = many(60, 14)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(repair.report(df, df)) == brute(rows, rows)
    assert found(repair.report(df, repair.damaged(df))) == brute(rows, damage(rows))


def test_ties_and_crossings():
    """All short sequences of codes: the same cost and audit as by trying all edits."""
    rng = random.Random(5)
    roles, faults = ["x", "s", "u", "a"], ["", "truncated", "blank"]
    for _ in range(1500):
        codes = [rng.randrange(12) for _ in range(rng.randrange(1, 9))]
        end = repair.best_end([repair.STEPS[c] for c in codes])
        letters, cost = repair.audit(codes, repair.NOTHING, end)
        want = cheapest(tuple((roles[c // 3], str(k), faults[c % 3]) for k, c in enumerate(codes)))
        assert (cost + repair.ENDS[end][0], letters + repair.ENDS[end][1]) == want[:2]


def test_repaired_rows(spark, monkeypatch):
    """The rows of the operator are in order, have legal roles, and make the digest, whatever the blocks."""
    rows = many(30, 20)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, block int")
    want = {r[0]: r[-1] for r in brute(rows, rows)}
    for block in (4096, 4):
        monkeypatch.setattr(repair, "BLOCK", block)
        monkeypatch.setattr(repair, "FAN", 2)
        lines = {}
        for r in sorted(repair.repaired(df).collect(), key=lambda r: (str(r.conv_id), r.row, r.part)):
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in want} == want
    assert repair.repaired(df.limit(0)).count() == 0
    assert repair.report(df.limit(0), df.limit(0)).count() == 0
    assert {tuple(r)[1:8] for r in repair.report(df, df.limit(0)).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 500)
    monkeypatch.setattr(repair, "FAN", 4)
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{t}.") for t in range(20_000)] + [(2, 0, "user", "Q " * 200_000 + "?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repair.report(df, df).collect()}
    codes = [3 * {"user": 2, "assistant": 3}[r[2]] for r in rows[:-1]]
    end = repair.best_end([repair.STEPS[c] for c in codes])
    letters, cost = repair.audit(codes, repair.NOTHING, end)
    assert (got[1].audit, got[1].cost) == (letters + repair.ENDS[end][1], cost + repair.ENDS[end][0])
    assert got[2].audit == "KI"


def test_corpus(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, d, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(LLM_QUERIES["op11_structure_repair"](spark, d)) == brute(rows, damage(rows))
