import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from canvass.llm import prefix_trie
from canvass.llm.common import table
from canvass.llm.queries import LLM_QUERIES


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        if not kids[node]:
            leaves[node] = 1
        if node:
            saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode())
            kids[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items()), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def many(n, longest, seed=7):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "lost"), (100_000, None, None, None), (100_000, None, "", ""), (-3, 0, "user", "a"), (-4, 1, "user", "b"), (-5, 0, "user", "a")]
    for conv in range(n):
        if conv % 11 == 5:
            continue
        same = rng.random() < 0.3
        for turn in range(rng.randrange(1, longest)):
            text = f"{turn} ö" if same else rng.choice(["a", "b", "ü", "", None, "long " * 9])
            rows.append((conv, rng.choice([turn, turn, turn, None]) if not same else turn, "user" if same else rng.choice(["user", "assistant", None]), text))
    return rows


@pytest.mark.parametrize(("chunk", "shard"), [(256, 16384), (256, 7), (3, 16384), (2, 5)])
def test_brute_force(spark, monkeypatch, chunk, shard):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "SEGMENT", 10)
    rows = many(90, 11)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, digest string")
    assert found(prefix_trie.report(df)) == brute(rows)
    assert found(prefix_trie.shared(df)) == brute(rows, rebuild=False)


def test_one_beginning_and_copies(spark, monkeypatch):
    """A turn that all share, and a conversation that a third of them copy, over many small shards."""
    monkeypatch.setattr(prefix_trie, "SHARD", 40)
    rng = random.Random(2)
    rows = []
    for conv in range(900):
        rows.append((conv, 0, "system", "Same."))
        rows += [(conv, t, "user", f"copy {t}" if conv % 3 == 0 else rng.choice("abcdef") * 3) for t in range(1, 5)]
    rows += [(1000, t, "user", f"deep {t}") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(prefix_trie.shared(df)) == brute(rows, rebuild=False)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.report(df).count() == 0 == prefix_trie.shared(df).count()


def test_median_insertion_keeps_searches_short():
    tree = prefix_trie.Ternary()
    root = tree.node(-1, -1, 0, "")
    for i in prefix_trie.medians(0, 1023):
        tree.add(root, [i], [1], 1, i, 0, 0, 0, None)
    depth = {root: 0}
    for at in tree.outward(root):
        for side in (tree.low, tree.high, tree.equal):
            if side[at] >= 0:
                depth[side[at]] = depth[at] + 1
    assert max(depth.values()) == 10


def test_corpus(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, d, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(LLM_QUERIES["op12_prefix_trie"](spark, d)) == brute(rows)
