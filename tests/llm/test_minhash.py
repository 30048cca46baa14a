import random
import re

import numpy as np
import pytest

from canvass.llm import minhash
from canvass.llm.common import table


def brute(docs, percent=85, width=3):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    sets = []
    for _, t in docs:
        w = split(t)
        sets.append({tuple(w[k: k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)], d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(tuple(r) for r in minhash.near_groups(df, 0.85, 3).collect())


def edited(words, rng, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, monkeypatch, small):
    if small:  # every group needs several blocks
        monkeypatch.setattr(minhash, "BUCKET", 3)
        monkeypatch.setattr(minhash, "CLUSTER", 3)
    rng = random.Random(4)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 300))]
        for _ in range(rng.randrange(1, 14)):
            base = edited(base, rng, rng.randrange(0, 4)) if rng.random() < 0.4 else base
            docs.append(" ".join(edited(base, rng, rng.randrange(0, 8))))
    docs += ["", None, "  ", "a", "A", "a b", "a b c", "a b c d", "x\xa0y z", "Ü b c", "ü b c"]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    assert run(spark, docs) == brute(docs)


def test_corpus(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in minhash.near_groups(table(spark, "/root/testdata/sf0.01", "documents"), 0.85, 3).collect()) == brute(rows)


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(0)
    for j in (0.8, 0.9, 0.97):
        a, b = [], []
        for _ in range(300):
            both = rng.integers(0, 1 << 63, int(1000 * j), dtype=np.uint64)
            own = rng.integers(0, 1 << 63, 1000 - int(1000 * j), dtype=np.uint64)
            a.append(np.concatenate([both, own[::2]]))
            b.append(np.concatenate([both, own[1::2]]))
        sa, sb = (minhash.odd_sketches(minhash.samples(x)).view(np.uint64) for x in (a, b))
        got = np.diag(minhash.similarities(sa, sb))
        assert abs(got.mean() - j) < 0.015 and (got >= minhash.least_estimate(j)).mean() > 0.995


def test_edges(spark):
    schema = "doc_id long, text string, digest string, keys int"
    docs = spark.createDataFrame([(None, "a b c d", "x", 1), (2, "a b c d", "x", 1), (2, "a b c d", "x", 1), (None, "q", None, None), (3, None, None, None), (4, "", "y", 2)], schema)
    got = sorted(map(tuple, minhash.near_groups(docs).collect()), key=str)
    assert got == sorted([(None, 1, 2, False), (2, 1, 2, True), (2, 1, 2, True), (None, 1, None, True), (3, 0, 3, True), (4, 0, 4, True)], key=str)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 2, 3, 4}
    assert minhash.near_groups(docs.limit(0)).count() == 0


def test_bands_hardly_miss_pairs_of_the_wanted_similarity():
    for similarity in (0.5, 0.8, 0.85, 0.9, 1.0):
        rows, bands = minhash.layout(similarity)
        assert (1 - similarity**rows) ** bands <= 5e-7
    rng = np.random.default_rng(5)
    a, b = [], []
    for _ in range(8000):
        both, own = rng.integers(0, 1 << 63, 80, dtype=np.uint64), rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        a.append(np.concatenate([both, own[:10]]))
        b.append(np.concatenate([both, own[10:]]))
    rows, bands = minhash.layout(0.8)
    keys = [minhash.band_keys(minhash.samples(x, rows * bands), rows, bands) for x in (a, b)]
    assert sum(not set(p) & set(q) for p, q in zip(*keys, strict=True)) == 0
