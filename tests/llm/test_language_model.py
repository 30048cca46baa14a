import math
import sys
from collections import Counter

import numpy as np

from canvass.llm import language_model as lm

DOCS = [(1, "a b a b c"), (2, "A b\nc  d"), (3, None), (4, ""), (5, "a b a b c"), (None, "zz a b"), (6, "b b b a a\x0bc" * 3)]
TARGET = [(1, "a b b"), (2, "b c q"), (3, None)]


def frames(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, word string")
    return docs, spark.createDataFrame(TARGET, "item_id long, text string")


def brute(word_share, pair_share):
    split = lambda t: (t or "").lower().split()
    n = Counter(w for _, t in DOCS for w in split(t))
    vocabulary = {w for w, k in n.items() if k >= max(word_share * sum(n.values()), 1)}
    code = lambda t: [w if w in vocabulary else "?" for w in split(t)]

    def fit(texts):
        pair, before, now = Counter(), Counter(), Counter()
        for t in texts:
            ws = code(t)
            for h, w in zip(["^", *ws], ws, strict=False):
                pair[h, w] += 1
                before[h] += 1
                now[w] += 1
        total = sum(pair.values())
        kept = {p: k for p, k in pair.items() if k >= pair_share * total}
        left = {h: 1 - sum(max(k - 0.75, 0) / before[h] for (g, _), k in kept.items() if g == h) for h in ["^", "?", *vocabulary]}
        size = total + 0.5 * (len(vocabulary) + 1)
        return lambda h, w: max(kept.get((h, w), 0) - 0.75, 0) / max(before[h], 1) + left[h] * (now[w] + 0.5) / size

    models = fit([t for _, t in TARGET]), fit([t for _, t in DOCS])
    for p in models:  # each is a distribution over the vocabulary
        for h in ["^", "?", *vocabulary]:
            assert math.isclose(sum(p(h, w) for w in ["?", *vocabulary]), 1)
    out = []
    for i, t in DOCS:
        ws = code(t)
        bits = [sum(-math.log2(p(h, w)) for h, w in zip(["^", *ws], ws, strict=False)) / len(ws) if ws else None for p in models]
        out.append((i, len(ws), *bits))
    return out


def test_brute_force(spark):
    docs, target = frames(spark)
    for shares in ((0.001, 0.0001), (0.1, 0.05)):
        got = {r.doc_id: r for r in lm.scored(docs, lm.train(docs, target, *shares)).collect()}
        for i, n, t, b in brute(*shares):
            assert got[i].n_words == n
            assert (got[i].difference is None) == (t is None)
            if t is not None:
                assert np.allclose([got[i].target_bits, got[i].background_bits, got[i].difference], [t, b, t - b])


def test_empty_tables_and_batches(spark, monkeypatch):
    docs, target = frames(spark)
    model = lm.train(docs.limit(0), target.limit(0))
    assert all(r.difference in (None, 0.0) for r in lm.scored(docs, model).collect())
    assert lm.scored(docs.limit(0), model).count() == 0
    monkeypatch.setattr(lm, "HELD", 1)
    assert lm.count_words(docs).where("word = X'61'").first().n == sum((t or "").lower().split().count("a") for _, t in DOCS)
    assert [x for p in lm.pieces(["aaa", None, "b", ""], 2) for x in p] == ["aaa", None, "b", ""]


def test_rare_words_and_bigrams_of_a_large_corpus_count(spark, monkeypatch):
    monkeypatch.setattr(sys.modules[__name__], "DOCS", [*DOCS, (7, "a b " * 60_000), (8, "seldom a seldom thing"), (8, "q seldom thing")])
    monkeypatch.setattr(sys.modules[__name__], "TARGET", [*TARGET, (4, "seldom thing only here")])
    docs, target = frames(spark)
    want = sorted(((i or 0, n, t, b) for i, n, t, b in brute(0, 0) if n), key=lambda r: r[:3])
    seen = []
    for often in (4e-6, 0.0, 2.0):  # where a bigram is scored makes no difference
        monkeypatch.setattr(lm, "OFTEN", often)
        got = lm.scored(docs, lm.train(docs, target)).collect()
        assert len(got) == len(DOCS)
        seen.append(sorted(((r.doc_id or 0, r.n_words, r.target_bits, r.background_bits) for r in got if r.n_words), key=lambda r: r[:3]))
        assert np.allclose(seen[-1], want)
    assert seen[0] == seen[1] == seen[2]
