import itertools

import numpy as np

from canvass.llm import toxicity
from canvass.llm.common import table

D = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(4), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2), np.zeros(3))
    lengths = [1, 4, 7, 2, 1]
    potential = rng.normal(0, 2, sum(lengths))
    first = np.zeros(sum(lengths), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got, forward, backward = toxicity.marginals(field, potential, first)
    want, at = [], 0
    for n in lengths:
        total = np.zeros(n)
        z = 0
        for path in itertools.product((0, 1), repeat=n):
            s = field.start[path[0]] + sum(potential[at + i] for i in range(n) if path[i]) + sum(field.transitions[a, b] for a, b in itertools.pairwise(path))
            total += np.exp(s) * np.array(path)
            z += np.exp(s)
        want += list(total / z)
        at += n
    assert np.allclose(got, want)


def test_long_chains_stay_finite():
    field = toxicity.Field(np.zeros(4), np.array([[0.5, -1.0], [-1.0, 0.2]]), np.array([0.0, -1.0]), np.zeros(3))
    first = np.zeros(100_000, bool)
    first[0] = True
    for v in (30.0, -30.0):
        assert np.isfinite(toxicity.marginals(field, np.full(100_000, v), first)[0]).all()


def test_spans_and_scores():
    texts = [f"a fine text number {i} with words" for i in range(80)] + [f"Number {i}, you Rotter rotten {'word ' * (i % 4)}end" for i in range(40)]
    field = toxicity.fit(texts, [0] * 80 + [1] * 40, 1 / 3)
    (bad, spans), (good, none), (empty, _) = toxicity.Scorer(field)(["Oh you rotter, go", "a fine text", None])
    assert bad >= 0.7 > 0.5 > good and not none and empty < 0.5
    assert any("rotter" in "Oh you rotter, go"[a:b] for a, b, _ in spans)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, D, "documents"), table(spark, D, "labels")
    got = toxicity.classify(docs, toxicity.train(docs, labels, per_class=800)).join(labels, "doc_id")
    rows = [(r.predicted, r.toxic) for r in got.where("held_out").collect()]
    assert np.mean([a for a, b in rows if b == 1]) > 0.8
    assert np.mean([a for a, b in rows if b == 0]) < 0.01


def test_edges(spark):
    schema = "doc_id long, text string, score string, toxicity string"
    docs = spark.createDataFrame([(None, None, "s", "p"), (1, "", None, None), (1, "", None, None), (2, "é a " * 300_000, "x", None), (3, "!?", None, None)], schema)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = toxicity.train(docs, nothing)
    rows = toxicity.classify(docs, field).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5} and all(r.spans == [] for r in rows)
    assert toxicity.classify(docs.limit(0), field).count() == 0


def test_offsets_count_the_text_itself():
    """Lower-casing the capital I with a dot makes two characters of it."""
    text = "\u0130\u0130\u0130 worthless worthless end"
    at = [m.span() for m in toxicity.TOKEN.finditer(text)]
    assert toxicity.tokens(text)[1:] == ["worthless", "worthless", "end"] and len(at) == len(toxicity.tokens(text))
    (a, b, _), = toxicity.Scorer.spans(text, np.array([0.0, 0.9, 0.8, 0.1]))
    assert text[a:b] == "worthless worthless"
