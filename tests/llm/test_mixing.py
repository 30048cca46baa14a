import math
from collections import Counter

from canvass.llm import mixing

SCHEMA = "doc_id long, text string, source string, mix_copy string"


def corpus(spark):
    rows = [(i, "x" * 10, "big" if i % 10 else "small", "c") for i in range(3000)]
    return spark.createDataFrame(rows, SCHEMA)


def test_shares_and_distribution(spark):
    targets = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("none", 5.0), ("big", 0.0)], "source string, weight double")
    got = mixing.mixture(corpus(spark), targets, seed=3).collect()
    assert sorted(r.position for r in got) == list(range(1, len(got) + 1))
    # "none" has no documents, so its weight falls to the others.
    n = Counter(r.source for r in got)
    assert abs(n["big"] - 1500) < 4 * math.sqrt(1500) and abs(n["small"] - 1500) < 4 * math.sqrt(1500)
    per = Counter(r.doc_id for r in got if r.source == "small")
    mean, counts = 5.0, [per.get(i, 0) for i in range(0, 3000, 10)]
    assert abs(sum((c - mean) ** 2 for c in counts) / len(counts) - mean) < 1.5
    assert {r.copy for r in got} >= {1, 2, 3}
    assert all(max(r.copy for r in got if r.doc_id == i) == per[i] for i in list(per)[:5])


def test_inverse_of_the_distribution(spark):
    df = spark.createDataFrame([(0.3,), (5.0,), (63.9,)], "rate double").select("rate", mixing.distribution(mixing.F.col("rate")).alias("sums"))
    for rate, sums in df.collect():
        want, term = [], math.exp(-rate)
        for k in range(len(sums)):
            want.append(term + (want[-1] if want else 0))
            term *= rate / (k + 1)
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(sums, want, strict=True))
        assert 1 - sums[-1] < 2e-13


def test_large_rates_and_edges(spark):
    rows = [(i, "x", "a", None) for i in range(1000)] + [(5000, "y", None, None), (None, "z", "a", None), (7, "x", "a", None), (8, None, "a", None), (9, "", "e", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([(None, 1.0), ("a", 1.0), ("e", -1.0)], "source string, weight double")
    got = mixing.mixture(docs, targets).collect()
    n = Counter(r.source for r in got)
    assert abs(n[None] - 502) < 100 and abs(n["a"] - 502) < 100 and n["e"] == 0
    twice = Counter(r.copy for r in got if r.doc_id == 7)
    assert all(v == 2 for v in twice.values())
    assert mixing.mix(docs, targets).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0


def test_draws_depend_on_seed_and_id_only(spark):
    a = {tuple(r) for r in mixing.mixture(corpus(spark), seed=1).collect()}
    assert a == {tuple(r) for r in mixing.mixture(corpus(spark).repartition(7), seed=1).collect()}
    assert a != {tuple(r) for r in mixing.mixture(corpus(spark), seed=2).collect()}
