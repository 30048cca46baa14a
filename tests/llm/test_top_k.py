import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.llm import top_k
from canvass.llm.common import table
from canvass.llm.queries import LLM_QUERIES

INF, NAN = float("inf"), float("nan")


def brute(rows, k=10, every=100):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(sound):
        if i % every == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(q, v, strict=True)), top_k.LEAST), top_k.MOST), j) for m, (j, v) in enumerate(sound) if m != n and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK", block)
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=20) * rng.choice([0.01, 1.0, 3.0])]) for i in range(400)]
    rows += [(1000 + i, rows[100][1]) for i in range(30)] + [(2000, [0.0] * 20), (2001, [0.0] * 20), rows[300], rows[5]]
    rows += [(3000, None), (3100, []), (3101, []), (3200, [1.0] * 19 + [None]), (3300, [1.0] * 19 + [NAN]), (3400, [INF] * 20), (None, rows[0][1])]
    rows += [(4000, [1.0, 2.0]), (4001, [-1.0, 0.5]), (4100, [2.0]), (5000, [1e30] * 3), (5001, [1e30, -1e30, 5.0]), (5002, [-1e30, 0.25, 1.0]), (5003, [4e6] * 3), (6000, [3e5] * 4), (6001, [-2e5, 7e4, 1.0, 0.1]), (6002, [3e5] * 4)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, row string, block int")
    # Components beyond 64 bits take part as the nearest number within.
    near = [(i, v if i is None or not 5000 <= i < 5003 else [min(max(x, top_k.LEAST / 1024), top_k.MOST / 1024) for x in v]) for i, v in rows]
    asked = F.col("vec_id") % 100 == 0
    assert found(top_k.top_k(df, asked)) == brute(near)
    assert found(top_k.top_k(df, F.col("vec_id") % 50 == 0, k=3)) == brute(near, 3, 50)
    assert top_k.top_k(df.limit(0), asked).count() == 0


def test_bounds_prune():
    """A query with its mass in few dimensions drops most candidates before the last block, and none of the best."""
    rng = np.random.default_rng(1)
    x = np.floor(1024 * rng.normal(size=(4000, 64)) * np.exp(-np.arange(64) / 6)).astype(np.int64)
    columns, rest, mass = np.ascontiguousarray(x.T.astype(float)), top_k.masses(x), top_k.masses(x[:50]).T
    for i in range(50):
        alive, scores = top_k.best(x[i].astype(float), mass[i], columns, rest, np.array([i]), -np.inf, 10)
        want = np.sort(np.delete(x @ x[i], i))[-10:]
        assert len(alive) < 2000
        assert (np.sort(scores)[-10:] == want).all()


def test_corpus(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, d, "embeddings").collect()]
    assert found(LLM_QUERIES["op13_columnar_search"](spark, d)) == brute(rows)
