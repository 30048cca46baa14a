import numpy as np
import pytest

from canvass.llm import embeddings
from canvass.llm.common import table

INF, NAN = float("inf"), float("nan")


def brute(rows, cosine=0.98):
    ok = [v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for k, (_, v, _) in zip(ok, rows, strict=True)]
    links = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
              and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    out, part = [], {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        part[i] = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), part[i], rows[i][0] == part[i]))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1024, 5])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(14):
        base = rng.normal(size=16)
        rows += [(base + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 0.3])) * rng.uniform(0.1, 9) for _ in range(rng.integers(1, 18))]
    rows = [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))) for i, v in enumerate(rows)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [0.0] * 16, 1), (904, [1.0] * 15 + [None], 1), (905, [1.0] * 15 + [NAN], 1), (906, [INF] * 16, 1),
             (907, rows[0][1], None), (908, rows[0][1], None), (None, rows[0][1], rows[0][2]), (5, rows[5][1], rows[5][2]), (910, [1.0, 2.0], 1), (911, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in embeddings.near_groups(df).collect()), key=str) == brute(rows)
    assert embeddings.near_groups(df.limit(0)).count() == 0


def test_corpus(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in embeddings.near_groups(df).collect()), key=str) == brute(rows)


def test_count_is_calibrated():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    line = embeddings.directions(64)[:, 1:]
    hits = (np.abs(a @ line - b @ line) <= embeddings.WINDOW * np.sqrt(0.04)).sum(1)
    assert (hits >= embeddings.least_count(1e-9)).all()
    assert (hits < embeddings.least_count(0.05) + 1).mean() > 0.01
    one = embeddings.collisions((a @ line)[:20], (b @ line)[:300], 0.3)
    assert (one == (np.abs((a @ line)[:20, None] - (b @ line)[None, :300]) <= 0.3).sum(2)).all()
