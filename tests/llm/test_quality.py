import zlib

import numpy as np
import pytest

from canvass.llm import quality
from canvass.llm.common import table

D = "/root/testdata/sf0.1"


def random_network(seed=1):
    rng = np.random.default_rng(seed)
    n = quality.FILTERS
    return quality.Network(rng.normal(0, 1, (quality.WIDTH, 256, n)), rng.normal(0, 1, n), rng.normal(0, 1, 2 * n), 0.3)


def brute(net, text):
    """Slide, pool and combine byte by byte."""
    raw = text.encode()
    segments = -(-(len(raw) + quality.WIDTH) // quality.SEGMENT)
    raw = raw.ljust(segments * quality.SEGMENT + quality.WIDTH, b"\0")
    peaks = [max(sum(net.filters[j, raw[i + j]] for j in range(quality.WIDTH))[f]
                 for i in range(s * quality.SEGMENT, (s + 1) * quality.SEGMENT)) for s in range(segments) for f in range(quality.FILTERS)]
    peaks = np.array(peaks).reshape(segments, -1)
    chunks = [peaks[s: s + quality.CHUNK].max(0) for s in range(0, max(segments - 1, 1), quality.HOP)]
    chunks = np.maximum(np.array(chunks) + net.bias, 0)
    return 1 / (1 + np.exp(-(np.concatenate([chunks.mean(0), chunks.max(0)]) @ net.weights + net.offset)))


def test_scores_equal_a_byte_by_byte_evaluation(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 3)
    net = random_network()
    texts = ["", None, "a", "word! " * 30, "ü😀" * 60, "x" * 58, "x" * 59, "y" * 700, "\0"]
    assert np.allclose(quality.probabilities(net, texts), [brute(net, t or "") for t in texts], atol=1e-5)
    assert len(quality.probabilities(net, [])) == 0


def test_fit_lowers_the_loss_and_handles_one_class():
    texts = [f"plain words {i} here" for i in range(60)] + [f"PLAIN!! WORDS!! {i} HERE!!" for i in range(20)]
    y = [1] * 60 + [0] * 20
    p = quality.probabilities(quality.fit(texts, y, 0.75, epochs=8), texts)
    assert ((p >= 0.7) == np.array(y)).mean() > 0.95
    assert np.allclose(quality.probabilities(quality.fit(texts[:3], [1] * 3, 1.0), [""]), 0.999)
    assert np.allclose(quality.probabilities(quality.fit([], [], 0.5), ["a"]), 0.5)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, D, "documents"), table(spark, D, "labels")
    got = quality.classify(docs, quality.train(docs, labels, per_class=600)).join(labels, "doc_id")
    rows = [(r.predicted, r.quality) for r in got.where("held_out").collect()]
    assert np.mean([a == b for a, b in rows]) > 0.97
    assert np.mean([a for a, b in rows if b == 1]) > 0.99
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.limit(50).collect())


def test_edges(spark):
    schema = "doc_id long, text string, score string, predicted string, lang string"
    docs = spark.createDataFrame([(None, None, "s", "p", None), (1, "", None, None, "en"), (1, "", None, None, "en"), (2, "é" * 300_000, "x", None, None)], schema)
    net = random_network()
    rows = quality.classify(docs, net).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.classify(docs.limit(0), net).count() == 0
    assert quality.accepted(docs, net).columns == docs.columns
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, quality.train(docs, nothing)).collect()} == {0.5}


@pytest.mark.parametrize("sizes", [[1], [2, 5, 1, 4, 11], [3]])
def test_chunks_cover_all_segments(sizes):
    index, count, first = quality.chunks_of(np.array(sizes))
    assert set(index.ravel()) == set(range(sum(sizes))) and count.sum() == len(index) and list(first) == list(np.cumsum([0, *count[:-1]]))


@pytest.mark.parametrize("labels", [[], [(1, 0, 0), (2, 0, 0)], [(1, 1, 0)]])
def test_without_both_labels_the_stage_keeps_all(spark, labels):
    docs = spark.createDataFrame([(i, f"clean text {i}") for i in range(8)] + [(None, None)], "doc_id long, text string")
    net = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert quality.accepted(docs, net).count() == 9
