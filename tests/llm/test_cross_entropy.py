import numpy as np
import pyarrow as pa

from canvass.llm import cross_entropy as ce
from canvass.llm import language_model as lm
from tests.llm import test_language_model as base


def by_id(rows):
    return sorted(((r[0] or 0, r[1], r[2], r[3]) for r in rows if r[1]), key=lambda r: r[:3])


def test_one_shuffle_equals_brute_force(spark, monkeypatch):
    """Also with repeated rows, null ids, words and bigrams of any frequency, in many buckets and pieces."""
    rng = np.random.default_rng(3)
    zipf = [(100 + i, " ".join(f"w{k}" for k in rng.zipf(1.3, 60) if k < 10**9)) for i in range(60)]
    monkeypatch.setattr(base, "DOCS", [*base.DOCS, *zipf, zipf[0], (7, "a b " * 5_000), (8, "seldom a seldom thing"), (8, "q seldom thing")])
    monkeypatch.setattr(base, "TARGET", [*base.TARGET, (4, "seldom thing only here w1 w2 seldom thing never only"), (5, zipf[3][1]), (6, "")])
    docs, target = base.frames(spark)
    want, seen = by_id(base.brute(0, 0)), []
    for often, entries, piece in ((4e-6, 1 << 21, 1 << 23), (0.0, 50, 100), (1e-2, 50, 100), (1e-3, 1000, 1000), (2.0, 100, 1 << 23)):
        monkeypatch.setattr(ce, "OFTEN", often)
        monkeypatch.setattr(ce, "ENTRIES", entries)
        monkeypatch.setattr(ce, "PIECE", piece)
        got = ce.compared(docs, target).collect()
        assert len(got) == len(base.DOCS)
        assert all((r.difference is None) == (r.n_words == 0) for r in got)
        seen.append(by_id(got))
        assert np.allclose(seen[-1], want)
    assert all(s == seen[0] for s in seen)


def test_like_a_model_of_tables(spark):
    docs, target = base.frames(spark)
    assert np.allclose(by_id(ce.compared(docs, target).collect()), by_id(lm.scored(docs, lm.train(docs, target)).collect()))


def test_empty_tables_and_clashing_columns(spark):
    docs, target = base.frames(spark)
    assert ce.compared(docs.limit(0), target).count() == 0
    uniform = [r for r in ce.compared(docs, target.limit(0)).collect() if r.n_words]
    vocabulary = {w for _, t in base.DOCS for w in (t or "").lower().split()}
    assert np.allclose([r.target_bits for r in uniform], np.log2(len(vocabulary) + 1))
    named = docs.selectExpr("*", *[f"'x' AS `{c}`" for c in ("row", "key", "v", "kind", "data", "bucket", "target", "background", "n_words")])
    assert by_id(ce.compared(named, target).collect()) == by_id(ce.compared(docs, target).collect())
    texts = docs.selectExpr("cast(doc_id AS string) doc_id", "text")
    assert {r.doc_id for r in ce.compared(texts, target).collect()} == {str(i) if i else None for i, _ in base.DOCS}


def test_packed_arrays_and_numbers(spark):
    arrays = [np.array([3, -1, 1 << 60]), np.zeros(0, np.int64), np.array([7, -8], np.int32)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, ce.unpacked(ce.packed(*arrays)), strict=True))
    words = [b"", b"a", "ä".encode(), b"x" * 100, b"\n"]
    frame = spark.createDataFrame([(w.decode(),) for w in words], "w string")
    for seed in (0, 5):
        got = [r[0] for r in frame.selectExpr(f"-1 - shiftrightunsigned(xxhash64({seed}L, cast(w AS binary)), 1)").collect()]
        assert got == ce.Numbers(seed).of(words).tolist()
        assert ce.Numbers(seed, {-1 - got[1]: 7}).of(words).tolist() == [got[0], 7, *got[2:]]
    assert ce.runs(np.array([1, 1, 2])).tolist() == [0, 2]


def test_sums_of_documents_travel_packed(spark, monkeypatch):
    """Not a row for every document and bucket, of which there are ever more as the corpus grows."""
    rng, kind, seen = np.random.default_rng(5), type(spark.range(1)), []
    docs = spark.createDataFrame([(i, " ".join(f"the w{a} w{b}" for a, b in rng.integers(0, 3000, (20, 2)))) for i in range(400)], "doc_id long, text string")
    old = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, *a, **k: seen.append((f.__name__, old(df, f, *a, **k))) or seen[-1][1])
    monkeypatch.setattr(ce, "OFTEN", 0.1)
    monkeypatch.setattr(ce, "ENTRIES", 1000)
    assert ce.compared(docs, docs.limit(1)).count() == 400
    made = [df.count() for name, df in seen if name == "scored"]
    assert len(made) == 1 and 0 < made[0] <= 400


def test_words_of_parts_of_arrays():
    texts = ["", "a B", None, "  x y", "Z z\n", "x", "", "y", "\x1c\x85a B \t", " ", "Ä é", "q" * 50, ""]
    for array in (pa.array(texts), pa.array(["k", *texts], pa.large_string())[1:], pa.array([*texts, "k"])[:-1]):
        for piece in (1, 7, 1 << 20):
            at = 0
            for part in ce.parts(array, piece):
                found, sizes = ce.split(part)
                want = [lm.words(t) for t in texts[at: at + len(part)]]
                assert found.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]
                at += len(part)
            assert at == len(texts)
    assert [ce.small(np.array(a, np.int64)).dtype.itemsize for a in ([], [-128, 127], [128], [-1, 1 << 40])] == [1, 1, 2, 8]
