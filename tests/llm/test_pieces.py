import random
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from canvass.llm import pieces
from canvass.llm.common import table

V = pieces.load()
TEXTS = ["", None, "Hello world", "  two  spaces ", "line\nbreak\tand ünïcödé", "▁ literal ▁", "漢字かな交じり文😀", "a" * 300, "x " * 50,
         "internationalization " * 3, "\x00\x01", " ", "<0x41> <s> </s> <unk>", "the" * 40 + "é" * 30]


def plain(text):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    return model.encode(text)


def test_without_dropout_equals_the_library(monkeypatch):
    texts = [t for t in TEXTS if t and "▁" not in t and "\x00" not in t]
    for short in (40, 0):
        monkeypatch.setattr(pieces, "SHORT", short)
        got = pieces.Encoder(V).encode(texts, list(range(len(texts))))
        assert [g.tolist() for g in got] == [plain(t) for t in texts]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_arrays_and_agenda_agree_and_round_trip(monkeypatch, dropout):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcdeth in▁é") for _ in range(rng.randrange(80))) for _ in range(60)]
    both = []
    for short in (200, 0):
        monkeypatch.setattr(pieces, "SHORT", short)
        both.append([g.tolist() for g in pieces.Encoder(V, 5, dropout).encode(texts, list(range(len(texts))))])
    assert both[0] == both[1]
    assert [pieces.decode(V, g) for g in both[0]] == [t or "" for t in texts]
    if dropout == 1:
        assert all(len(g) >= len(t or "") for g, t in zip(both[0], texts, strict=True))


def test_seeds_places_and_batches_vary_as_they_should(monkeypatch):
    text = "segmentation of representation " * 20
    a = [g.tolist() for g in pieces.Encoder(V, 1, 0.3).encode([text, text, "other"], [1, 2, 3])]
    assert a[0] != a[1]
    assert a[0] != [g.tolist() for g in pieces.Encoder(V, 2, 0.3).encode([text], [1])][0]
    monkeypatch.setattr(pieces, "GATHERED", 1)
    assert a == [g.tolist() for g in pieces.Encoder(V, 1, 0.3).encode([text, text, "other"], [1, 2, 3])]


def test_dropout_rate():
    word = [(f"word{i}representation", 0) for i in range(2000)]
    full = pieces.Encoder(V).side_by_side(word)[1].mean()
    some = pieces.Encoder(V, 3, 0.1).side_by_side(word)[1].mean()
    assert full < some < full * 2


def test_frames(spark):
    schema = "doc_id long, text string, pieces string, n_pieces int"
    docs = spark.createDataFrame([(i or None, t, "p", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "p", 1)], schema)
    out = pieces.encoded(docs, 4, 0.2)
    back = pieces.decoded(out, name="again")
    assert back.where(F.col("again") != F.coalesce("text", F.lit(""))).count() == 0 and back.count() == len(TEXTS) + 1
    want = {r.doc_id: (len(r.pieces), zlib.crc32(b"".join(int(p).to_bytes(4, "little") for p in r.pieces))) for r in out.collect()}
    got = pieces.digests(docs, 4, 0.2).collect()
    assert all(r.lossless and want[r.doc_id] == (r.n_pieces, r.pieces_crc32) for r in got) and len(got) == len(TEXTS) + 1
    assert pieces.digests(docs.limit(0)).count() == 0
    assert pieces.digests(table(spark, "/root/testdata/sf0.01", "documents")).where("NOT lossless").count() == 0


@pytest.mark.parametrize("chunk", [1 << 17, 7])
def test_every_occurrence_has_draws_of_its_own(monkeypatch, chunk):
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    word = "internationalization"
    encoder = pieces.Encoder(V, 5, 0.3)
    one = [g.tolist() for g in encoder.encode([word], [1])][0]
    seen = {tuple(g.tolist()) for g in encoder.encode([word] * 300, list(range(300)))}
    assert len(seen) > 20 and tuple(one) in seen
    # As if each occurrence had been segmented on its own.
    text = " ".join([word, "the", "representation", "the"] * 30)
    names = pieces.WORDS.findall(" " + text)
    drawn = pieces.mixed(pieces.np.arange(len(names), dtype=pieces.np.uint64) * pieces.np.uint64(pieces.MIX[0]) + pieces.np.uint64(
        pieces.mixed((5 * pieces.MIX[2] + pieces.xxhash.xxh64_intdigest(b"9")) & pieces.BITS64)))
    want = [p for w, k in zip(names, drawn.tolist(), strict=True) for p in encoder.agenda(w, encoder.key(w, k))]
    assert next(iter(encoder.encode([text], [9]))).tolist() == want


def test_copies_differ_in_the_pipeline(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "internationalization of representation " * 20)] * 4 + [(None, None)], "doc_id long, text string")
    out = [r.pieces for r in corpus_pipeline.encode_pieces(spark, docs, "").collect()]
    assert len({tuple(p) for p in out if p}) == 4 and len(out) == 5
