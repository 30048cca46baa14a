import itertools
import zlib

import pytest

from canvass.llm import sharding


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 1), (2, 4), (3, 1), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_steps_of_one(dims, bits):
    cells = sorted(itertools.product(range(2**bits), repeat=dims), key=lambda c: sharding.hilbert_place(c, bits))
    assert sorted(sharding.hilbert_place(c, bits) for c in cells) == list(range(2 ** (dims * bits)))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(cells))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, hilbert int"


def test_law_and_edges(spark):
    docs = [(i, f"text {i % 7}" * (i % 5), "en" if i % 3 else None, f"http://s{i % 11}", i * i, "x", 0) for i in range(101)]
    docs += [(None, None, None, None, None, None, None), (5, "text 5", "en", "http://s5", 25, "x", 0), (5, "text 5", "en", "http://s5", 25, "x", 0)]
    got = sharding.assign(spark.createDataFrame(docs, SCHEMA), shards=10).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(10))
    assert {len(v) for v in by.values()} <= {10, 11}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(
        ((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in docs), key=str)
    assert sum(r["size"] for r in got) == sum(len((d[1] or "").encode()) + 16 for d in docs)
    along = [r.hilbert for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert along == sorted(along)
    few = sharding.assign(spark.createDataFrame(docs[:3], SCHEMA), shards=40).collect()
    assert len({r.shard for r in few}) == 3
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files_prune_on_every_column(spark, tmp_path):
    docs = spark.range(4000).selectExpr(
        "id doc_id", "concat('t', id) text", "concat('l', id % 16) lang", "concat('s', hash(id) % 16) source", "pmod(hash(id, 1), 1000) n_chars")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=16)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000
    spans = back.groupBy("shard").agg({"n_chars": "max"}).join(back.groupBy("shard").agg({"n_chars": "min"}), "shard").collect()
    assert sum(r["min(n_chars)"] <= 500 <= r["max(n_chars)"] for r in spans) <= 12
    per_shard = back.groupBy("shard").agg({"lang": "approx_count_distinct"}).collect()
    assert sum(r[1] for r in per_shard) / 16 <= 10


def test_one_odd_string_keeps_all_levels(spark):
    docs = [(i, "t", "en", "a" if i == 77 else f"https://host{i:05d}", 1) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.assign(df, dims=("source",), bits=4)
    sizes = [r["count"] for r in got.groupBy("hilbert").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 251
    assert [r.doc_id for r in got.orderBy("hilbert").where("hilbert = 0").collect()].count(77) == 1
