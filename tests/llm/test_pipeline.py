import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402

from canvass.llm import pieces, quality  # noqa: E402
from canvass.llm.common import table  # noqa: E402
from tests.llm import test_exact_dedup, test_minhash  # noqa: E402

D = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage is judged on what its predecessor kept."""
    docs, kept = table(spark, D, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text", "source").collect()
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.select("doc_id", "text", "source").collect()
        pairs = [(r.doc_id, r.text) for r in before]
        if name == "quality":
            net = quality.train(table(spark, D, "documents"), table(spark, D, "labels"))
            score = quality.probabilities(net, [t for _, t in pairs])
            assert sorted(r.doc_id for r in rows) == sorted(d for (d, _), s in zip(pairs, score, strict=True) if s >= 0.7)
        elif name == "exact dedup":
            assert sorted(r.doc_id for r in rows) == sorted(b[0] for b in test_exact_dedup.brute(pairs) if b[3])
        elif name == "near dedup":
            assert sorted(r.doc_id for r in rows) == [b[0] for b in test_minhash.brute(pairs, 80, 5) if b[3]]
        elif name == "mixing":
            texts = dict(pairs)
            assert all(texts[r.doc_id] == r.text for r in rows)
            size = Counter()
            for r in rows:
                size[r.source] += len(r.text)
            before_size = Counter()
            for r in before:
                before_size[r.source] += len(r.text)
            assert max(size.values()) < 3 * min(size.values()) or len(before) < 500
        else:
            vocabulary = pieces.load()
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before)
            assert all(pieces.decode(vocabulary, r.pieces) == r.text for r in docs.collect())
        if name != "pieces":
            assert docs.columns == columns
        kept.append(len(rows))
    assert kept[0] > kept[1] > kept[2] > 0


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).resolve().parent
    for path in (root / "canvass").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"canvass\.llm|corpus_pipeline", path.read_text())


CLASHING = ["parts", "sums", "_mix_of", "_mix_copy", "_mix_key", "_gone", "_kept_id", "_kept_rows", "_quality", "_copy", "keys", "row", "times", "id", "score"]


def test_clashing_columns_come_through(spark, tmp_path):
    docs = table(spark, D, "documents")
    for k, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.col("doc_id") * 100 + k)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == docs.columns + (["pieces"] if name == "pieces" else [])
        assert out.count() and out.where(" OR ".join(f"{c} IS DISTINCT FROM doc_id * 100 + {k}" for k, c in enumerate(CLASHING))).isEmpty()
        docs = out


def test_empty_documents(spark, tmp_path):
    docs = table(spark, D, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
