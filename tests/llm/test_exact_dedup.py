import hashlib
import re
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canvass.llm import exact_dedup


def brute(docs):
    """(doc_id, keep_id, group_size, kept, sha) per row by a dictionary of normalised texts."""
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    for i, t in docs:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in docs:
        g = groups[norm(t)]
        keep = min(g)[3]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in exact_dedup.exact_groups(df, **how).collect()), key=str)


DOCS = [(1, "a b c"), (2, "abc"), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r"), (6, "abcd" * 40), (7, "abcd " * 40), (8, "abcd" * 39 + "abce"),
        (9, "é ü😀"), (10, "éü😀"), (11, "a b"), (12, "a  b"), (13, "ab"), (None, "ab"), (14, "abcd" * 41), (15, "x"), (15, "x"), (16, "dabc" * 40)]


def test_brute_force(spark):
    for block in (1, 3, 4, 7, 2048):
        assert got(spark, DOCS, block_chars=block) == brute(DOCS)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n", max_size=9), min_size=1, max_size=25))
def test_random_texts(spark, texts):
    docs = list(enumerate(texts))
    assert got(spark, docs, block_chars=2) == brute(docs)


def test_digest_that_collides_is_salted_anew(spark):
    def weak(block, salt):
        return [F.length(block).cast("bigint")] if salt == 0 else exact_dedup.two_hashes(block, salt)
    assert got(spark, DOCS, block_chars=3, digest=weak) == brute(DOCS)


def test_deduplicate_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(i, t, "n", 3) for i, t in DOCS], "doc_id long, text string, name string, level int")
    kept = exact_dedup.deduplicate(df).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted({b[0] for b in brute(DOCS) if b[3]}, key=str)
    assert kept[0].name == "n" and kept[0].level == 3
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0
