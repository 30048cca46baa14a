"""One query per corpus operator, over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from canvass.llm import cross_entropy, embeddings, exact_dedup, licenses, minhash, mixing, pieces, prefix_trie, quality, repair, sharding, top_k, toxicity
from canvass.llm.common import table


def op1_collision_counting(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.near_groups(table(spark, d, "embeddings"))


def op2_byte_network(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, d, "labels")))


def op3_span_field(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, d, "labels")))


def op4_poisson_mixing(spark: SparkSession, d: str) -> DataFrame:
    """All sources at the same share of characters: which copies of which document, in which order."""
    return mixing.mixture(table(spark, d, "documents"), seed=7)


OP4 = """WITH RECURSIVE have AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) chars FROM documents GROUP BY 1),
rated AS (SELECT source, 1e0 / (SELECT count(*) FROM have WHERE chars > 0)
    * (CAST((SELECT sum(chars) FROM have) AS DOUBLE) / CAST(chars AS DOUBLE)) rate FROM have WHERE chars > 0),
parted AS (SELECT source, greatest(CAST(ceil(rate / 64) AS INT), 1) parts, rate / greatest(CAST(ceil(rate / 64) AS INT), 1) mean FROM rated),
dist AS (SELECT source, parts, mean, 0 k, exp(-mean) term, exp(-mean) sums FROM parted
  UNION ALL SELECT source, parts, mean, k + 1, term * mean / (k + 1), sums + term * mean / (k + 1) FROM dist
  WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
draws AS (SELECT doc_id, source, part, (CAST(CAST('0x' || substr(md5('7:' || doc_id || ':' || part), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0)
    / 4503599627370496e0 u FROM documents JOIN parted USING (source), range(1, 10000) r(part) WHERE part <= parts),
counted AS (SELECT doc_id, source, CAST(sum(n) AS INT) times FROM (
    SELECT doc_id, x.source, part, count(dist.k) n FROM draws x LEFT JOIN dist ON dist.source = x.source AND dist.sums < x.u
    GROUP BY 1, 2, 3) GROUP BY 1, 2),
copied AS (SELECT doc_id, source, CAST(c AS INT) AS copy FROM counted, range(1, 1000000) r(c) WHERE c <= times)
SELECT doc_id, source, copy, row_number() OVER (ORDER BY md5('7:order:' || doc_id || ':' || copy), doc_id, copy) AS position FROM copied"""


def op5_odd_sketches(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_groups(table(spark, d, "documents"), similarity=0.85, width=3)


def op6_hilbert_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.assign(table(spark, d, "documents"))


def op7_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents"))


def op8_block_naming(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, d, "documents"))


OP8 = r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) chars,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') t FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) keep_id,
  count(*) OVER (PARTITION BY t) group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) kept, sha256(t) text_sha256 FROM n"""


def op9_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    """How much more each document is like the benchmark's texts than like the corpus."""
    return cross_entropy.compared(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op10_merge_dropout(spark: SparkSession, d: str) -> DataFrame:
    return pieces.digests(table(spark, d, "documents"), seed=1)


def op11_structure_repair(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with planted faults: what is found and the cheapest repair."""
    talks = table(spark, d, "conversations")
    return repair.report(talks, repair.damaged(talks))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: bit by bit over its bytes, with the reflected polynomial."""
    byte = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda a: CAST(ord(a) AS BIGINT))), lambda c, b: {byte}), 4294967295)"


OP11 = rf"""WITH RECURSIVE spaced AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 draw FROM conversations),
  damaged AS (SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM spaced, range(2) again(k) WHERE draw > 0 AND (k = 0 OR draw = 3)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) i FROM damaged),
  told AS (SELECT *, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END initial,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') short, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) before FROM placed),
  fault AS (SELECT *, again AND NOT blank dup, short AND NOT blank AND NOT again cut FROM told),
  ins(a, b, c, letters, lines) AS (VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', '|user:'), (0, 3, 4, 'II', '|user:|assistant:'), (1, 1, 0, '', ''), (1, 2, 2, 'I', '|user:'),
    (1, 3, 4, 'II', '|user:|assistant:'), (2, 2, 0, '', ''), (2, 3, 2, 'I', '|assistant:'), (2, 2, 4, 'II', '|assistant:|user:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', '|user:'),
    (3, 3, 4, 'II', '|user:|assistant:')),
  best AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) i, 0 state, struct_pack(cost := CAST(0 AS BIGINT), audit := '', lines := '') v FROM damaged UNION ALL
    SELECT conv_id, i, state, min(v) FROM (SELECT f.conv_id, f.i, CASE e WHEN 'D' THEN b WHEN 'K' THEN initial WHEN 'R' THEN CASE b WHEN 2 THEN 3 ELSE 2 END END state,
      struct_pack(cost := CAST(v.cost + c + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN cut AND e <> 'D' THEN 1 ELSE 0 END AS BIGINT), audit := v.audit || letters || e,
        lines := v.lines || replace(ins.lines, '|', chr(10)) || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
          ELSE chr(10) || CASE b WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || text END) v
      FROM best JOIN ins ON a = state JOIN fault f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i + 1, (VALUES ('D'), ('K'), ('R')) act(e)
      WHERE e = 'D' OR (NOT blank AND NOT again AND (e = 'R' OR (b = 0 AND initial IN (1, 2)) OR initial = CASE b WHEN 2 THEN 3 WHEN 0 THEN -1 ELSE 2 END))) t GROUP BY 1, 2, 3),
  n AS (SELECT conv_id, count(*) rows, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) gaps, count(*) FILTER (blank) blank, count(*) FILTER (dup) duplicate,
    count(*) FILTER (cut) truncated, count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) illegal FROM fault GROUP BY 1),
  final AS (SELECT n.conv_id, min(struct_pack(cost := v.cost + c, audit := v.audit || letters, lines := v.lines || replace(ins.lines, '|', chr(10)))) v
    FROM n JOIN best ON best.conv_id IS NOT DISTINCT FROM n.conv_id AND best.i = n.rows JOIN ins ON a = state AND ((a = 0 AND b = 0) OR (a > 0 AND b = 3)) GROUP BY 1)
  SELECT o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
    coalesce(v.cost, 0) AS cost, coalesce(v.audit, '') audit, sha256(coalesce(substr(v.lines, 2), '')) repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN final ON final.conv_id IS NOT DISTINCT FROM o.conv_id"""


def op12_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.report(table(spark, d, "conversations"))


OP12 = f"""WITH own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) l
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  h AS (SELECT *, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 h FROM own),
  seq AS (SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) l FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
  m AS (SELECT conv_id, len(l) = d AS whole, l[1:d] p, d FROM (SELECT *, unnest(range(len(l) + 1)) d FROM seq) t),
  node AS (SELECT p, d, min(conv_id) conv_id, count(*) n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (whole), '')) ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(p[d].x)) END own_saved FROM m GROUP BY p, d),
  kids AS (SELECT p[1:d - 1] p, d - 1 d, count(*) n FROM node WHERE d > 0 GROUP BY 1, 2),
  told AS (SELECT node.*, coalesce(n, 0) n_children FROM node LEFT JOIN kids USING (p, d)),
  sums AS (SELECT p[1:e] p, e d, count(*) FILTER (n_children = 0) n_leaves, sum(own_saved) saved FROM (SELECT *, unnest(range(d + 1)) e FROM told) t GROUP BY 1, 2)
  SELECT t.conv_id, CAST(t.d AS BIGINT) AS "depth", up.conv_id parent_conv_id, t.n_convs, t.n_children, n_leaves, CAST(saved AS BIGINT) saved_tokens, t.ends_sha256
  FROM told t JOIN sums s ON s.d = t.d AND s.p = t.p LEFT JOIN node up ON t.d > 0 AND up.d = t.d - 1 AND up.p = t.p[1:t.d - 1]"""


def op13_columnar_search(spark: SparkSession, d: str) -> DataFrame:
    return top_k.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


OP13 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_sum(list_transform(range(1, 1 + len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


LLM_QUERIES = {
    "op1_collision_counting": op1_collision_counting,
    "op2_byte_network": op2_byte_network,
    "op3_span_field": op3_span_field,
    "op4_poisson_mixing": op4_poisson_mixing,
    "op5_odd_sketches": op5_odd_sketches,
    "op6_hilbert_sharding": op6_hilbert_sharding,
    "op7_license_scan": op7_license_scan,
    "op8_block_naming": op8_block_naming,
    "op9_cross_entropy": op9_cross_entropy,
    "op10_merge_dropout": op10_merge_dropout,
    "op11_structure_repair": op11_structure_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_columnar_search": op13_columnar_search,
    "pipeline": corpus_pipeline.run,
}
LLM_SQL = {"op4_poisson_mixing": OP4, "op8_block_naming": OP8, "op11_structure_repair": OP11, "op12_prefix_trie": OP12, "op13_columnar_search": OP13}
if corpus_pipeline.ORACLE_SQL:
    LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
