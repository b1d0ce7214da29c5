"""The thin queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from segue.llm import collocations, cross_entropy, license_scan, merkle, mil_quality, minhash, packing, piece_bpe, secret_scan, suffix_dedup, syncmers, threshold_search, word_windows
from segue.llm.common import table


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_comparison(table(spark, sf_dir, "documents"))


def op2_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digests(secret_scan.scan(docs, secret_scan.corpus_model(docs)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.top_k(table(spark, sf_dir, "embeddings"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what ``labels`` marks as good; all other documents are the background."""
    docs = table(spark, sf_dir, "documents")
    return cross_entropy.cross_entropy_difference(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mil_quality.score(docs, mil_quality.train(docs, table(spark, sf_dir, "labels")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_word_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_windows.dedup_digests(table(spark, sf_dir, "documents")).drop("longest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_syncmer_fingerprints": op1_syncmer_fingerprints,
        "op2_piece_encoding": op2_piece_encoding,
        "op3_secret_scan": op3_secret_scan,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_minhash_near_duplicates": op5_minhash_near_duplicates,
        "op6_threshold_top_k": op6_threshold_top_k,
        "op7_licence_scan": op7_licence_scan,
        "op8_packing": op8_packing,
        "op9_cross_entropy_difference": op9_cross_entropy_difference,
        "op10_attention_quality": op10_attention_quality,
        "op11_collocations": op11_collocations,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_word_window_dedup": op13_word_window_dedup,
        "pipeline": corpus_pipeline.run,
    }


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM (SELECT DISTINCT ON (vec_id) * FROM v WHERE vec_id % 20 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


OP11_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
c AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
g AS (SELECT lang, size, w[i : i + size - 1] AS q FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) v(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, q, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
k AS (SELECT lang, size, q, f AS a, unnest(range(1, size)) AS cut FROM f WHERE size > 1),
s AS (SELECT k.lang, k.size, k.q, a, l.f AS l, r.f AS r, cut, (2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS score FROM k JOIN f l ON l.lang = k.lang AND l.q = k.q[1 : cut] JOIN f r ON r.lang = k.lang AND r.q = k.q[cut + 1 : k.size]),
b AS (SELECT lang, size, q, a, unnest(arg_min({'l': l, 'r': r, 'score': score}, (score, cut))) FROM s GROUP BY lang, size, q, a),
o AS (SELECT lang, q[i : i + n - 1] AS q, max(f) AS over FROM (SELECT lang, q, f, n, unnest(range(1, size - n + 2)) AS i FROM f, (VALUES (2), (3)) v(n) WHERE size > n) GROUP BY ALL),
z AS (SELECT b.lang, array_to_string(b.q, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.q = b.q WHERE over IS NULL OR 100::HUGEINT * over < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM z) JOIN c USING (lang) WHERE rank <= 2000
"""

OP12_SQL = """
WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS id FROM documents),
crc AS (SELECT id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS v FROM (SELECT id, CAST(doc_id AS VARCHAR) AS s FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT d.id, doc_id, lang, coalesce('=' || lang, '') AS g, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
    text, CASE WHEN crc.v % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS edited FROM d LEFT JOIN crc USING (id)),
h AS (SELECT id, doc_id, g, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(front || coalesce(strlen(edited) || ':' || edited, '-')) AS changed FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM h),
up AS (SELECT 0 AS level, g, pos, n, leaf AS node FROM l UNION ALL
    SELECT level + 1, g, pos // 8, any_value((n + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, g, pos // 8),
roots AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, pos, n, subroot AS node FROM roots UNION ALL
    SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8),
runs AS (SELECT level, g, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM up WHERE n > 1 GROUP BY ALL), top_runs AS (SELECT level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM top WHERE n > 1 GROUP BY ALL),
paths AS (SELECT id, 0 AS part, level, pos // CAST(8 ** level AS BIGINT) % 8 AS spot, nodes FROM l JOIN runs r ON r.g = l.g AND r.run = pos // CAST(8 ** (level + 1) AS BIGINT) UNION ALL
    SELECT id, 1, level, t.pos // CAST(8 ** level AS BIGINT) % 8, nodes FROM l JOIN roots t ON t.g = l.g JOIN top_runs r ON r.run = t.pos // CAST(8 ** (level + 1) AS BIGINT)),
whole AS (SELECT id, list({'spot': spot, 'nodes': nodes} ORDER BY part, level) AS steps FROM paths GROUP BY id),
fold AS (SELECT l.id, changed AS node, coalesce(steps, []) AS steps, 1 AS i FROM l LEFT JOIN whole USING (id) UNION ALL
    SELECT id, sha256(array_to_string(steps[i].nodes[1 : steps[i].spot], '') || node || array_to_string(steps[i].nodes[steps[i].spot + 2 :], '')), steps, i + 1 FROM fold WHERE i <= len(steps)),
folded AS (SELECT id, node FROM fold WHERE i = len(steps) + 1),
proof AS (SELECT id, sha256(coalesce(array_to_string(list_transform(steps, lambda x: array_to_string(x.nodes[1 : x.spot], '') || array_to_string(x.nodes[x.spot + 2 :], '')), ''), '')) AS p FROM l LEFT JOIN whole USING (id))
SELECT doc_id, leaf, subroot, (SELECT node FROM top WHERE n = 1) AS root, p AS proof_sha256, node AS folded_root, node = (SELECT node FROM top WHERE n = 1) AS verified FROM l JOIN roots USING (g) JOIN folded USING (id) JOIN proof USING (id)
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT id, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT id, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
r AS (SELECT id, i FROM (SELECT id, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS low FROM s) WHERE low < doc_id),
k AS (SELECT id, i, word, max(r.i) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) LEFT JOIN r USING (id, i)),
x AS (SELECT id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN x USING (id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_threshold_top_k": OP6_SQL, "op11_collocations": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_word_window_dedup": OP13_SQL}
