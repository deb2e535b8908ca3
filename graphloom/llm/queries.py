"""One query for each document operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, embedding_dedup, html_extract, langid, media, ngram_join, pii, prefix_trie, spelling, substring_dedup, toxicity
from .common import read_table

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(read_table(spark, sf_dir, "documents"))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(read_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_toxicity,
        op3_media_columns,
        op4_bpe_encode_decode,
        op5_pii,
        op6_html_extraction,
        op7_benchmark_decontamination,
        op8_token_counts,
        op9_substring_dedup,
        op10_language_id,
        op11_prefix_trie,
        op12_embedding_near_dedup,
        op13_spelling_variants,
    )
}
#: crc32 of the UTF-8 of an expression, bit by bit.
CRC32 = """xor(list_reduce(list_transform(range(0, 4 * length(hex(encode({0})))), lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(hex(encode({0})), 2 * (i // 8) + 1, 2))::BIGINT ELSE 0 END),
    lambda a, v: xor(xor(a, v) >> 1, CASE WHEN xor(a, v) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295)"""

OP13_SQL = fr"""WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
    c AS (SELECT d, w, count(*) AS k FROM r WHERE length(w) >= 6 GROUP BY ALL), h AS (SELECT w, k, {CRC32.format("(d || ':' || w)")} AS h FROM c),
    x AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, k FROM h),
    v AS (SELECT w, sum(k)::BIGINT AS n FROM x WHERE length(w) >= 6 GROUP BY w HAVING sum(k) >= 5),
    p AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v), m AS (SELECT w, n, left(w, i - 1) || '*' || substr(w, i + 1) AS wild, left(w, i - 1) || substr(w, i + 1) AS cut FROM p),
    e AS (SELECT a.w, b.w AS near FROM m a JOIN m b ON a.wild = b.wild AND a.w <> b.w UNION SELECT m.w, v.w FROM m JOIN v ON m.cut = v.w UNION SELECT v.w, m.w FROM m JOIN v ON m.cut = v.w),
    f AS (SELECT e.w, count(*) AS n_near, first(e.near ORDER BY b.n DESC, e.near) AS best, max(b.n) AS best_n FROM e JOIN v b ON b.w = e.near GROUP BY e.w),
    o AS (SELECT v.w AS word, CASE WHEN best_n >= 5 * v.n THEN best END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN f ON f.w = v.w),
    t AS (SELECT word, word AS root, form AS next FROM o UNION ALL SELECT t.word, o.word, o.form FROM t JOIN o ON o.word = t.next)
    SELECT o.word, o.form, t.root, o.n, o.n_near, o.form_n FROM o JOIN t ON t.word = o.word AND t.next IS NULL"""

OP11_SQL = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
    s AS (SELECT c, count(*) AS own, {CRC32.format("c::VARCHAR")} % 6 AS h, c - c % 100 AS base FROM t GROUP BY c),
    g AS (SELECT s.*, least(s.h, coalesce(b.own, 0)) AS got FROM s LEFT JOIN s b ON b.c = s.base),
    r AS (SELECT g.c, t.pos, role, text FROM g JOIN t ON t.c = g.base AND t.pos < g.got UNION ALL SELECT g.c, t.pos - g.h + g.got, role, text FROM g JOIN t ON t.c = g.c AND t.pos >= g.h),
    p AS (SELECT c, 0 AS d, '' AS k, 0 AS size FROM g UNION ALL SELECT c, pos + 1, string_agg(md5(role || chr(31) || text), ',') OVER (PARTITION BY c ORDER BY pos), length(text) FROM r),
    n AS (SELECT d, k, CASE WHEN d > 1 THEN left(k, length(k) - 33) ELSE '' END AS up, min(c) AS conv_id, count(*) AS n, max(size) AS size FROM p GROUP BY d, k),
    l AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.up = n.k) AS n_children FROM n),
    b AS (SELECT a.d, a.k, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n - 1) * x.size) AS saved FROM l a JOIN l x ON x.d >= a.d AND starts_with(x.k, a.k) GROUP BY a.d, a.k),
    e AS (SELECT p.d, p.k, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS digest FROM p JOIN (SELECT c, max(d) AS last FROM p GROUP BY c) m ON m.c = p.c AND m.last = p.d GROUP BY p.d, p.k)
    SELECT l.conv_id, l.d::BIGINT AS depth, u.conv_id AS parent_conv_id, l.n AS n_convs, l.n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
    FROM l JOIN b ON b.d = l.d AND b.k = l.k LEFT JOIN n u ON u.d = l.d - 1 AND u.k = l.up LEFT JOIN e ON e.d = l.d AND e.k = l.k"""

OP12_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), 'bool_and') AND list_aggregate(list_transform(embedding, lambda x: x <> 0), 'bool_or')),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, m.least) AS component_id, e.vec_id = least(e.vec_id, m.least) AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id"""

ORACLE: dict[str, str] = {"op11_prefix_trie": OP11_SQL, "op12_embedding_near_dedup": OP12_SQL, "op13_spelling_variants": OP13_SQL}
