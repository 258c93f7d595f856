"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import decode_ids, digest_ids, encode_texts
from .common import table
from .decontaminate import contaminated
from .embedding_dedup import link_vectors
from .jaccard_join import jaccard_classes
from .language import identify
from .lm_score import score_documents
from .packing import pack
from .periodic_runs import digest_runs, find_runs, repeated_tails
from .pii import digest, find_pii
from .prefix_trie import borrowed_paths, prefix_nodes
from .token_counts import count_tokens
from .token_files import encode_corpus
from .toxicity import score_toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spark, table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(borrowed_paths(table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_runs(find_runs(repeated_tails(table(spark, sf_dir, "documents"))))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_ids(decode_ids(encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_packing, op3_lm_score, op4_jaccard_join, op5_pii, op6_decontamination, op7_toxicity, op8_token_files, op9_language, op10_embedding_dedup, op11_prefix_trie, op12_periodic_runs, op13_byte_bpe)}
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
        m AS (SELECT vec_id, min(c) component_id FROM r GROUP BY vec_id),
        n AS (SELECT a, count(*) n_links FROM l GROUP BY a)
        SELECT m.vec_id, coalesce(n_links, 0) n_links, component_id, m.vec_id = component_id kept FROM m LEFT JOIN n ON n.a = m.vec_id
    """,
    "op11_prefix_trie": r"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                lambda a, x: list_reduce(list_concat([xor(a, x)], [i::BIGINT for i in range(8)]), lambda b, i: xor(b >> 1, (b & 1) * 3988292384))), 4294967295) % 4 AS h FROM t),
        u AS (SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
              UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
        l AS (SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY part, k) FILTER (k IS NOT NULL), []) AS turns FROM c LEFT JOIN u ON u.conv_id = c.conv_id GROUP BY c.conv_id),
        p AS (SELECT conv_id, len(turns) AS last, unnest(range(0, len(turns) + 1)) AS depth, turns FROM l),
        m AS (SELECT conv_id, last, depth, list_slice(turns, 1, depth) AS prefix FROM p),
        n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last = depth), '')) AS ends_sha256 FROM m GROUP BY prefix, depth),
        k AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
        w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.prefix[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN k ON k.prefix = n.prefix),
        a AS (SELECT list_slice(prefix, 1, above) AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
              FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM w) GROUP BY ALL)
        SELECT w.conv_id, w.depth, n.conv_id AS parent_conv_id, w.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
        FROM w JOIN a ON a.prefix = w.prefix LEFT JOIN n ON w.depth > 0 AND n.depth = w.depth - 1 AND n.prefix = list_slice(w.prefix, 1, w.depth - 1)
    """,
}
