"""The queries of this subpackage, each with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents
from .common import table
from .jaccard import near_duplicates
from .language_model import score_documents
from .lexical import lexical_search
from .odd_sketch import sketched_duplicates
from .packing import pack_documents
from .prefix_trie import prefix_trie
from .search import exact_top_k, nearest_by_collisions
from .secret_scan import secret_digest
from .sharding import shard_digest
from .token_counts import section_token_counts
from .toxicity import CATEGORIES, score_toxicity


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_collisions(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", *[f"p_{c}" for c in CATEGORIES], "is_toxic")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op13_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketched_duplicates(table(spark, sf_dir, "documents"))


EXACT_TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.w, v.w) AS BIGINT) AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


PREFIX_TRIE = """
WITH t AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT c, c - c % 5 AS base, count(*) AS n, xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % 9 AS h
    FROM t GROUP BY c
), conv AS (
    SELECT o.c, o.base, o.h, least(o.h, coalesce(b.n, 0)) AS first FROM own o LEFT JOIN own b ON b.c = o.base
), turns AS (
    SELECT v.c, t.r AS d, role, text FROM conv v JOIN t ON t.c = v.base WHERE t.r <= v.h
    UNION ALL SELECT v.c, v.first + t.r - v.h, role, text FROM conv v JOIN t ON t.c = v.c WHERE t.r > v.h
), prefixes AS (
    SELECT c, d, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d) AS seq, octet_length(encode(text)) AS bytes FROM turns
    UNION ALL SELECT c, 0, [], 0 FROM conv
), nodes AS (
    SELECT min(c) AS conv, d, seq, count(*) AS n, (count(*) - 1) * min(bytes) AS saved FROM prefixes GROUP BY d, seq
), placed AS (
    SELECT p.c, p.d, n.conv FROM prefixes p JOIN nodes n ON n.d = p.d AND n.seq = p.seq
), ends AS (
    SELECT p.conv, p.d, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids
    FROM placed p JOIN (SELECT c, max(d) AS d FROM prefixes GROUP BY c) l ON l.c = p.c AND l.d = p.d GROUP BY p.conv, p.d
), tied AS (
    SELECT n.conv, n.d, n.n, n.saved, p.conv AS parent FROM nodes n LEFT JOIN placed p ON p.c = n.conv AND p.d = n.d - 1
), children AS (
    SELECT parent, d - 1 AS d, count(*) AS k FROM tied WHERE parent IS NOT NULL GROUP BY parent, d - 1
), totals AS (
    SELECT a.conv, a.d, sum(t.saved) AS saved, count(*) FILTER (WHERE k.k IS NULL) AS leaves
    FROM tied t JOIN placed a ON a.c = t.conv AND a.d <= t.d LEFT JOIN children k ON k.parent = t.conv AND k.d = t.d GROUP BY a.conv, a.d
)
SELECT t.conv AS conv_id, CAST(t.d AS BIGINT) AS depth, t.parent AS parent_conv_id, t.n AS n_convs, coalesce(k.k, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM tied t JOIN totals s ON s.conv = t.conv AND s.d = t.d LEFT JOIN children k ON k.parent = t.conv AND k.d = t.d LEFT JOIN ends e ON e.conv = t.conv AND e.d = t.d
"""


LEXICAL_SEARCH = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
), i AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), q AS (
    SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term
), s AS (
    SELECT count(*) AS n, sum(len(terms)) AS l FROM d WHERE len(terms) > 0
), p AS (
    SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM d) GROUP BY doc_id, term, len
), f AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term
), m AS (
    SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * n) // CAST(l AS BIGINT))))) AS BIGINT) AS score
    FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id
), r AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM m WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_byte_bpe, op2_nearest_neighbours, op3_toxicity, op4_exact_top_k, op5_packing, op6_token_counts, op7_language_model, op8_secret_scan, op9_sharding, op10_jaccard_join, op11_prefix_trie, op12_lexical_search, op13_odd_sketches)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_top_k": EXACT_TOP_K, "op11_prefix_trie": PREFIX_TRIE, "op12_lexical_search": LEXICAL_SEARCH}
