"""One query for each operator of this subpackage, over the whole of its tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, jaccard, lm, mixing, pii, quality, secrets, substring, topk
from ._common import read


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors)


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(read(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_top_k,
        op2_lm_scores,
        op3_pii,
        op4_token_counts,
        op5_jaccard_join,
        op6_source_mix,
        op7_decontamination,
        op8_secrets,
        op9_quality,
        op10_substring_dedup,
    )
}

#: Lower-cases A-Z only.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op5_jaccard_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex({_FOLD}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), g AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)
        ), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), link AS MATERIALIZED (
            SELECT a, b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
            ) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
            WHERE 100 * i >= 90 * (na.n + nb.n - i)
        ), reach AS (
            SELECT doc_id, doc_id AS to_id FROM documents
            UNION
            SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.to_id
        )
        SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
        FROM documents LEFT JOIN n USING (doc_id)
        JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
    """,
    "op7_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents
        ), b AS (
            SELECT item_id, list_filter(string_split_regex({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + 7], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM b WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT n FROM bw), hits AS (
            SELECT doc_id, i, x.n, bw.item_id
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n) x
            JOIN bw ON bw.n = x.n AND bw.win = array_to_string(x.w[x.i : x.i + x.n - 1], ' ')
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
        ), it AS (
            SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
    "op10_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), win AS (
            SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
        ), gone AS (
            SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS p
            FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id GROUP BY doc_id
        ), o AS (
            SELECT d.doc_id, w, coalesce(p, []) AS p FROM d LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(p, i)), ' ')) AS kept_sha256
        FROM o
    """,
}
