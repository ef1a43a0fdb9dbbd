"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .bpe_count import count_tokens
from .common import load
from .language_id import language_of
from .lm_score import score_documents
from .mixing import mix
from .multi_index import near_vectors
from .near_dedup import near_duplicates
from .packing import pack
from .quality import rated
from .warc import archive_pages


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(load(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(load(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(load(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_multi_index": op4_multi_index,
    "op5_language": op5_language,
    "op6_lm_score": op6_lm_score,
    "op7_nearest": op7_nearest,
    "op8_minhash": op8_minhash,
    "op9_token_counts": op9_token_counts,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": r"""
        WITH RECURSIVE tok AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':0') AS d FROM documents),
        doc AS (SELECT *, coalesce(source, chr(0) || 'null') AS s, CAST('0x' || substring(d, 1, 8) AS BIGINT) % 256 AS b FROM tok),
        blk AS (SELECT s, b, CAST(sum(tokens) AS BIGINT) AS t FROM doc GROUP BY ALL),
        src AS (SELECT s, CAST(sum(t) AS BIGINT) AS t FROM blk GROUP BY s),
        p AS (SELECT s, t, t / CAST(sum(t) OVER () AS DOUBLE) AS p FROM src WHERE t > 0),
        ent(k, a) AS (SELECT 0, CAST(0 AS DOUBLE) UNION ALL SELECT k + 1, CASE WHEN (SELECT ln(sum(pow(p, c))) - c * sum(pow(p, c) * ln(p)) / sum(pow(p, c)) >= 0.95 * ln(count(*)) - 1e-12 FROM p) THEN c ELSE a END FROM (SELECT k, a, a + pow(0.5, k + 1) AS c FROM ent WHERE k < 25)),
        lim(k, a) AS (SELECT 0, CAST(0 AS DOUBLE) UNION ALL SELECT k + 1, CASE WHEN (SELECT max(pow(p, c) / t) / min(pow(p, c) / t) <= 2 FROM p) THEN a ELSE c END FROM (SELECT k, a, a + pow(0.5, k + 1) AS c FROM lim WHERE k < 25)),
        e AS (SELECT CASE WHEN (SELECT -sum(p * ln(p)) >= 0.95 * ln(count(*)) - 1e-12 FROM p) THEN 1.0 ELSE (SELECT a FROM ent WHERE k = 25) END AS a),
        l AS (SELECT CASE WHEN (SELECT max(1.0 / t) / min(1.0 / t) <= 2 FROM p) THEN 0.0 ELSE least(1.0, (SELECT a FROM lim WHERE k = 25) + pow(0.5, 25)) END AS a),
        raw AS (SELECT src.s, t, CASE WHEN t > 0 THEN pow(t / (SELECT CAST(greatest(sum(t), 1) AS DOUBLE) FROM src), greatest(e.a, l.a)) END AS raw FROM src, e, l),
        q AS (SELECT s, t, coalesce(raw, 0) / (SELECT coalesce(sum(raw), 1) FROM raw) AS weight, coalesce(raw / t / (SELECT min(raw / t) FROM raw), 1) AS r FROM raw),
        cut AS (SELECT blk.s, blk.b, weight, r, CAST(floor(r) AS BIGINT) AS f, CAST(floor((r - floor(r)) * q.t) AS BIGINT) AS rest, blk.t, coalesce(sum(blk.t) OVER (PARTITION BY blk.s ORDER BY blk.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blk JOIN q ON blk.s = q.s),
        j AS (SELECT doc.*, weight, r, f, CASE WHEN rest <= 0 THEN 0 WHEN before + t <= rest THEN 1 WHEN before < rest THEN CASE WHEN sum(tokens) OVER (PARTITION BY doc.s, doc.b ORDER BY substring(d, 9, 24), doc_id, tokens ROWS UNBOUNDED PRECEDING) <= rest - before THEN 1 ELSE 0 END ELSE 0 END AS more FROM doc JOIN cut ON doc.s = cut.s AND doc.b = cut.b)
        SELECT doc_id, source, tokens, epoch, least(63, CAST(floor((epoch + (b + 0.5) / 256) / greatest(r, 1e-9) * 64) AS INTEGER)) AS block, md5(d || ':' || epoch) AS order_key, round(weight, 6) AS weight
        FROM (SELECT *, CAST(unnest(range(0, f + more)) AS INTEGER) AS epoch FROM j)
    """,
    "op4_multi_index": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) >= 0.9),
        r AS (SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.seen),
        c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e LEFT JOIN n ON n.x = e.vec_id JOIN c ON c.id = e.vec_id
    """,
    "op8_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END, ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
        r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.seen),
        c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
    """,
    "op10_warc": """
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> lead THEN lead END AS refers_to
        FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead
              FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages))
    """,
}
