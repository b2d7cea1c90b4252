"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cell_dedup, dart_minhash, graph_ann, language_id, line_dedup, nnls_packing, piece_roundtrip, ring, token_count, warc

WORD_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op2_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), least=0)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(_table(spark, sf_dir, "pages"), payloads=False)
    return records.where("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op9_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_roundtrip.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_count, op2_graph_neighbours, op3_ring_shards, op4_line_dedup, op5_embedding_dedup, op6_dart_minhash, op7_warc_salvage, op8_nnls_packing, op9_byte_gru, op10_piece_table)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_embedding_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
            s AS (SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND list_dot_product(e, e) > 0),
            links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id
                      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
            reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
            least AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
            many AS (SELECT x, count(*) AS n FROM links GROUP BY x)
            SELECT v.vec_id, coalesce(n, 0) AS n_links, c AS component_id, v.vec_id = c AS kept
            FROM v JOIN least ON least.x = v.vec_id LEFT JOIN many ON many.x = v.vec_id""",
        "op7_warc_salvage": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            q AS (SELECT page_id, h, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY h) AS f FROM p)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
                   CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
            FROM q""",
    }
