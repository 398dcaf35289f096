"""The operators' queries: each applies one to its whole table and gives the columns that were agreed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import reachable
from quern.llm import centroids, decontaminate, lm, minhash, mixing, neighbours, periods, quality, rans, secrets, simhash, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents")).drop("found")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.flagged(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leaked_items", "best_item", "coverage", F.when(F.col("leaked_items") > 0, 1).otherwise(0).alias("contaminated"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.searched(_table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.scored(docs, _table(spark, sf_dir, "labels"))
    return found.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_round_trip(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.scanned(_table(spark, sf_dir, "documents"), order=periods.looped))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_decontaminate, op3_mix_sources, op4_nearest, op5_quality, op6_language_model, op7_token_files, op8_url_filter, op9_simhash, op10_warc, op11_minhash, op12_periodic_runs, op13_centroids)}

ORACLE_SQL: dict[str, str] = {
    "op1_secrets": secrets.oracle_sql(),
    "op8_url_filter": urls.oracle_sql(),
    "op11_minhash": minhash.oracle_sql(),
    "op13_centroids": centroids.oracle_sql(),
    "op4_nearest": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) AS rank
            FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
        WHERE rank <= 20""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d HAVING count(*) > 1)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (d)""",
}
