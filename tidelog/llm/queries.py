"""The operators as registered queries: each over its whole table, with production parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, hnsw, nearest_copies, packing, personal_data, pivots, quality, suffixes, toxicity, warc
from tidelog.llm.common import few, table


def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return few(nearest_copies.near_copies(docs), docs)


def exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return pivots.top_k(table(spark, sf, "embeddings"))


def quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf, "embeddings"))


def bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"))


def find_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data.digests(table(spark, sf, "documents"))


def warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    return warc.digest_table(table(spark, sf, "pages"))


def score_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def remove_repeats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = few(suffixes.without_repeats(docs), docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def queries() -> dict:
    return {
        "op1_best_fit_packing": best_fit_packing,
        "op2_minhash_near_dedup": near_duplicates,
        "op3_exact_top_k": exact_top_k,
        "op4_quality_classifier": quality_classifier,
        "op5_nearest_neighbours": nearest_neighbours,
        "op6_bpe_round_trip": bpe_round_trip,
        "op7_personal_data": find_personal_data,
        "op8_warc_derivatives": warc_derivatives,
        "op9_toxicity": score_toxicity,
        "op10_suffix_array_dedup": remove_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": TOP_K_SQL}
