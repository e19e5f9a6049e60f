"""Registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import knn, mixing, neardup, reading, sentences, splitting, tokenizing, topn
from skein.plans.layout import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    items, limits = table(spark, d, "fixed_chunks"), table(spark, d, "chunk_limits")
    return splitting.needed_cuts(items, limits, ["doc_id", "chunk_id"])


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    items, limits = table(spark, d, "fixed_chunks"), table(spark, d, "chunk_limits")
    return splitting.split_oversized(items, limits, ["doc_id", "chunk_id"])


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each strategy's items cover, and how many break the limit or the overlap."""
    items, limits = table(spark, d, "fixed_chunks"), table(spark, d, "chunk_limits")
    pieces = splitting.split_oversized(items, limits, ["doc_id", "chunk_id", "strategy"]).join(limits, "strategy", "left")
    fresh = F.col("end") - F.coalesce("cut_at", F.lit(0))
    return pieces.groupBy("strategy").agg(
        F.count_if(F.col("piece_no") == 0).alias("items"), F.sum(fresh).alias("chars"), F.count_if((F.length("text") > F.col("max_chars")) | (F.length("text") != F.col("end") - F.col("start"))).alias("too_long"),
        F.count_if(F.col("start") != F.greatest(F.col("cut_at") - F.col("overlap_chars"), F.lit(0))).alias("apart"), F.count_if((fresh < 1) & (F.col("piece_no") > 0)).alias("hollow"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "chunks"), "id", "text", least_words=8, similarity=0.7)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "chunks"), "id", "text", least_words=8, similarity=0.7)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.nearest_neighbours(table(spark, d, "chunk_embeddings"), "id", "embedding", dim=64, k=5)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_starts(table(spark, d, "semantic_chunks"), ["doc_id", "chunk_id"], "text", "language")


def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "semantic_chunks"), ["doc_id", "chunk_id"], "text", "language")


def best_results(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "retrieval_results").select(topn.normal_query(F.col("query")).alias("query"), "similarity", "result_id")
    return topn.top_n(rows, "query", "similarity", "result_id", 5, -1.0, 1.0)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return best_results(spark, d).select(F.col("id").alias("result_id"))


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    return best_results(spark, d).select(F.col("group").alias("query"), F.col("score").alias("similarity"), F.col("id").alias("result_id"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def sized_documents(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.count_tokens(table(spark, d, "documents"), ["doc_id", "source"], "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(sized_documents(spark, d), table(spark, d, "mix_targets"))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(cut(sized_documents(spark, d)), table(spark, d, "mix_targets"), "doc_id")[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(cut(sized_documents(spark, d)), table(spark, d, "mix_targets"), "doc_id")[1]


def p7_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source's tokens are within two of its largest documents from its goal, or all used if it is short."""
    return p7_report(spark, d).select("source", "target_share", "max_passes", "within")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).where("level >= 4").select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_coverage, p2_found, p2_groups, p3_found, p4_found, p4_sentences, p5_found, p5_ranked, p6_ids, p7_found, p7_copies, p7_report, p7_within, p8_found, p8_levels)}


RANKED = """
SELECT query, similarity, result_id FROM (
  SELECT query, similarity, result_id, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, result_id) AS place
  FROM (SELECT DISTINCT trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) AS query, similarity, result_id
        FROM retrieval_results WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND similarity BETWEEN -1 AND 1))
WHERE place <= 5"""


#: Every character is in a piece, none is above its limit, and no overlap is off.
COVERED = "SELECT strategy, count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS chars, 0 AS too_long, 0 AS apart, 0 AS hollow FROM fixed_chunks WHERE text IS NOT NULL GROUP BY strategy"


#: Every target must be within its tolerance.
WITHIN = "SELECT source, target_share, max_passes, true AS within FROM mix_targets"


def oracle_sql() -> dict[str, str]:
    return {"p7_within": WITHIN, "p1_coverage": COVERED, "p5_ranked": RANKED, "p5_found": f"SELECT result_id FROM ({RANKED})"}
