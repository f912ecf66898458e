"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import boilerplate, canonical, consensus, linkage, mojibake, packing, survivors, tokenize, variants
from rankloom.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_documents(spark.read.parquet(f"{d}/documents.parquet"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survive(spark.read.parquet(f"{d}/person_candidates.parquet"))


def p2_truths(spark: SparkSession, d: str) -> DataFrame:
    """The votes alone decide, whatever the precedence."""
    return survivors.discover(table(spark, d, "person_candidates")).values


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reach_consensus(spark.read.parquet(f"{d}/corrections.parquet")).items.select("node_id", "corrected_level", "corrected_function")


def p3_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reach_consensus(table(spark, d, "corrections")).items


def p3_analysts(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reach_consensus(table(spark, d, "corrections")).analysts


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(spark.read.parquet(f"{d}/test_data.parquet"), spark.read.parquet(f"{d}/region_overlay.parquet"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.link_people(spark.read.parquet(f"{d}/test_data.parquet"))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return linkage.match_people(spark.read.parquet(f"{d}/authoritative_leaders.parquet"), spark.read.parquet(f"{d}/person_records.parquet"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).select("leader_id", "person_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(spark.read.parquet(f"{d}/documents.parquet"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select("doc_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_bodies(spark.read.parquet(f"{d}/provenance.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_truths": p2_truths, "p3_found": p3_found, "p3_consensus": p3_consensus, "p3_analysts": p3_analysts, "p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found, "p7_matches": p7_matches, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_restored": p10_restored}


P2_SQL = r"""
WITH r AS (
  SELECT *, trim(regexp_replace(lower(coalesce(source_type, '')), '[-_\s]+', ' ', 'g')) AS s,
         regexp_replace(title, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t
  FROM person_candidates WHERE roster_id IS NOT NULL
), k AS (
  SELECT *, CASE WHEN regexp_matches(s, 'filing|proxy|10-?k|annual report') THEN 1 WHEN regexp_matches(s, 'website') THEN 2
                 WHEN regexp_matches(s, 'linkedin') THEN 3 ELSE precedence END AS tier,
         count(*) OVER (PARTITION BY roster_id) AS n
  FROM r
), c AS (
  SELECT roster_id, candidate_id, tier, extracted_at, f.field
  FROM k, (VALUES ('title'), ('age'), ('pay')) f(field)
  WHERE n >= 2 AND coalesce(trim(lower(verification_status)), '') <> 'unverified'
    AND CASE f.field
        WHEN 'title' THEN coalesce(regexp_matches(t, '\p{L}') AND lower(t) NOT IN ('#n/a', 'n/a', 'nan', 'none', 'not disclosed', 'tbd', 'unknown'), false)
        WHEN 'age' THEN coalesce(age BETWEEN 18 AND 100, false)
        ELSE coalesce(pay > 0, false) END
)
SELECT roster_id, field, candidate_id FROM c
QUALIFY row_number() OVER (PARTITION BY roster_id, field ORDER BY tier NULLS LAST, extracted_at DESC NULLS LAST, candidate_id) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL}
