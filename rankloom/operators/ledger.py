"""Corrections: summaries and their promotion to rules; provenance; precedence of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import strip

THRESHOLD = 20
KEY = ("archetype", "region", "sub_industry", "title_l")


def keyed(corrections: DataFrame) -> DataFrame:
    """Corrections with the pattern they speak of: archetype, region, sub-industry and folded native title."""
    return corrections.withColumn("title_l", F.lower(strip("original_title_native"))).withColumn("sub_industry", F.coalesce("sub_industry", F.lit("")))


def summary(corrections: DataFrame) -> DataFrame:
    """``kind, value, n``: the total, the number of patterns, and corrections by archetype and by region."""
    k = keyed(corrections)
    n = F.count(F.lit(1)).alias("n")
    none = F.lit(None).cast("string").alias("value")
    return (
        k.agg(n).select(F.lit("total").alias("kind"), none, "n")
        .unionByName(k.select(*KEY).distinct().agg(n).select(F.lit("patterns").alias("kind"), none, "n"))
        .unionByName(k.groupBy(F.col("archetype").alias("value")).agg(n).select(F.lit("archetype").alias("kind"), "value", "n"))
        .unionByName(k.groupBy(F.col("region").alias("value")).agg(n).select(F.lit("region").alias("kind"), "value", "n"))
    )


def top_patterns(corrections: DataFrame, n: int = 10) -> DataFrame:
    """The patterns of most corrections; of equal ones the first seen."""
    return keyed(corrections).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("correction_id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(n)


def verdicts(corrections: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Patterns of at least ``threshold`` corrections with their number, their outcomes and whether they agree."""
    out = keyed(corrections).groupBy(*KEY, "corrected_level", "corrected_function").agg(F.count(F.lit(1)).alias("c"), F.min("correction_id").alias("f"), F.collect_set("analyst_id").alias("a"))
    return (
        out.groupBy(*KEY)
        .agg(F.sum("c").alias("corrections"), F.count(F.lit(1)).alias("outcomes"), F.min_by(F.struct("corrected_level", "corrected_function"), "f").alias("v"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("a")))).alias("analysts"), F.min("f").alias("first_id"))
        .filter(F.col("corrections") >= threshold)
    )


def promotions(corrections: DataFrame, overlay: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Unanimous patterns that the overlay doesn't hold, as new rules. Promoting their result again gives nothing."""
    held = overlay.select(F.lower(strip("title_raw")).alias("title_l"), "region", F.col("archetype_id").alias("archetype"), F.coalesce("sub_industry", F.lit("")).alias("sub_industry")).distinct()
    return verdicts(corrections, threshold).filter("outcomes = 1").join(held, list(KEY), "left_anti").select(*KEY, "v.corrected_level", "v.corrected_function", "corrections", F.size("analysts").alias("n_analysts"))


def disagreements(corrections: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Patterns of enough corrections without consensus."""
    return verdicts(corrections, threshold).filter("outcomes > 1").select(*KEY, "corrections", "outcomes", F.size("analysts").alias("n_analysts"))


def provenance_summary(log: DataFrame) -> DataFrame:
    """``firm_rows, verified, unverified, cache_hits`` by source type."""
    return log.groupBy("source_type").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("verification_status") == "verified").alias("verified"), F.count_if(F.col("verification_status") == "unverified").alias("unverified"), F.count_if(F.coalesce("fetch_cache_hit", F.lit(False))).alias("cache_hits"))


def name_in_source(log: DataFrame, least: float = 0.75) -> DataFrame:
    """``entry_id, matched, tokens, status``: how many words of a name (of three letters or more, if any) occur in its page."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", ""))
    words = F.array_distinct(F.filter(F.split(norm("name"), " +"), lambda x: x != ""))
    long = F.filter(words, lambda x: F.length(x) > 2)
    df = log.select("entry_id", F.when(F.size(long) > 0, long).otherwise(words).alias("w"), norm("raw_evidence").alias("src"))
    df = df.select("entry_id", F.size("w").alias("tokens"), F.size(F.filter("w", lambda x: F.contains("src", x))).alias("matched"))
    return df.select("entry_id", "matched", "tokens", F.when((F.col("tokens") > 0) & (F.col("matched") >= F.col("tokens") * least), "verified").otherwise("unverified").alias("status"))


def resolve_leaders(candidates: DataFrame) -> DataFrame:
    """One leader per folded name: title and source of the highest precedence (ties: first entered), the first-entered
    spelling of the name, board if any source says so. Unverified candidates don't count."""
    prec = F.coalesce("precedence", F.lit(99))
    key = F.regexp_replace(F.lower("name"), "[^a-z]", "")
    return (
        candidates.filter((F.coalesce("verification_status", F.lit("")) != "unverified") & (key != ""))
        .groupBy(key.alias("name_key"))
        .agg(F.min_by("name", "candidate_id").alias("name"), F.min_by(F.struct("title", "source_type", prec.alias("precedence")), F.struct(prec, F.col("candidate_id"))).alias("v"), F.max("is_board").alias("is_board"))
        .select("name_key", "name", "v.title", "v.source_type", "v.precedence", "is_board")
    )
