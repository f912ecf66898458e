"""Sources and sinks: uploads, rule files, logs and exports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.people import canonical_headers

ROW_CAP = 200_000

LEDGER = "correction_id long, node_id string, firm string, archetype string, archetype_version int, region string, sub_industry string, original_title_native string, original_title_en string, original_level int, original_function string, corrected_level int, corrected_function string, corrected_reports_to_id string, correction_reason string, analyst_id string, timestamp string"
PROVENANCE = "entry_id long, name string, title string, source_url string, source_type string, raw_evidence string, verification_status string, verification_detail string, llm_call_id string, fetch_cache_hit boolean, extracted_at string, firm string, engagement_id string"


class UnsupportedUpload(ValueError):
    """The file's extension isn't one that can be read."""


class EmptyUpload(ValueError):
    """The file has no rows."""


def read_upload(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """People from CSV, TSV, TXT, JSON (a list, or an object with ``records``), JSON lines or Excel, all columns as text.

    Headers of tables are made canonical, those of JSON are kept. ``cap`` (``ROW_CAP`` in the service) limits rows where asked for.
    """
    kind = os.path.splitext(path)[1].lower()
    if kind in (".csv", ".tsv", ".txt"):
        df = canonical_headers(spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "," if kind == ".csv" else "\t").csv(path))
    elif kind in (".json", ".jsonl"):
        df = spark.read.option("multiLine", kind == ".json").option("primitivesAsString", True).json(path)
        if "records" in df.columns and dict(df.dtypes)["records"].startswith("array<struct"):
            df = df.select(F.explode("records").alias("r")).select("r.*")
    elif kind in (".xlsx", ".xls"):
        import pandas as pd

        df = canonical_headers(spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda x: x.notna(), None)))
    else:
        raise UnsupportedUpload(f"can't read {kind or 'a file without extension'}; give csv, tsv, txt, json, jsonl, xlsx or xls")
    if df.isEmpty():
        raise EmptyUpload(f"{path} has no rows")
    return df.limit(cap) if cap else df


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    """Overlay rules from CSV: comment rows and rows without title are skipped, a level that is no number is null."""
    df = spark.read.option("header", True).option("comment", "#").csv(path)
    return df.filter(F.coalesce(F.trim("title_raw"), F.lit("")) != "").withColumn("level", F.col("level").try_cast("int"))


def read_archetypes(spark: SparkSession, path: str) -> DataFrame:
    """``archetype_id, version, function, entry_ord, level, title`` of archetype JSON files."""
    schema = "archetype_id string, version int, name string, industries array<string>, function_level_cascade map<string, array<struct<level int, title string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("archetype_id", "version", F.explode("function_level_cascade").alias("function", "c")).select("archetype_id", "version", "function", F.posexplode("c").alias("entry_ord", "e")).select("archetype_id", "version", "function", "entry_ord", "e.level", "e.title")


def read_log(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """A JSON-lines log; malformed lines are dropped, unknown keys ignored."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, dataset_id: str, order: str | None = None) -> None:
    """Nodes (of an id the last by the column ``order``, or the greatest row where there is none) and edges (each once) of one dataset; other datasets beside it stay."""
    rest = [c for c in nodes.columns if c != "node_id"]
    row = F.struct(*rest)
    last = F.max_by(row, F.col(order)) if order else F.max(row)
    nodes = nodes.groupBy("node_id").agg(last.alias("v")).select("node_id", *[F.col("v")[c].alias(c) for c in rest])
    for name, df in (("nodes", nodes), ("edges", edges.dropDuplicates(["parent_id", "child_id"]))):
        df.withColumn("dataset_id", F.lit(dataset_id)).write.mode("overwrite").partitionBy("dataset_id").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """A dataset's nodes, with defaults for missing values, and those of its edges whose ends both exist."""
    here = F.col("dataset_id") == dataset_id
    nodes = spark.read.parquet(f"{path}/nodes").filter(here).drop("dataset_id").fillna({"node_type": "person", "label": "", "sector": "", "is_ghost": False, "layer": 0})
    edges = spark.read.parquet(f"{path}/edges").filter(here).drop("dataset_id")
    ids = nodes.select("node_id")
    return nodes, edges.join(ids.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi").join(ids.withColumnRenamed("node_id", "child_id"), "child_id", "left_semi").select("parent_id", "child_id")


def write_export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The export as CSV with all fields quoted, or as JSON lines."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("quoteAll", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise UnsupportedUpload(f"can't write {fmt}; give csv or json")
