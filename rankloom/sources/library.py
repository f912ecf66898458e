"""Libraries and request sources: rows from memory, industry files, rule books, ranked addresses of pages."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.operators.directory import Directory
from rankloom.sources.readers import LEDGER

#: Fields that a correction must have (fixed values).
REQUIRED_CORRECTION = ("node_id", "firm", "archetype", "archetype_version", "region", "original_title_native", "original_level", "original_function", "corrected_level", "corrected_function", "correction_reason", "analyst_id")


class InvalidRequest(ValueError):
    """A request lacks what it must have."""


def from_request(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows of a request in a schema; unknown keys are dropped, missing ones null."""
    names = [f.strip().split()[0] for f in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def check_corrections(rows: list[dict]) -> list[dict]:
    """Corrections as they came; the first that lacks a required field raises ``InvalidRequest`` with the field's name."""
    for r in rows:
        for f in REQUIRED_CORRECTION:
            if r.get(f) is None:
                raise InvalidRequest(f"a correction needs {f}")
    return rows


def valid_corrections(df: DataFrame) -> DataFrame:
    """Corrections that have every required field, and those that don't told by ``missing``, the names of what they lack."""
    lacks = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED_CORRECTION]))
    return df.withColumn("missing", lacks)


def read_corrections(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return from_request(spark, check_corrections(rows), LEDGER)


def read_directory(spark: SparkSession, folder: str) -> Directory:
    """The industry directory of a folder of YAML (if that library is there) or JSON files, in order of their names; a file that can't be read is skipped."""
    try:
        import yaml
    except ImportError:
        yaml = None
    detection, canonical, patterns, keywords = [], [], [], []
    for f in sorted(os.listdir(folder)):
        kind = os.path.splitext(f)[1]
        if kind not in (".json", ".yaml", ".yml") or (kind != ".json" and yaml is None):
            continue
        try:
            with open(os.path.join(folder, f), encoding="utf-8") as h:
                d = json.load(h) if kind == ".json" else yaml.safe_load(h)
            i = str(d["id"])
            own = (
                [(i, k, str(w)) for k, ws in (d.get("detection_keywords") or {}).items() for w in ws],
                [(i, int(l["layer"]), str(n)) for l in d.get("hierarchy") or [] for n in l.get("canonical") or []],
                [(i, int(l["layer"]), str(n)) for l in d.get("hierarchy") or [] for n in l.get("patterns") or []],
                [(i, str(x["primary"]), str(w)) for x in d.get("departments") or [] for w in x.get("keywords") or []],
            )
        except Exception:  # noqa: BLE001 - any fault of a file concerns that file alone
            continue
        for total, part in zip((detection, canonical, patterns, keywords), own):
            total += part
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Directory(make(detection, "industry string, kind string, keyword string"), make(canonical, "industry string, layer int, name string"), make(keywords, "industry string, dept string, keyword string"), make(patterns, "industry string, layer int, pattern string"))


def grades_of_book(rows: DataFrame) -> DataFrame:
    """``title, grade`` of a rule book's rows (``ord, grade, title``): grades ``G<number>``; a title's alternatives between
    commas and slashes, and its acronym in brackets, count each; the first row of a title stands."""
    g = rows.withColumn("g", F.regexp_extract("grade", r"^\s*[Gg](\d+)", 1).try_cast("int")).filter("g is not null and title is not null")
    plain = F.regexp_replace("title", r"\([^)]*\)", " ")
    names = F.concat(F.split(plain, r"[,/]"), F.regexp_extract_all("title", F.lit(r"\(([A-Z][A-Za-z&]{1,6})\)"), F.lit(1)))
    return g.select("ord", "g", F.explode(names).alias("n")).select("ord", "g", F.lower(F.trim(F.regexp_replace("n", r"\s+", " "))).alias("title")).filter("title <> ''").groupBy("title").agg(F.min_by("g", "ord").alias("grade"))


def dataset_exists(spark: SparkSession, path: str, dataset_id: str) -> bool:
    """Whether a stored chart can be restored: its nodes are there, and more than one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/nodes").filter(F.col("dataset_id") == dataset_id).limit(2).count() > 1
    except AnalysisException:
        return False


#: Headers of vendor files by field (fixed values); a header is folded to letters, digits and underscores.
VENDOR_HEADERS = {"name": ("full_name", "name"), "first_name": ("first_name",), "last_name": ("last_name",), "title": ("job_title", "title"), "company": ("company_name", "company"), "job_country": ("job_location_country", "job_country"), "job_country_code": ("job_location_country_code", "job_country_code"), "job_city": ("job_location_city", "job_city"), "job_state": ("job_location_state", "job_state"), "fallback_country": ("country_name", "country"), "email_domain": ("email_domain",), "job_org_linkedin_url": ("job_org_linkedin_url",), "vendor_function": ("job_function",), "vendor_level": ("job_level",), "linkedin_headline": ("linkedin_headline", "headline"), "linkedin_industry": ("linkedin_industry", "industry")}


def map_headers(df: DataFrame, table: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Columns of a vendor file, of whatever source, under the names of our fields; the first header of a field stands, others are kept as they are unless that name is taken."""
    fold = {re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_"): c for c in reversed(df.columns)}
    used, out = set(), []
    for field, headers in (VENDOR_HEADERS if table is None else table).items():
        c = next((fold[h] for h in headers if h in fold and fold[h] not in used), None)
        if c is not None:
            used.add(c)
            out.append(F.col(f"`{c}`").alias(field))
    taken = {f for f in (VENDOR_HEADERS if table is None else table)}
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in used and c not in taken])


def load_demo(spark: SparkSession, path: str) -> DataFrame:
    """The demonstration file as uploaded people."""
    from rankloom.operators.people import canonical_headers
    from rankloom.sources.readers import read_upload

    return canonical_headers(read_upload(spark, path))


def reset(spark: SparkSession) -> None:
    """Forget what the session holds: temporary views and cached tables; stored charts stay."""
    for t in spark.catalog.listTables():
        if t.isTemporary:
            spark.catalog.dropTempView(t.name)
    spark.catalog.clearCache()


#: Where firms show their leaders, best first (fixed values).
LEADER_PATHS = ("/about/leadership", "/leadership", "/about-us/leadership", "/about/management", "/management", "/about/board-of-directors", "/board-of-directors", "/about/our-team", "/our-team", "/team", "/company/leadership", "/company/management", "/who-we-are/leadership", "/investors/governance", "/investor-relations/board", "/corporate-governance", "/about/executive-team", "/executive-team", "/people", "/about-us", "/about")


def ranked_addresses(firms: DataFrame, paths: tuple[str, ...] = LEADER_PATHS, hosts: tuple[str, ...] = ("www.", "")) -> DataFrame:
    """``firm, url, rank`` of the pages to try for each firm (``firm, domain``), best first."""
    tries = F.array(*[F.struct(F.lit(i * len(hosts) + j).alias("rank"), F.lit(h).alias("h"), F.lit(p).alias("p")) for i, p in enumerate(paths) for j, h in enumerate(hosts)])
    return firms.filter(F.coalesce("domain", F.lit("")) != "").select("firm", "domain", F.explode(tries).alias("t")).select("firm", F.concat(F.lit("https://"), F.col("t.h"), F.col("domain"), F.col("t.p")).alias("url"), F.col("t.rank").alias("rank"))


def first_page_with_people(pages: DataFrame, least: int = 2) -> DataFrame:
    """Of each firm's fetched pages (``firm, rank, n_people``) the best-ranked with ``least`` people or more: ``firm, rank, n_people``."""
    return pages.filter(F.col("n_people") >= least).groupBy("firm").agg(F.min_by(F.struct("rank", "n_people"), "rank").alias("v")).select("firm", "v.*")


def within_budget(pages: DataFrame, most_chars: int = 25_000, most_pages: int = 4) -> DataFrame:
    """Each firm's pages (``firm, rank, text``) in order, as long as fewer than ``most_chars`` and ``most_pages`` came before."""
    w = Window.partitionBy("firm").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).withColumn("n", F.count(F.lit(1)).over(w)).filter((F.col("before") < most_chars) & (F.col("n") < most_pages)).drop("before", "n")


def host_of(url: Column | str) -> Column:
    return F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://([^/?#:\s]+)", 1)
