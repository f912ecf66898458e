"""Reports over a placed organisation: sheets, chains, views with their members, change reports, and the upkeep of rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import places, titles
from rankloom.functions.text import missing_to_null, strip
from rankloom.operators.taxonomy import geographic_roots
from rankloom.session import cut

UNCLASSIFIED = "Unclassified"


def map_records(rows: DataFrame) -> DataFrame:
    """Vendor rows with their fallbacks: the name from its parts, geography from the country, place from the person's own where the
    job's is missing, the firm from its page's address or mail domain. Columns that aren't there count as null; ``id`` and others stay."""
    col = lambda c: missing_to_null(c) if c in rows.columns else F.lit(None).cast("string")
    pick = lambda *cs: F.coalesce(*[col(c) for c in cs])
    name = F.coalesce(col("name"), F.nullif(F.trim(F.concat_ws(" ", col("first_name"), col("last_name"))), F.lit("")), F.lit(""))
    country = pick("job_country", "fallback_country")
    slug = F.initcap(F.regexp_replace(F.regexp_extract(F.regexp_replace(col("job_org_linkedin_url"), "/+$", ""), "([^/]+)$", 1), "-", " "))
    mail = F.initcap(F.element_at(F.split(col("email_domain"), r"\."), 1))
    out = {
        "name": name, "title": F.coalesce(col("title"), F.lit("")), "company": F.coalesce(col("company"), F.nullif(slug, F.lit("")), mail, F.lit("")), "job_country": country, "geography": F.coalesce(country, col("geography")),
        **{f"job_{c}": pick(f"job_{c}", f"fallback_{c}") for c in ("country_code", "state", "city", "continent", "country_region")},
    }
    return rows.withColumns(out)


def complete(records: DataFrame) -> DataFrame:
    """Records that have a name and a title."""
    return records.filter((F.coalesce(missing_to_null("name"), F.lit("")) != "") & (F.coalesce(missing_to_null("title"), F.lit("")) != ""))


def located(records: DataFrame) -> DataFrame:
    """``records`` with ``region`` (see ``places.region_of_record``) and ``country``."""
    col = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    return records.withColumn("region", places.region_of_record(col("job_country_code"), col("job_country"), col("geography"), col("title"), col("company"))).withColumn("country", places.country_tag(col("job_country"), F.col("region")))


def chains(people: DataFrame, parents: DataFrame, most: int = 20) -> DataFrame:
    """``id, chain`` of each person: those above from the top, each ``name (title)``, then the own title, joined by `` > ``.

    Level by level upwards; ``most`` levels also end cyclic data.
    """
    label = people.select(F.col("id").alias("at"), F.concat(F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("title", F.lit("")), F.lit(")")).alias("label"))
    up = parents.filter("parent_id is not null").select(F.col("id").alias("at"), "parent_id")
    walk = cut(people.select("id", F.col("id").alias("at"), F.coalesce("title", F.lit("")).alias("chain")))
    done = None
    for _ in range(most):
        step = walk.join(up, "at", "left")
        ended = step.filter("parent_id is null").select("id", "chain")
        done = ended if done is None else done.unionByName(ended)
        walk = cut(step.filter("parent_id is not null").select("id", F.col("parent_id").alias("at"), "chain").join(label, "at", "left").select("id", "at", F.concat_ws(" > ", "label", "chain").alias("chain")))
        if walk.isEmpty():
            break
    return done.unionByName(walk.select("id", "chain"))


def sheet(people: DataFrame, parents: DataFrame) -> DataFrame:
    """The long sheet, a row a person: ``name, title_native, title_en, function, level, region, country, legal_entity, reports_to_name,
    reporting_chain, n_reports, source, source_type, note, id``. Order it by ``level, function, name``."""
    col = lambda c: (F.col(c) if c in people.columns else F.lit(None).cast("string")).alias(c)
    p = people.select("id", "name", "title", "function", "level", *[col(c) for c in ("region", "country", "legal_entity", "source", "source_type", "note")])
    n = parents.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_reports"))
    boss = people.select(F.col("id").alias("parent_id"), F.col("name").alias("reports_to_name"))
    return (
        p.join(parents, "id", "left").join(boss, "parent_id", "left").join(n, "id", "left").join(chains(people, parents), "id", "left")
        .select("id", "name", F.col("title").alias("title_native"), titles.translate("title").alias("title_en"), "function", "level", "region", "country", "legal_entity", "reports_to_name", F.col("chain").alias("reporting_chain"), F.coalesce("n_reports", F.lit(0)).alias("n_reports"), "source", "source_type", "note")
    )


def canonical_json(people: DataFrame, parents: DataFrame) -> DataFrame:
    """``id, json`` of each person as one object, with the ids of those who report to it, in order."""
    kids = parents.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("direct_reports_ids"))
    j = people.join(parents.withColumnRenamed("parent_id", "reports_to_id"), "id", "left").join(kids, "id", "left").withColumn("direct_reports_ids", F.coalesce("direct_reports_ids", F.array()))
    return j.select("id", F.to_json(F.struct("id", "name", "title", "function", "level", "region", "reports_to_id", "direct_reports_ids")).alias("json"))


def members(people: DataFrame, by: str, order: str = "ord") -> DataFrame:
    """``<by>, level, id, nth``: the members of each group as rows, numbered by level and then in order of entry; rows, so that a group of any size fits."""
    from rankloom.operators.ranks import numbered

    return numbered(people.filter(F.col(by).isNotNull()).select(by, "level", order, "id"), [by], ["level", order, "id"], "nth", None).select(by, "level", "id", "nth")


def geographic_tree(people: DataFrame) -> DataFrame:
    """``country, id``: the head of each country, and before them the chief of all (the first person of level 1) as the country ``Global``."""
    top = people.filter("level = 1").groupBy(F.lit("Global").alias("country")).agg(F.min_by("id", "ord").alias("id")).filter("id is not null")
    return top.unionByName(geographic_roots(people).select("country", "id"))


def functional_roots(people: DataFrame, parents: DataFrame) -> DataFrame:
    """People of level 1 without a manager."""
    return people.filter("level = 1").join(parents.filter("parent_id is not null").select("id"), "id", "left_anti")


def classified_count(people: DataFrame) -> DataFrame:
    """One row: ``total, classified``."""
    return people.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("function") != UNCLASSIFIED).alias("classified"))


def managers_by_name(records: DataFrame) -> DataFrame:
    """``id, manager_id`` of records that name whom they report to: the first person of that name in the same firm."""
    names = records.filter("name is not null").groupBy(F.lower(F.trim("name")).alias("k"), "company").agg(F.min_by("id", "ord").alias("manager_id"))
    return records.filter(F.coalesce(F.trim("reports_to_name"), F.lit("")) != "").select("id", "company", F.lower(F.trim("reports_to_name")).alias("k")).join(names, ["k", "company"], "left").select("id", F.when(F.col("manager_id") != F.col("id"), F.col("manager_id")).alias("manager_id"))


def mermaid_footer(people: DataFrame, deepest: int = 4) -> DataFrame:
    """The chart's last line: how many people are shown and how many there are."""
    return people.agg(F.format_string("%%%% %d of %d people, levels up to %d", F.count_if(F.col("level") <= deepest), F.count(F.lit(1)), F.lit(deepest)).alias("line"))


def append_overlay(overlay: DataFrame, promoted: DataFrame) -> DataFrame:
    """The overlay with promoted rules as further rows; its order of columns stays, and what a rule lacks is null."""
    rows = promoted.select(F.col("title_l").alias("title_raw"), "region", F.col("archetype").alias("archetype_id"), "sub_industry", F.col("corrected_level").alias("level"), F.col("corrected_function").alias("function"), F.format_string("promoted: %d corrections", "corrections").alias("notes"))
    have = set(rows.columns)
    return overlay.unionByName(rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in overlay.dtypes]))


def bump_versions(archetypes: DataFrame, promoted: DataFrame) -> DataFrame:
    """``archetypes`` (``archetype_id, version``) with the version of each that got a rule one higher."""
    got = promoted.select(F.col("archetype").alias("archetype_id")).distinct().withColumn("got_", F.lit(True))
    return archetypes.join(got, "archetype_id", "left").withColumn("version", F.col("version") + F.coalesce("got_", F.lit(False)).cast("int")).drop("got_")


def page_with_total(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of at most 5,000 rows in order, each with the ``total`` of all."""
    df = cut(df)  # counted and paged
    return df.crossJoin(df.agg(F.count(F.lit(1)).alias("total"))).orderBy(*order).offset(offset).limit(min(limit, 5_000))  # one row on the right


def wire_nodes(records: DataFrame) -> DataFrame:
    """Records of the service as nodes of a chart: ``node_id, label, layer, designation, department, sector, linkedin_url``, each by the first of its names that has a value."""
    have = set(records.columns)
    pick = lambda *names: F.coalesce(*[F.nullif(strip(F.col(n).cast("string")), F.lit("")) for n in names if n in have], F.lit(""))
    return records.select(
        pick("node_id", "id").alias("node_id"), pick("label", "full_name", "name").alias("label"), F.coalesce(pick("layer", "at_layer", "level").try_cast("int"), F.lit(10)).alias("layer"), pick("designation", "title").alias("designation"),
        pick("dept_primary", "dept", "department").alias("department"), pick("sector").alias("sector"), pick("linkedin_url", "url").alias("linkedin_url"),
    )


PANEL_COLUMNS = ("Name", "Title", "Panel", "Layer", "Region", "Location", "LinkedIn", "Source")


def panel_rows(people: DataFrame) -> DataFrame:
    """A panel as the eight columns of its export, all text; write it with ``sources.readers.write_export``."""
    names = ("full_name", "designation", "dept", "at_layer", "region", "location", "linkedin_url", "method")
    return people.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(names, PANEL_COLUMNS)])


def change_counts(reports: DataFrame) -> DataFrame:
    """``type, n`` of change reports."""
    return reports.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def last_change(reports: DataFrame) -> DataFrame:
    """Of each person and firm the report received last; of equal times the larger id."""
    return reports.groupBy("companyName", "personName").agg(F.max_by(F.struct("type", "id", "received_at"), F.struct("received_at", "id")).alias("v")).select("companyName", "personName", "v.*")


#: Departments of every firm, and of some industries (fixed values).
INDUSTRY_DEPARTMENTS = {"core": ("Board of Management", "Executive Management", "Finance & Accounting", "Human Resources", "Legal, Risk & Compliance", "Information Technology", "Engineering", "Product Management", "Operations", "Supply Chain", "Manufacturing", "Procurement", "Sales & Business Development", "Marketing", "Customer Success & Service", "Strategy & Corporate Development", "Sustainability"), "industry": ("Investment Management", "Investment Banking", "Sales & Trading", "Wealth Management", "Actuarial", "Underwriting", "Claims", "Research & Development", "Medical Affairs", "Clinical Operations")}


def industries(spark) -> DataFrame:
    """``kind, dept, nth``: the lists of departments the service offers."""
    return spark.createDataFrame([(k, d, i) for k, ds in INDUSTRY_DEPARTMENTS.items() for i, d in enumerate(ds)], "kind string, dept string, nth int")


def client_search(nodes: DataFrame, text: str, most: int = 8) -> DataFrame:
    """The first ``most`` nodes, in tree order (``nth``), whose label, title, department or sector holds a text of two letters or more; else none."""
    if len(text.strip()) < 2:
        return nodes.limit(0)
    t = F.lit(text.strip().lower())
    cols = [c for c in ("label", "designation", "dept_primary", "sector") if c in nodes.columns]
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), t)
    return nodes.filter(hit).orderBy("nth").limit(most)


def ordered(df: DataFrame, kind: str) -> DataFrame:
    """A report in its order: ``debug``, ``leaders``, ``sheet``, ``public`` or ``panel``."""
    orders: dict[str, list[Column | str]] = {"debug": ["dept_primary", "layer", "full_name", "id"], "leaders": [F.desc("is_board"), "name"], "sheet": ["level", "function", "name", "id"], "public": ["layer", "name"], "panel": [F.collate("label", "UNICODE")]}
    return df.orderBy(*orders[kind])
