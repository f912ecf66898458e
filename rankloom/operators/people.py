"""Person records: normalised fields, fan-out of compound titles, and classification by rule tables.

Everything is a column expression on the rows themselves: filters and classification need no shuffle, and columns
that aren't asked for aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import rules as R
from rankloom.functions.text import missing_to_null, squeeze, strip
from rankloom.functions.titles import not_current

#: Spellings of header names, folded, by canonical name (fixed values).
HEADERS = {
    "FirstName": ("firstname", "first name", "first_name", "given name", "givenname"), "LastName": ("lastname", "last name", "last_name", "surname", "family name"), "full_name": ("full_name", "full name", "name", "person name"),
    "Designation": ("designation", "title", "job title", "job_title", "position", "role", "headline", "linkedin_headline"), "Company": ("company", "company name", "company_name", "organisation", "organization", "employer"),
    "LinkedInURL": ("linkedinurl", "linkedin url", "linkedin_url", "linkedin", "profile url"), "Location": ("location", "city", "country_name", "geography"), "Industry_Hint": ("industry_hint", "industry hint", "industry", "linkedin_industry", "sector"),
}


def canonical_headers(df: DataFrame) -> DataFrame:
    """Rename columns to their canonical names. A canonical name is claimed once: an exact column wins over an alias, an
    earlier column over a later one; later claimants are dropped."""
    fold = {c: re.sub(r"[^a-z0-9 _]", "", c.strip().lower()) for c in df.columns}
    alias = {a: k for k, names in HEADERS.items() for a in names}
    taken = {c for c in df.columns if c in HEADERS}
    out, used = [], set()
    for c in df.columns:
        k = c if c in HEADERS else alias.get(fold[c])
        if k is None:
            out.append(F.col(f"`{c}`"))
        elif (c == k or k not in taken) and k not in used:
            used.add(k)
            out.append(F.col(f"`{c}`").alias(k))
    return df.select(*out)


def coverage(df: DataFrame) -> dict[str, bool]:
    """Which required groups of fields a table has."""
    have = set(canonical_headers(df).columns)
    return {"name": bool(have & {"FirstName", "full_name"}), "title": "Designation" in have, "company": "Company" in have, "location": "Location" in have, "linkedin": "LinkedInURL" in have}


def normalize(df: DataFrame) -> DataFrame:
    """``id, full_name, designation, company, linkedin_url, location, country, industry_hint`` of people rows.

    Missing fields (null, blank, ``nan``, ``none``, ``null``) become the empty string; an unnamed person is ``Unknown``. The country is the last part of the location. Other columns are ignored.
    """
    name = squeeze(F.concat_ws(" ", missing_to_null("FirstName"), missing_to_null("LastName")))
    text = lambda c: F.coalesce(missing_to_null(c), F.lit(""))
    title = F.regexp_replace(text("Designation"), r"(?i)\s+at\s+\S.*$", "")
    return df.select(
        F.concat(F.lit("p"), F.col("row_id").cast("string")).alias("id"),
        F.when(name == "", F.lit("Unknown")).otherwise(name).alias("full_name"),
        title.alias("designation"),
        text("Company").alias("company"),
        text("LinkedInURL").alias("linkedin_url"),
        text("Location").alias("location"),
        strip(F.element_at(F.split(text("Location"), "[,/]"), -1)).alias("country"),
        text("Industry_Hint").alias("industry_hint"),
    )


def current(people: DataFrame) -> DataFrame:
    """Without former and retired people, people whose job is marked as not current, and rows that have neither name nor title."""
    if "job_is_current" in people.columns:
        people = people.filter(~not_current("job_is_current"))
    return people.filter(~F.lower("designation").rlike(R.FORMER) & ~((F.col("full_name") == "Unknown") & (F.col("designation") == "")))


def split_compound(title: Column) -> Column:
    """A title's parts: two where the first " and ", " & " or " / " stands between parts that both name a rank."""
    low = F.lower(title)
    tokens = F.array(*[F.lit(t) for t in R.TITLE_TOKENS])
    out = F.array(title)
    for sep in reversed((" and ", " & ", " / ")):
        at = F.instr(low, sep)
        left, right = strip(F.substring(title, F.lit(1), at - 1)), strip(F.substring(title, at + len(sep), F.length(title)))
        both = (at > 0) & (left != "") & (right != "") & F.arrays_overlap(F.split(F.lower(left), r"\s+"), tokens) & F.arrays_overlap(F.split(F.lower(right), r"\s+"), tokens)
        out = F.when(both, F.array(left, right)).otherwise(out)
    return out


def fan_out(people: DataFrame) -> DataFrame:
    """One row per part of a compound title, with its number ``part`` from 1; the id stays."""
    return people.select("*", F.posexplode(split_compound(F.col("designation"))).alias("part0", "part_title")).withColumn("designation", F.col("part_title")).withColumn("part", F.col("part0") + 1).drop("part0", "part_title")


def acronym_layer(title: Column, table: R.Lookup = R.ACRONYMS) -> Column:
    """Layer of a title that is an acronym but for up to three trailing places or scopes."""
    t = F.lower(strip(title))
    for _ in range(3):
        t = F.regexp_replace(F.regexp_replace(t, R.ACRONYM_SUFFIX, ""), r"^[ ,|–-]+|[ ,|–-]+$", "")
    return table.column(t)


def layer(title: Column, financial: bool = False, job_level: Column | None = None) -> Column:
    """Seniority 0 (board) to 10: acronym, then the first layer whose pattern occurs, then a vendor's ``job_level``, then 10."""
    low = F.regexp_replace(F.lower(strip(title)), R.OFFICE_OF, " ")
    rules, acr = (R.FINANCIAL_LAYERS, R.FINANCIAL_ACRONYMS) if financial else (R.CORPORATE_LAYERS, R.ACRONYMS)
    by_level = [R.JOB_LEVELS.column(F.lower(strip(job_level)))] if job_level is not None else []
    return F.when(low == "", F.coalesce(*by_level, F.lit(10))).otherwise(F.coalesce(acronym_layer(title, acr), rules.column(low), *by_level, F.lit(10)))


def department_scores(title: Column, table=R.DEPARTMENTS) -> Column:
    """Array of (score, -position, department), best first."""
    low = F.lower(title)
    scores = []
    for i, (dept, words) in enumerate(table):
        total = sum((F.when(F.contains(low, F.lit(w)), n).otherwise(0) for w, n in words), F.lit(0))
        scores.append(F.struct(total.alias("score"), F.lit(-i).alias("nth"), F.lit(dept).alias("dept")))
    return F.sort_array(F.array(*scores), asc=False)


def bare_department(title: Column) -> Column:
    """Department of a title that is nothing but a department's name; else null."""
    low = F.lower(strip(title))
    return F.when(~low.rlike(R.SENIORITY_WORDS), R.BARE_DEPTS.column(low))


def classify(people: DataFrame, financial: bool = False, departments=R.DEPARTMENTS) -> DataFrame:
    """``people`` with ``layer, dept_primary, dept_secondary, confidence, sector, region``."""
    title = F.col("designation")
    df = people.withColumn("s", department_scores(title, departments)).withColumn("bare", bare_department(title)).withColumn("layer0", layer(title, financial))
    best, gap = F.col("s")[0]["score"], F.col("s")[0]["score"] - F.col("s")[1]["score"]
    dept = F.when(F.col("bare").isNotNull(), F.col("bare")).when(title == "", "Operations").when(F.col("layer0") == 0, "Board of Management").when(best == 0, "Operations").otherwise(F.col("s")[0]["dept"])
    conf = F.when(title == "", 0.1).when(F.col("layer0") == 0, 1.0).when(best == 0, 0.3).when(gap >= 60, 0.95).when(gap >= 30, 0.80).when(gap >= 10, 0.65).otherwise(0.60)
    sub = F.lit("")
    for d, r in R.SUB_DEPARTMENTS:
        sub = F.when(F.col("dept_primary") == d, r.column(F.lower(title), "")).otherwise(sub)
    combined = F.lower(F.concat_ws(" ", "company", "designation", "industry_hint"))
    place = F.lower(F.col("country"))
    return (
        df.withColumn("dept_primary", dept)
        .withColumn("dept_secondary", sub)
        .withColumn("confidence", conf)
        .withColumn("layer", F.when(F.col("bare").isNotNull(), F.greatest(F.col("layer0"), F.lit(8))).otherwise(F.col("layer0")))
        .withColumn("sector", R.SECTORS.column(combined, "General"))
        .withColumn("region", F.when(place == "", "Global").otherwise(R.REGIONS.column(place, "Global")))
        .drop("s", "bare", "layer0")
    )


def exec_flags(title: Column) -> dict[str, Column]:
    """Predicates on a leader's title, and from them the board role and the region."""
    t = F.lower(strip(title))
    out = {}
    for name, rule in R.FLAGS.items():
        c = F.lit(True)
        for p in rule["all"]:
            c = c & t.rlike(p)
        for p in rule["none"]:
            c = c & ~t.rlike(p)
        out[name] = c
    role = F.when(out["is_chairman"], "chairman").when(out["is_vice_chair"], "vice_chair").when(t.rlike(R.LEAD_DIRECTOR), "lead_director")
    for k, p in R.COMMITTEES:
        role = role.when(out["is_committee_chair"] & t.rlike(p), k)
    out["board_sub_role"] = role.when(out["is_committee_chair"], "committee_chair").otherwise("director")
    out["exec_region"] = F.when(t.rlike(R.HEAD_OFFICE_TITLE), "Global HQ").otherwise(R.EXEC_REGIONS.column(t, "Global HQ"))
    return out


def place(classified: DataFrame) -> DataFrame:
    """Canonical department and layer of each uploaded person: nobody uploaded sits in the board or, but for C-suite, in
    the executive panel; regional heads stand below the apex; sub-departments count from layer 3 down."""
    f = exec_flags(F.col("designation"))
    board = (F.col("layer") == 0) | ((F.col("layer") <= 2) & (F.col("dept_primary") == "Board of Management"))
    fallback = F.when(F.col("dept_primary").isin("Board of Management", ""), "Strategy & Corporate Development").otherwise(F.col("dept_primary"))
    outsider = board | ((F.col("layer") == 1) & ~f["is_csuite"])
    return (
        classified.withColumn("outsider", outsider)
        .withColumn("dept", F.when(F.col("outsider"), fallback).when(F.col("layer") == 1, "Executive Management").otherwise(F.when(F.col("dept_primary") == "", "Operations").otherwise(F.col("dept_primary"))))
        .withColumn("at_layer", F.when(F.col("outsider"), 3).when((F.col("layer") == 1) & f["is_regional"], 2).otherwise(F.col("layer")))
        .withColumn("sub_dept", F.when(F.col("at_layer") > 2, F.col("dept_secondary")).otherwise(""))
        .withColumn("sub_dept", F.when(F.lower("sub_dept") == F.lower("dept"), "").otherwise(F.col("sub_dept")))
        .drop("outsider")
    )
