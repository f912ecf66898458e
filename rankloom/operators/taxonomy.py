"""Rule library, vendor classification and their reconciliation; the reporting tree of vendor records and its views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions import rules as R
from rankloom.functions.text import missing_to_null, strip

STOP = "of|the|and|for|in|to|a|an"
GENERIC = "manager|director|engineer|analyst|associate|specialist|coordinator|lead|senior manager|senior director".split("|")
COUNTRY_LEADER = r"country manager|country head|country director|managing director|representative director"


def fold_title(c: Column | str) -> Column:
    return F.lower(strip(c))


def overlay_keys(overlay: DataFrame, native: bool = True) -> DataFrame:
    """The overlay by folded title; rows by ``row_ord``, an order over all their columns. With ``native`` a row counts under both its titles."""
    o = overlay.select(
        fold_title("title_raw").alias("raw"), fold_title("title_native").alias("nat"), F.col("region").alias("o_region"), F.col("archetype_id").alias("o_arch"), F.coalesce("sub_industry", F.lit("")).alias("o_sub"), "level", "normalized_title", F.col("function"),
    )
    o = o.withColumn("row_ord", F.struct("raw", F.coalesce("nat", F.lit("")), "o_region", "o_arch", "o_sub", "level", "normalized_title"))
    keys = F.array_distinct(F.array_compact(F.array("raw", "nat"))) if native else F.array_compact(F.array("raw"))
    return o.select(F.explode(keys).alias("key"), "o_region", "o_arch", "o_sub", "level", "normalized_title", "function", "row_ord").filter("key <> ''")


def lookup_overlay(people: DataFrame, overlay: DataFrame, mode: str = "v2") -> DataFrame:
    """``id, level, function, normalized_title, pass`` of each person (``id, title, region, archetype, sub_industry``) with a hit.

    Passes, the first that hits wins: region and archetype and sub-industry; region and archetype; region and ``any``;
    ``Global`` and archetype; ``Global`` and ``any``. ``v2`` looks under both titles and passes 2 to 5 ignore the
    sub-industry; ``nlp`` looks under the raw title and passes 2 to 5 want none. Ties: the first row in order. The
    overlay is joined on its title, as a broadcast only while it is small.
    """
    p = people.select("id", fold_title("title").alias("key"), F.coalesce("region", F.lit("Global")).alias("region"), F.coalesce("archetype", F.lit("any")).alias("archetype"), F.coalesce("sub_industry", F.lit("")).alias("sub")).filter("key <> ''")
    hit = p.join(overlay_keys(overlay, mode == "v2"), "key")
    here, world = F.col("o_region") == F.col("region"), F.col("o_region") == "Global"
    mine, any_ = F.col("o_arch") == F.col("archetype"), F.col("o_arch") == "any"
    free = F.lit(True) if mode == "v2" else F.col("o_sub") == ""
    n = (
        F.when(here & mine & (F.col("sub") != "") & (F.col("o_sub") == F.col("sub")), 1).when(here & mine & free, 2).when(here & any_ & free, 3).when(world & mine & free, 4).when(world & any_ & free, 5)
    )
    return (
        hit.withColumn("pass", n).filter("pass is not null").groupBy("id").agg(F.min_by(F.struct("level", "function", "normalized_title", "pass"), F.struct("pass", "row_ord")).alias("v")).select("id", "v.*")
    )


def title_tokens(c: Column) -> Column:
    """Sorted distinct words without stop-words."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: (x != "") & ~x.isin(*STOP.split("|")))))


def cascade(titles: DataFrame, entries: DataFrame) -> DataFrame:
    """``title, entry, tier`` of each distinct title: 1 the same text, 2 the same words, 3 an entry whose words all occur in it
    (the one of most words). Ties: the first entry in order. Joined on words, so no title meets an entry it shares nothing with."""
    t = titles.select("title").filter("title is not null").distinct().withColumn("tw", title_tokens(F.col("title"))).filter("size(tw) > 0")
    e = entries.select("entry").filter("entry is not null").distinct().withColumn("ew", title_tokens(F.col("entry"))).filter("size(ew) > 0")
    shared = t.select("title", "tw", F.explode("tw").alias("w")).join(e.select("entry", "ew", F.explode("ew").alias("w")), "w").groupBy("title", "entry").agg(F.first(F.size("tw")).alias("nt"), F.first(F.size("ew")).alias("ne"), F.count(F.lit(1)).alias("n"))
    tier = F.when(fold_title("title") == fold_title("entry"), 1).when((F.col("n") == F.col("nt")) & (F.col("n") == F.col("ne")), 2).when(F.col("n") == F.col("ne"), 3)
    return shared.withColumn("tier", tier).filter("tier is not null").groupBy("title").agg(F.min_by(F.struct("entry", "tier"), F.struct("tier", -F.col("ne"), "entry")).alias("v")).select("title", "v.*")


def vendor_classes(records: DataFrame, archetype: str = "any") -> DataFrame:
    """``id, v_function, v_level``: vendor function, level and persona in our terms; Operations and Engineering are told apart by title."""
    low = F.lower(F.coalesce("title", F.lit("")))
    f = R.VENDOR_FUNCTIONS.column(F.lower(strip("vendor_function")))
    prop = low.rlike(R.PROPERTY_TITLES)
    fn = (
        F.when(f == "Operations", R.OPERATIONS_BY_TITLE.column(low, "Operations"))
        .when(f.isin("Engineering", "Information Technology") & prop, "Facilities, Real Estate & Workplace")
        .when((f == "Engineering") & F.lit(archetype == "process_industries"), "Research & Development")
        .otherwise(f)
    )
    persona = F.lower(strip(F.coalesce("vendor_persona", F.lit(""))))
    within = None
    for k, n in R.VENDOR_LEVELS.rows:
        within = F.when(F.contains(persona, F.lit(k)), n) if within is None else within.when(F.contains(persona, F.lit(k)), n)
    return records.select("id", fn.alias("v_function"), F.coalesce(R.VENDOR_LEVELS.column(F.lower(strip("vendor_level"))), R.VENDOR_LEVELS.column(persona), within).alias("v_level"))


def reconcile(rule: DataFrame, vendor: DataFrame) -> DataFrame:
    """``id, function, level, source, conflict``: the rule library wins, the vendor fills gaps, else unclassified at 99.

    ``rule``: id, title, r_function, r_level, cascade_only. A generic title matched by cascade alone takes the vendor's
    function. A conflict is another function or a level two or more away. Where only one side is partial, level 0 counts as missing, as in the original rules.
    """
    j = rule.join(vendor, "id", "left")
    full = F.col("r_function").isNotNull() & F.col("r_level").isNotNull()
    generic = full & F.coalesce("cascade_only", F.lit(False)) & fold_title("title").isin(*GENERIC) & F.col("v_function").isNotNull() & (F.col("v_function") != F.col("r_function"))
    partial = F.col("r_function").isNotNull() | F.col("r_level").isNotNull()
    vfull = F.col("v_function").isNotNull() & F.col("v_level").isNotNull()
    nz = lambda c: F.when(F.col(c) != 0, F.col(c))
    vpart = F.col("v_function").isNotNull() | nz("v_level").isNotNull()
    return j.select(
        "id",
        F.when(generic, F.col("v_function")).when(full, F.col("r_function")).otherwise(F.coalesce("r_function", "v_function", F.lit("Unclassified"))).alias("function"),
        F.when(full, F.col("r_level")).when(partial, F.coalesce(nz("r_level"), nz("v_level"), F.lit(99))).when(vfull, F.col("v_level")).otherwise(F.coalesce(nz("v_level"), F.lit(99))).alias("level"),
        F.when(generic, "rule+vendor-fn").when(full, "rule").when(partial, "rule+vendor").when(vfull, "vendor").when(vpart, "vendor-partial").otherwise("none").alias("source"),
        (full & ~generic & (F.coalesce(F.col("v_function") != F.col("r_function"), F.lit(False)) | F.coalesce((F.col("v_level") != 0) & (F.abs(F.col("v_level") - F.col("r_level")) >= 2), F.lit(False)))).alias("conflict"),
    )


def find_parents(people: DataFrame) -> DataFrame:
    """``id, parent_id`` of each person (``id, function, level, region, ord``): of the same function the nearest level above, first
    in the same region, then in ``Global``, then anywhere; the first entered wins. Null if nobody is above.

    People meet only through their (function, region, level), of which there are few, so no group of people is joined with itself.
    """
    w = Window.partitionBy("function", "region").orderBy("level")
    seats = people.filter("level >= 1").groupBy("function", "region", "level").agg(F.min_by("id", "ord").alias("first"), F.min("ord").alias("o"))
    levels = people.select("function", "region", "level").distinct()
    above_here = levels.join(seats, ["function", "region", "level"], "left").withColumn("up", F.last("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    need = people.select("function", "level").distinct()

    def pick(s: DataFrame, name: str) -> DataFrame:
        v = Window.partitionBy("function").orderBy("level")
        return need.join(s.select("function", "level", "first"), ["function", "level"], "left").withColumn(name, F.last("first", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1))).select("function", "level", name)

    anywhere = seats.groupBy("function", "level").agg(F.min_by("first", "o").alias("first"))
    world = pick(seats.filter("region = 'Global'"), "up_world")
    any_ = pick(anywhere, "up_any")
    return (
        people.join(above_here.select("function", "region", "level", "up"), ["function", "region", "level"], "left")
        .join(world, ["function", "level"], "left")
        .join(any_, ["function", "level"], "left")
        .select("id", F.when(F.col("level") > 1, F.coalesce("up", "up_world", "up_any")).alias("parent_id"))
    )


def geographic_roots(people: DataFrame) -> DataFrame:
    """``country, id``: of each country its explicit leader of the lowest level, else its first resident by level (unclassified ones never)."""
    p = people.filter("country is not null").withColumn("explicit", F.lower("title").rlike(COUNTRY_LEADER))
    p = p.filter(F.coalesce("explicit", F.lit(False)) | (F.col("level") < 99))
    return p.groupBy("country").agg(F.min_by("id", F.struct((~F.coalesce("explicit", F.lit(False))).alias("x"), "level", "ord")).alias("id"))


def legal_entities(people: DataFrame, firm: str) -> DataFrame:
    """``entity, parent, n_people``: the firm has no parent, every other entity has the firm."""
    e = F.coalesce(missing_to_null("legal_entity"), F.lit(firm))
    return people.groupBy(e.alias("entity")).agg(F.countDistinct("id").alias("n_people")).select("entity", F.when(F.col("entity") != firm, F.lit(firm)).alias("parent"), "n_people")


def knowledge_graph(people: DataFrame, parents: DataFrame, firm: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (kind, key) and edges (kind, source, target) of persons, functions, regions and legal entities."""
    e = F.coalesce(missing_to_null("legal_entity"), F.lit(firm))
    col = lambda k, c: people.select(F.lit(k).alias("kind"), c.alias("key")).filter("key is not null").distinct()
    nodes = col("Person", F.col("id")).unionByName(col("Function", F.col("function"))).unionByName(col("Region", F.col("region"))).unionByName(col("LegalEntity", e))
    edge = lambda k, t: people.select(F.lit(k).alias("kind"), F.col("id").alias("source"), t.alias("target")).filter("target is not null").distinct()
    edges = edge("IN_FUNCTION", F.col("function")).unionByName(edge("IN_REGION", F.col("region"))).unionByName(edge("EMPLOYED_BY", e))
    return nodes, edges.unionByName(parents.filter("parent_id is not null").select(F.lit("REPORTS_TO").alias("kind"), F.col("id").alias("source"), F.col("parent_id").alias("target")))


def mermaid(people: DataFrame, parents: DataFrame, deepest: int = 4) -> DataFrame:
    """``line``: a chart's text for people down to a level; an edge only where both ends are kept."""
    kept = people.filter(F.col("level") <= deepest)
    label = F.concat(F.lit("    "), F.col("id"), F.lit('["'), F.regexp_replace(F.coalesce("name", F.lit("")), '"', "'"), F.lit('"]'))
    both = parents.join(kept.select("id"), "id", "left_semi").join(kept.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return kept.select(label.alias("line")).unionByName(both.select(F.concat(F.lit("    "), F.col("parent_id"), F.lit(" --> "), F.col("id")).alias("line")))
